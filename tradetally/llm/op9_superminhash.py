"""Near-duplicate groups by SuperMinHash signatures.

SuperMinHash gives every element one random permutation of the signature's
slots; its value in a slot is the slot's place in that permutation plus a
uniform number, and the signature keeps the least value of each slot. Ranks of
one element are thus correlated without replacement, which lowers the variance
below that of independent hashes. Levels are worked off for all elements of a
document at once, and it stops as soon as no later level can lower a slot.

Bands of the signature propose links; every proposed link is confirmed on the
full shingle sets. Equal sets form classes first, so copies of any number
cost one row. Within a band's bucket no pairs are listed: its members are
compared with its first member. Ids that buckets connect form a cluster; where
a cluster still falls into several groups, these are compared with each other
inside tasks, in blocks of bounded size, which return only links that unite
groups. Confirmed links are grouped by union-find inside tasks and by
distributed star contraction across them.

Defined results: words are runs without ASCII white space, A-Z folded; a text
of fewer than ``SHINGLE`` words has its whole word sequence as its one shingle;
null, empty and blank texts have no shingle, are linked with nothing and stand
alone; rows of equal id count as one document if their sets are equal, and
each row is returned; a null id is linked with nothing; an empty table gives
no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import mix, release, rolling, signed, slices, stored, table, utf8

SHINGLE = 5
#: Slots of a signature at the threshold of 0.85, in bands of ``BAND`` slots. A
#: link at the threshold is missed by all bands with a probability of ``MISSED``
#: at most: 16 bands at 0.85, 22 at 0.8.
SLOTS = 64
BAND = 4
MISSED = 1e-5
#: Documents in a block when groups are compared; links in a file of the grouping's tables.
BLOCK = 512
LINKS_A_FILE = 500_000
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, in a row, and the offsets."""
    words = [t.lower().split() for t in texts]
    h = xxhash.xxh64_intdigest
    n = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter(map(h, chain.from_iterable(words)), np.uint64, int(n.sum()))
    text = np.repeat(np.arange(len(words)), n)
    runs = rolling(hashes, size)
    inside = text[:len(runs)] == text[size - 1:] if len(runs) else np.zeros(0, bool)
    owner, value = text[:len(runs)][inside], runs[inside]
    short = [(i, h(b" ".join(words[i]), seed=1)) for i in np.flatnonzero((n > 0) & (n < size)).tolist()]
    if short:
        owner = np.concatenate([owner, [i for i, _ in short]])
        value = np.concatenate([value, np.array([x for _, x in short], np.uint64)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(words) + 1))


def super_min_hash(value: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) as float64; a text without elements has infinities."""
    count = len(offsets) - 1
    owner = np.repeat(np.arange(count), np.diff(offsets))
    out = np.full((count, slots), np.inf)
    flat = out.reshape(-1)
    live, owner, state = value, owner, None
    for level in range(slots):
        if not len(live):
            break
        draw = mix(live + np.uint64(_STEP * (level + 1) & (1 << 64) - 1))
        # high bits choose the slot, low bits are the uniform number
        swap = level + ((draw >> np.uint64(40)) % np.uint64(slots - level)).astype(np.int64)
        part = (draw & np.uint64((1 << 40) - 1)).astype(np.float64) / float(1 << 40)
        rows = np.arange(len(live))
        if state is None:
            slot = swap
        else:
            slot = state[rows, swap].astype(np.int64)
            state[rows, swap] = state[rows, level]
        np.minimum.at(flat, owner * slots + slot, level + part)
        # a text is done when no slot lies above the next level
        open_texts = out.max(axis=1) >= level + 1
        keep = open_texts[owner]
        if state is None:
            state = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int64), (int(keep.sum()), 1))
            state[np.arange(len(state)), swap[keep]] = 0
        else:
            state = state[keep]
        live, owner = live[keep], owner[keep]
    return out


def slots_for(num: int, den: int) -> int:
    """Slots whose bands miss a link at a similarity of num/den with a probability of ``MISSED`` at most."""
    same = (num / den) ** BAND
    return BAND * (math.ceil(math.log(MISSED) / math.log1p(-same)) if same < 1 else 1)


def _sums(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def signatures(docs: DataFrame, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """(id, n_shingles, set_key, bands): ``set_key`` is equal for equal
    sets only; ``bands`` is null for documents that are linked with nothing."""
    per = slots // BAND

    def sign(batches):
        for b in batches:
            texts, none = utf8(b.column(1)), np.asarray(b.column(0).is_null())
            for lo, hi in slices(texts):
                value, offsets = shingle_sets(texts[lo:hi])
                sig = super_min_hash(value, offsets, slots)
                n = np.diff(offsets)
                cells = mix(np.where(np.isinf(sig), -1, sig).view(np.uint64))
                bands = np.zeros((hi - lo, per), np.uint64)
                for j in range(per):
                    at = np.full(hi - lo, j + 1, np.uint64)
                    for k in range(BAND):
                        at = mix(at * np.uint64(_STEP) + cells[:, j * BAND + k])
                    bands[:, j] = at
                key = np.stack([_sums(value, offsets), _sums(mix(value), offsets), n.astype(np.uint64)], axis=1)
                blank = (n == 0) | none[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()),
                     pa.array([None if x else k.astype("<u8").tobytes() for x, k in zip(blank, key)], pa.binary()),
                     pa.array([None if x else r for x, r in zip(blank, signed(bands))], pa.list_(pa.int64()))],
                    ["id", "n_shingles", "set_key", "bands"])
            release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(sign, "id long, n_shingles long, set_key binary, bands array<long>")


def _top(up: dict[int, int], x: int) -> int:
    while (y := up.setdefault(x, x)) != x:
        up[x] = x = up.setdefault(y, y)
    return x


def _union_find(pairs):
    """Least member of the group of each node, for links (a, b)."""
    up: dict[int, int] = {}

    for a, b in pairs:
        a, b = _top(up, a), _top(up, b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, _top(up, x)) for x in list(up)]


def groups(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, root) for links (a, b): the least id reachable from each id.

    Tasks first unite their own links; then large-star and small-star steps
    contract the forest until it no longer changes. Both need the least
    neighbour of a node only, so a node with many links is pre-aggregated.
    """
    def unite(batches):
        for b in batches:
            rows = _union_find(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            rows = [(x, r) for x, r in rows if x != r]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()),
                                              pa.array([r for _, r in rows], pa.int64())], ["a", "b"])

    def state(df):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    # a > b in every link from here on
    star = stored(spark, links.select("a", "b").mapInArrow(unite, "a long, b long").distinct(), "links")
    before, now = None, state(star)
    files = 1 + now[0] // LINKS_A_FILE
    while now != before:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = stored(spark, least.coalesce(files), "least")
        # large-star: larger neighbours go to the least of a node and its neighbours
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = stored(spark, large.distinct().coalesce(files), "large")
        # small-star: a node and its smaller neighbours go to the least of these
        least = stored(spark, large.groupBy("a").agg(F.min("b").alias("m")).coalesce(files), "least")
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        star = stored(spark, star.coalesce(files), "links")
        before, now = now, state(star)
    return star.select(F.col("a").alias("id"), F.col("b").alias("root"))


def confirm(spark: SparkSession, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: den * intersection >= num * union."""
    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return stored(spark, both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "confirmed")


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def collect(batches):
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in slices(texts):
                value, offsets = shingle_sets(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.array([value[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])], pa.binary())],
                    ["id", "shingles"])
            release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(wanted, "id", "left_semi").mapInArrow(collect, "id long, shingles binary")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    num: int = 85, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id, kept, class_id): documents whose sets
    reach a similarity of num/den are linked; ``component_id`` is the least id
    of the linked group, ``class_id`` the least id of an equal set."""
    signed_docs = stored(spark, signatures(docs, id_col, text_col, slots_for(num, den)), "signatures")
    with_set = signed_docs.where(F.col("set_key").isNotNull())
    # a set's class: represented by its least id
    classes = stored(spark, with_set.groupBy("set_key").agg(
        F.min("id").alias("id"), F.min_by("bands", "id").alias("bands")), "classes")
    cells = classes.select("id", F.explode("bands").alias("band"))
    sizes = cells.groupBy("band").agg(F.count("*").alias("members"), F.min("id").alias("first"))
    buckets = stored(spark, sizes.where("members > 1"), "buckets")
    members = stored(spark, cells.join(buckets, "band").select("id", "first"), "members")
    # an id may stand for several classes if rows share it; sets are then taken of all its rows
    wanted = stored(spark, members.select("id").distinct(), "wanted")
    sets = stored(spark, _sets_of(docs, wanted, id_col, text_col), "sets")

    pairs = members.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    pairs = stored(spark, pairs, "pairs")
    links = confirm(spark, pairs, sets, num, den)
    links = links.unionByName(between_groups(spark, sets, groups(spark, pairs), groups(spark, links), num, den))
    root = groups(spark, links)

    class_of = classes.select("set_key", F.col("id").alias("class_id"))
    class_of = class_of.join(root, class_of.class_id == root.id, "left").select(
        "set_key", "class_id", F.coalesce("root", "class_id").alias("component"))
    class_of = stored(spark, class_of, "groups")
    out = with_set.select("id", "n_shingles", "set_key").join(class_of, "set_key").select(
        "id", "n_shingles", "component", "class_id")
    out = out.unionByName(signed_docs.where(F.col("set_key").isNull()).select(
        "id", "n_shingles", F.col("id").alias("component"), F.col("id").alias("class_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"), "class_id")


def between_groups(spark: SparkSession, sets: DataFrame, cluster: DataFrame, root: DataFrame, num: int, den: int,
                   block: int = BLOCK) -> DataFrame:
    """Links between different groups (``root``) of a cluster of ids that band
    buckets connect. Members outside of the cluster's largest group are
    compared with all others, block against block: a task gets two blocks,
    finds their intersections by matrix products over the shingles that two
    of them share, and returns no more links than unite its groups."""
    ids = sets.select("id", "shingles")
    placed = ids.join(cluster.withColumnRenamed("root", "cluster"), "id", "left").join(root, "id", "left").select(
        F.coalesce("cluster", "id").alias("cluster"), F.coalesce("root", "id").alias("root"), "id")
    placed = stored(spark, placed.distinct(), "placed")
    parts = placed.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"),
                                         F.sum("n").alias("n"), F.count("*").alias("groups"))
    mixed = stored(spark, mixed.where("groups > 1").select(
        "cluster", "main", F.ceil((F.col("n") - F.col("most")) / block).cast("int").alias("others"),
        F.ceil(F.col("most") / block).cast("int").alias("mains")), "mixed")
    member = placed.join(mixed, "cluster").withColumn("own", F.col("root") != F.col("main"))
    lot = F.xxhash64("id")
    member = member.withColumn("at", F.when(F.col("own"), F.pmod(lot, F.col("others"))).otherwise(
        F.col("others") + F.pmod(lot, F.col("mains"))).cast("int"))
    # block pairs (p, q), p <= q, where p holds members outside of the main group
    first = F.sequence(F.lit(0), F.least(F.col("at"), F.col("others") - 1))
    later = F.when(F.col("own") & (F.col("at") < F.col("others") + F.col("mains") - 1),
                   F.sequence(F.col("at") + 1, F.col("others") + F.col("mains") - 1)).otherwise(F.array().cast("array<int>"))
    member = member.select("cluster", "id", "root", "at", F.explode(F.concat(
        F.transform(first, lambda p: F.struct(p.alias("p"), F.col("at").alias("q"))),
        F.transform(later, lambda q: F.struct(F.col("at").alias("p"), q.alias("q"))))).alias("pair"))
    member = stored(spark, member.select("cluster", "id", "root", "at", "pair.p", "pair.q"), "members")

    def compare(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            key = np.stack([t.column(i).to_numpy() for i in range(3)], axis=1)
            start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else np.zeros(0, int)
            held = t.slice(int(start[-1])) if len(start) else None
            for lo, hi in zip(start[:-1], start[1:]):
                yield unite(t.slice(int(lo), int(hi - lo)))
        if held is not None and len(held):
            yield unite(held)

    def unite(t: pa.Table) -> pa.RecordBatch:
        p, q, at = t.column(1)[0].as_py(), t.column(2)[0].as_py(), t.column(5).to_numpy()
        left, right = np.flatnonzero(at == p), np.flatnonzero(at == q)
        out = []
        if len(left) and len(right):
            ids, root = t.column(3).to_pylist(), t.column(4).to_pylist()
            value = [np.frombuffer(x, np.uint64) for x in t.column(6).to_pylist()]
            n = np.array([len(x) for x in value])
            common = intersections(value, left, right)
            enough = den * common >= num * (n[left][:, None] + n[right][None, :] - common)
            up: dict[int, int] = {}
            for i, j in zip(*np.nonzero(enough)):
                x, y = int(left[i]), int(right[j])
                a, b = _top(up, root[x]), _top(up, root[y])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    dealt = member.join(ids, "id").select("cluster", "p", "q", "id", "root", "at", "shingles")
    dealt = dealt.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
    return stored(spark, dealt.mapInArrow(compare, "a long, b long"), "between")


def intersections(value: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``."""
    owner = np.repeat(np.arange(len(value)), [len(v) for v in value])
    _, cell, count = np.unique(np.concatenate(value), return_inverse=True, return_counts=True)
    shared = count[cell] > 1
    order = np.argsort(cell[shared], kind="stable")
    owner, cell = owner[shared][order], np.cumsum(count > 1)[cell[shared][order]] - 1
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(cell[-1]) + 1 if len(cell) else 0, columns):
        s, e = np.searchsorted(cell, [lo, lo + columns])
        m = np.zeros((len(value), columns), np.float32)
        m[owner[s:e], cell[s:e] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")
