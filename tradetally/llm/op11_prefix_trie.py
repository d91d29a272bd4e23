"""Prefix trie of rebuilt conversations, screened by a count-min sketch.

Prefixes are named by digests that add up: with four lanes modulo ``PRIME``,
the digest of a turn sequence is the sum of its turns' hashes times powers of a
base by place. A range sort of all turns deals even one huge conversation over
many tasks; each task sums from zero, and one small row a task carries the
count and sum of the conversation that crosses its border. Rebuilding shifts
and adds digests, so texts are hashed once and never shuffled.

Every prefix of every rebuilt conversation is counted in a count-min sketch
whose counters saturate at two. An estimate of one proves that no other
conversation shares the prefix. Behind the first proven prefix of a
conversation all nodes are its own: these tails are emitted where they lie.
Only prefixes that may be shared, and the first proven one, which looks for
its parent, are shuffled and grouped exactly.

Sums over subtrees need no walk: nodes with the same smallest member form one
path to that conversation's end, and the subtree of a node is the sum of whole
paths of its members less what lies above the node on its own path. So two
groupings by digest and one running sum along paths give all results. Keys
that hold a large share of the rows, of which there are few, are joined by
broadcast (``common.join_counted``); all groupings sum in the tasks
first. Members that end at a node are sorted by range, written as pieces of a
bounded size and hashed piece by piece, as SHA-256 itself goes in order.

The sketch has ``LANES`` rows of four counters a prefix, ``MOST_COUNTERS`` at
most: beyond that it proves less, more prefixes are grouped exactly, and
results stay the same.

Defined results: rows without conv_id are ignored; null role or text counts as
empty; turns of equal number are ordered by the MD5 of role and text, equal
rows are turns of their own; % keeps the sign of the id, as in SQL; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import dropped, join_counted, mix, stored, table

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_009, 22_695_477, 134_775_813)
FAMILY, HEADS = 100, 6
#: Rows of the sketch, and the most counters in each.
LANES, MOST_COUNTERS = 3, 1 << 22
BLOCK = 1 << 16
#: Bytes of a piece of listed ids.
PIECE = 1 << 20

_B = np.array(BASES, np.uint64)
_P = np.uint64(PRIME)
_MASK = np.uint64(PRIME)  # 31 ones


def powers(e: np.ndarray) -> np.ndarray:
    """Powers of the bases, one row an exponent (0 or more)."""
    out = np.ones((len(e), len(BASES)), np.uint64)
    e, b = e.astype(np.uint64), _B.copy()
    while e.any():
        odd = (e & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * b % _P
        e, b = e >> np.uint64(1), b * b % _P
    return out


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four lanes as two 62-bit values."""
    x = x.astype(np.int64)
    return x[:, 0] << 31 | x[:, 1], x[:, 2] << 31 | x[:, 3]


def lanes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    return np.stack([a >> np.uint64(31), a & _MASK, b >> np.uint64(31), b & _MASK], 1)


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(groups: np.ndarray, before: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows begin a group, and for each row the place of its group's
    first row here; rows of ``before`` go on from an earlier batch."""
    new = np.ones(len(groups), bool)
    new[1:] = groups[1:] != groups[:-1]
    at = np.maximum.accumulate(np.where(new, np.arange(len(groups)), 0))
    if before is not None:
        new[0] = groups[0] != before
    return new, at


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefix digests of sorted turns, as if each task's first
    conversation began there."""
    part = TaskContext.get().partitionId()
    conv, n, total = None, 0, np.zeros(len(BASES), np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = _long(batch, "conv_id")
        x = np.frombuffer(b"".join(batch["x"].to_pylist()), ">u4").reshape(-1, len(BASES)).astype(np.uint64) % _P
        new, at = _starts(groups, conv)
        pos = np.arange(len(groups)) - at + 1
        more = (at == 0) & (not new[0])  # rows of the conversation under way
        pos[more] += n
        term = x * powers(pos) % _P
        sums = np.concatenate([np.zeros((1, len(BASES)), np.uint64), np.cumsum(term, 0, dtype=np.uint64)])
        p = (sums[1:] - sums[at]) % _P
        p[more] = (p[more] + total) % _P
        q = (p + _P - term) % _P
        conv, n, total = int(groups[-1]), int(pos[-1]), p[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(groups), part, np.int32)), pa.array(groups), pa.array(pos),
             *map(pa.array, packed(p)), *map(pa.array, packed(q)), batch["chars"].cast(pa.int64())],
            ["part", "conv_id", "pos", "p1", "p2", "q1", "q2", "chars"])


_PLACED = "part int, conv_id long, pos long, p1 long, p2 long, q1 long, q2 long, chars long"


def _carried(found: list) -> dict[int, tuple]:
    """What each task's first conversation has counted in earlier tasks:
    {part: (conv_id, places, lanes)}; ``found`` has (part, first, last, places
    of the last one, its digest) a task, in order."""
    out, state = {}, None
    for part, first, last, pos, a, b in found:
        own = lanes(np.array([a]), np.array([b]))[0]
        if state and state[0] == first:
            out[part] = state
        if last == first and part in out:
            own = (state[2] + powers(np.array([state[1]]))[0] * own) % _P
            pos += state[1]
        state = (last, pos, own)
    return out


def placed(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """(conv_id, pos, digests of the prefix to this turn and before it, chars)
    of all turns, and the path of the stored table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = df.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("x"),
        F.length(text).alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("x"), F.col("row")]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "x", "chars")
    done, path = stored(spark, turns.mapInArrow(_summed, _PLACED), "op11-turns", with_path=True)
    ends = done.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", "p1", "p2")).alias("e"))
    carried = _carried([(r.part, r["first"], *r.e) for r in sorted(ends.collect(), key=lambda r: r.part)])
    if not carried:
        return done, path

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv = _long(batch, "part"), _long(batch, "conv_id")
            pos, cols = _long(batch, "pos").copy(), {c: _long(batch, c) for c in ("p1", "p2", "q1", "q2")}
            for k in np.unique(part):
                if int(k) not in carried:
                    continue
                of, n, total = carried[int(k)]
                at = (part == k) & (conv == of)
                pos[at] += n
                up = powers(np.array([n]))[0]
                for a, b in (("p1", "p2"), ("q1", "q2")):
                    moved = packed((lanes(cols[a][at], cols[b][at]) * up + total) % _P)
                    cols[a], cols[b] = cols[a].copy(), cols[b].copy()
                    cols[a][at], cols[b][at] = moved
            yield pa.RecordBatch.from_arrays(
                [batch["part"], batch["conv_id"], pa.array(pos), *map(pa.array, cols.values()), batch["chars"]],
                batch.schema.names)

    return done.mapInArrow(carry, _PLACED), path


def rebuilt(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """A row a conversation (conv_id, len) and a row for each of its prefixes."""
    first = range(1, HEADS)
    convs = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"),
        *[F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{c}_{i}") for i in first for c in ("p1", "p2", "chars")])
    arrays = [F.array(F.lit(0).cast("long"), *[f"{c}_{i}" for i in first]).alias(c) for c in ("p1", "p2", "chars")]
    convs, at_convs = stored(spark, convs.select("conv_id", "n", *arrays), "op11-conversations", with_path=True)
    own = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"),
                        *[F.col(c).alias(f"base_{c}") for c in ("p1", "p2", "chars")])
    own = own.join(base, "base", "left")
    k = F.least(F.col("h"), F.coalesce("base_n", F.lit(0))).cast("int")
    zero = F.lit(0).cast("long")
    own = own.withColumn("k", k).select(
        "conv_id", "n", "h", "k", (F.col("k") + F.greatest(zero, F.col("n") - F.col("h"))).alias("len"),
        *[F.coalesce(F.get("p" + i, F.col("h")), zero).alias("own" + i) for i in "12"],
        *[F.coalesce(F.get("base_p" + i, F.col("k")), zero).alias("head" + i) for i in "12"],
        "base_p1", "base_p2", "base_chars")
    own, at_own = stored(spark, own, "op11-rebuilt", with_path=True)
    heads = own.where("k > 0").withColumn("depth", F.explode(F.sequence(F.lit(1), F.col("k")))).select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.get("base_p1", F.col("depth")).alias("p1"), F.get("base_p2", F.col("depth")).alias("p2"),
        F.get("base_p1", F.col("depth") - 1).alias("q1"), F.get("base_p2", F.col("depth") - 1).alias("q2"),
        F.get("base_chars", F.col("depth")).alias("chars"), "len")
    rest = turns.select("conv_id", "pos", "p1", "p2", "q1", "q2", "chars")
    short = own.where("n > h").select("conv_id", "n", "h", "k", "len", "own1", "own2", "head1", "head2")
    rest = join_counted(rest, short, ["conv_id"]).where("pos > h")
    back = [pow(b, -1, PRIME) for b in BASES]
    shifts = np.array([[pow(i, s, PRIME) for i in back] for s in range(HEADS)], np.uint64)

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: _long(batch, name) for name in batch.schema.names}
            by, head, mine = shifts[c["h"] - c["k"]], lanes(c["head1"], c["head2"]), lanes(c["own1"], c["own2"])
            made = [packed((head + (lanes(c[x + "1"], c[x + "2"]) + _P - mine) % _P * by) % _P) for x in "pq"]
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], pa.array(c["pos"] - c["h"] + c["k"]), *map(pa.array, made[0] + made[1]),
                 batch["chars"], batch["len"]], ["conv_id", "depth", "p1", "p2", "q1", "q2", "chars", "len"])

    kinds = "conv_id long, depth long, p1 long, p2 long, q1 long, q2 long, chars long, len long"
    prefixes = rest.mapInArrow(shifted, kinds).unionByName(heads)
    prefixes, at_prefixes = stored(spark, prefixes, "op11-prefixes", with_path=True)
    return own.select("conv_id", "len"), prefixes, [at_convs, at_own, at_prefixes]


def slots(a: np.ndarray, b: np.ndarray, depth: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Counters of prefixes in each row of the sketch."""
    h = mix(a.view(np.uint64) + mix(b.view(np.uint64) + depth.astype(np.uint64)))
    for r in range(LANES):
        yield (mix(h + np.uint64(r + 1)) & np.uint64(width - 1)).astype(np.int64)


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """Bits of the counters that reach two, one row of ``width`` a lane."""
    names, kinds = ["lane", "block", "once", "twice"], "lane int, block int, once binary, twice binary"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((LANES, width), np.uint8)
        for batch in batches:
            for r, at in enumerate(slots(*(_long(batch, c) for c in ("p1", "p2", "depth")), width)):
                at, n = np.unique(at, return_counts=True)
                cells[r, at] = np.minimum(2, cells[r, at] + np.minimum(n, 2))
        size = min(BLOCK, width)
        for r in range(LANES):
            for k in range(width // size):
                some = cells[r, k * size:(k + 1) * size]
                if some.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r], pa.int32()), pa.array([k], pa.int32()),
                         *[pa.array([np.packbits(some >= t).tobytes()], pa.binary()) for t in (1, 2)]], names)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted blocks, one at a time in memory."""
        of, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([of[0]], pa.int32()), pa.array([of[1]], pa.int32()),
                 *[pa.array([x.tobytes()], pa.binary()) for x in (once, twice)]], names)

        for batch in batches:
            for lane, block, a, b in zip(*(batch[c].to_pylist() for c in names)):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if (lane, block) == of:
                    twice = twice | b | (once & a)
                    once = once | a
                    continue
                if of:
                    yield out()
                of, once, twice = (lane, block), a, b
        if of:
            yield out()

    blocks = prefixes.mapInArrow(counted, kinds).repartition("lane", "block").sortWithinPartitions("lane", "block")
    bits = np.zeros((LANES, max(1, width // BLOCK), min(BLOCK, width) // 8), np.uint8)
    for r in blocks.mapInArrow(merged, kinds).select("lane", "block", "twice").collect():
        bits[r.lane, r.block] = np.frombuffer(r.twice, np.uint8)
    return bits.reshape(LANES, -1)


def screened(spark: SparkSession, prefixes: DataFrame) -> tuple[DataFrame, str]:
    """All prefixes with ``tail``: proven to be of one conversation alone, and
    so the prefix before."""
    width = BLOCK
    total = prefixes.count()
    while width < min(4 * total, MOST_COUNTERS):
        width *= 2
    bits = spark.sparkContext.broadcast(sketch(prefixes, width))

    def alone(a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for row, at in zip(bits.value, slots(a, b, depth, width)):
            out |= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) == 0
        return out

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: _long(batch, name) for name in ("p1", "p2", "q1", "q2", "depth")}
            tail = (c["depth"] > 1) & alone(c["p1"], c["p2"], c["depth"]) & alone(c["q1"], c["q2"], c["depth"] - 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch[x] for x in ("conv_id", "depth", "p1", "p2", "chars", "len")), pa.array(tail)],
                ["conv_id", "depth", "p1", "p2", "chars", "len", "tail"])

    return stored(spark, prefixes.mapInArrow(
        screen, "conv_id long, depth long, p1 long, p2 long, chars long, len long, tail boolean"), "op11-screened", with_path=True)


NODE = ["depth", "p1", "p2"]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each node as comma-joined pieces of a bounded size."""
    part, piece = TaskContext.get().partitionId(), 0
    of, ids, size = None, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array([x], pa.int64()) for x in of), pa.array([part << 32 | piece], pa.int64()),
             pa.array([",".join(ids)], pa.string())], [*NODE, "place", "ids"])

    for batch in batches:
        for *node, conv in zip(*(batch[c].to_pylist() for c in (*NODE, "conv_id"))):
            if node != of or size > PIECE:
                if of:
                    yield out()
                    piece += 1
                of, ids, size = node, [], 0
            ids.append(str(conv))
            size += 21
    if of:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, one piece at a time."""
    of, sha = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array([x], pa.int64()) for x in of), pa.array([sha.hexdigest()])], [*NODE, "ends"])

    for batch in batches:
        for *node, ids in zip(*(batch[c].to_pylist() for c in (*NODE, "ids"))):
            if node == of:
                sha.update(b",")
            else:
                if of:
                    yield out()
                of, sha = node, hashlib.sha256()
            sha.update(ids.encode())
    if of:
        yield out()


def ends_of(members: DataFrame) -> DataFrame:
    """SHA-256 of each node's ascending ids."""
    order = [*NODE, "conv_id"]
    pieces = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _listed, "depth long, p1 long, p2 long, place long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "place").mapInArrow(
        _hashed, "depth long, p1 long, p2 long, ends string")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``w`` before each node on its path, from zero in each task."""
    part = TaskContext.get().partitionId()
    rep, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, w = _long(batch, "rep"), _long(batch, "w")
        new, at = _starts(groups, rep)
        sums = np.concatenate([[0], np.cumsum(w)])
        before = sums[:-1] - sums[at]
        before[(at == 0) & (not new[0])] += total
        rep, total = int(groups[-1]), int(before[-1] + w[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(w), part, np.int32)), *batch.columns, pa.array(before)],
            ["part", *batch.schema.names, "before"])


def along_paths(spark: SparkSession, nodes: DataFrame) -> tuple[DataFrame, str]:
    """``nodes`` (rep, depth, w and more) with ``before``: the sum of w above
    them on their path. Sorted by range, so that a long path takes many tasks."""
    nodes = nodes.repartitionByRange("rep", "depth").sortWithinPartitions("rep", "depth")
    kinds = "part int, " + ", ".join(f"`{n}` {k}" for n, k in nodes.dtypes) + ", before long"
    done, path = stored(spark, nodes.mapInArrow(_running, kinds), "op11-nodes", with_path=True)
    ends = done.groupBy("part").agg(F.min("rep").alias("first"), F.max(F.struct(
        "rep", "depth", (F.col("before") + F.col("w")).alias("sum"))).alias("e"))
    carried, state = [], None
    for r in sorted(ends.collect(), key=lambda r: r.part):
        more = state[1] if state and state[0] == r["first"] else 0
        if more:
            carried.append((r.part, r["first"], more))
        state = (r.e.rep, r.e.sum + (more if r.e.rep == r["first"] else 0))
    if carried:
        small = F.broadcast(spark.createDataFrame(carried, "part int, rep long, more long"))
        done = done.join(small, ["part", "rep"], "left").withColumn("before", F.col("before") + F.coalesce("more", F.lit(0)))
    return done, path


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("string"), 256)


def trie(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turn, role, text)."""
    turns, at_turns = placed(spark, df)
    convs, prefixes, paths = rebuilt(spark, turns)
    found, _ = screened(spark, prefixes)
    none = F.sha2(F.lit(""), 256)
    one = F.lit(1).cast("long")
    tails = found.where("tail").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), _sha(F.col("conv_id"))).otherwise(none).alias("ends_sha256"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("chars"), "len")
    shared, at_shared = stored(spark, found.where("NOT tail").drop("tail").unionByName(roots), "op11-shared", with_path=True)
    dropped(spark, at_turns, *paths)

    nodes = shared.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.max("len").alias("longest"))
    seen = join_counted(shared, stored(spark, nodes, "op11-grouped"), NODE)
    own, end = F.col("rep") == F.col("conv_id"), F.col("depth") == F.col("len")
    # nodes with the same smallest member: a path from depth ``top`` to the member's end
    path = seen.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.min(F.when(own, F.col("depth"))).alias("top"),
        F.coalesce(F.sum(F.when(own, (F.col("n") - 1) * F.col("chars"))), zero).alias("sum"),
        F.coalesce(F.max(F.when(end, (own & (F.col("longest") == F.col("depth"))).cast("long"))), one).alias("leaf"),
        F.max(F.when(~own, F.col("rep"))).alias("above"))
    seen = join_counted(shared, stored(spark, path, "op11-paths"), ["conv_id"])
    mine = F.col("top") <= F.col("depth")  # of the smallest member only
    nodes = seen.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("rep"), F.max("chars").alias("chars"),
        F.max(F.when(F.col("top") < F.col("depth"), F.col("conv_id")).when(
            F.col("top") == F.col("depth"), F.col("above"))).alias("parent_conv_id"),
        (F.sum((F.col("top") == F.col("depth") + 1).cast("long")).alias("kids")), F.sum("leaf").alias("n_leaves"),
        F.sum("sum").alias("sum"), F.max(F.when(mine, (F.col("len") > F.col("depth")).cast("long"))).alias("goes_on"))
    nodes = nodes.withColumn("w", (F.col("n_convs") - 1) * F.col("chars")).withColumn(
        "n_children", F.coalesce("kids", zero) + F.col("goes_on")).drop("kids", "goes_on", "chars")
    nodes, _ = along_paths(spark, nodes)
    nodes = nodes.join(ends_of(shared.where(end)), NODE, "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("sum") - F.col("before")).alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"))
    return tails.unionByName(nodes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark, table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
turns AS (SELECT conv_id, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor(list_reduce(list_prepend(4294967295,
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda c, s: xor(c >> 8, t[(xor(c, s) & 255) + 1])), 4294967295) % {HEADS} AS h
    FROM (SELECT DISTINCT conv_id FROM turns), bits),
heads AS (SELECT c.conv_id, t.pos AS depth, t.x, t.chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h),
lengths AS (SELECT c.conv_id, c.h, count(e.depth) AS k FROM convs c LEFT JOIN heads e USING (conv_id) GROUP BY ALL),
lists AS (SELECT * FROM heads UNION ALL
    SELECT l.conv_id, t.pos - l.h + l.k, t.x, t.chars FROM lengths l JOIN turns t ON t.conv_id = l.conv_id AND t.pos > l.h),
prefixes AS (SELECT conv_id, depth, chars, md5(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS d FROM lists
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
sized AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS len,
    lag(d) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM prefixes),
nodes AS (SELECT depth, d, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs,
    (count(*) - 1) * any_value(chars) AS w, max(len) = depth AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256
    FROM sized GROUP BY depth, d),
kids AS (SELECT depth - 1 AS depth, up AS d, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (SELECT s.depth, s.d, sum(n.w) AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves
    FROM nodes n JOIN sized s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
    CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.d = n.up
    LEFT JOIN kids k ON k.depth = n.depth AND k.d = n.d JOIN below b ON b.depth = n.depth AND b.d = n.d"""
