"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping word windows of a few lengths. Their TF-IDF vectors
over hashed words, weighted by document frequencies of the whole corpus, are
projected on the right singular vectors of a TF-IDF matrix, which a
distributed randomised SVD finds: tasks multiply their passages by a random
matrix and by their own transpose, and the partial products are summed. Every
window of every document is projected and compared with the benchmark items by
cosine. What comes near enough is checked on the words themselves: the longest
common subsequence with the item within the window and a margin, and, for
paraphrases, that it holds the item's answer, its last sentence.

The SVD, document frequencies, candidates and checks cover all documents and
items.

Defined results: null or empty text is clean; null or wordless items and items
without id find nothing; items of equal text are all reported; equal documents
are reported each; an empty corpus gives no rows, an empty benchmark finds
nothing; further columns of the inputs are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import mix, release, slices, stored, table, utf8

BUCKETS = 1 << 14
RANK = 64
OVERSAMPLED = 8
#: Weight of an item's passage in the SVD for so many documents, in proportion
#: to all documents: the latent space has to tell the items apart in any corpus.
ITEM_WEIGHT = 20
DOCUMENTS = 600
#: Words of half a passage of the SVD, and the steps of its partial sums.
HALF = 24
FINE = 1 << 20
#: Words in a block; window lengths and the steps between their starts, in blocks.
BLOCK = 4
LENGTHS = ((5, 1), (9, 2), (13, 3))
#: Least cosine of a candidate, and least weighted share of the item's words it holds.
COSINE = 0.62
SHARE = 0.55
#: Common subsequence, as a share of the item: a copy, and a paraphrase that
#: holds this share of the answer too.
COPY = 0.85
PARAPHRASE = 0.6
ANSWER = 0.5
#: Longer items are cut into parts of so many words for the retrieval.
PART = 56
SLICE = 1 << 20


class Hasher:
    """Buckets of words, worked out for all words of a slice at once: with a
    random value for each byte and powers of an odd base modulo 2**64, the sum
    over a word is a difference of running sums, moved to the word's start."""

    _byte = np.random.default_rng(5).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _base = 0x9E3779B97F4A7C15
    _space = np.zeros(256, bool)
    _space[[9, 10, 11, 12, 13, 32]] = True
    _up = _down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n:
            def run(base: int) -> np.ndarray:
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)
            cls._up, cls._down = run(cls._base), run(pow(cls._base, -1, 1 << 64))
        return cls._up, cls._down

    @classmethod
    def buckets(cls, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words (runs without ASCII white space, A-Z lower-cased)
        of all texts in a row, and the offsets of the texts among them."""
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        space = cls._space[data]
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        out = np.zeros(len(start), np.int64)
        step = 1 << 16  # words at a time: the powers start again with each lot
        for at in range(0, len(start), step):
            s, e = start[at:at + step], end[at:at + step]
            lo, hi = int(s[0]), int(e[-1])
            up, down = cls._powers(hi - lo)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(cls._byte[data[lo:hi]] * up[:hi - lo], out=sums[1:])
            h = mix((sums[e - lo] - sums[s - lo]) * down[s - lo])
            out[at:at + step] = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        return out, np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return Hasher.buckets(texts)


def _omega() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, RANK + OVERSAMPLED)).astype(np.float32)


def hashed_words(docs: DataFrame) -> DataFrame:
    """One pass over all texts, stored: ``cells``, the buckets of each text's
    words as 16-bit numbers, and for each task rows (bucket, n) of how many of
    its documents hold a bucket (bucket -1: documents)."""
    def run(batches):
        names, total, n = ["cells", "bucket", "n"], np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            texts = utf8(b.column(0))
            n += len(texts)
            for lo, hi in slices(texts, SLICE, 300):
                cell, offsets = _buckets(texts[lo:hi])
                seen = np.zeros((hi - lo, BUCKETS), bool)
                seen[np.repeat(np.arange(hi - lo), np.diff(offsets)), cell] = True
                total += np.count_nonzero(seen, axis=0)
                cell = cell.astype("<u2").tobytes()
                rows = [cell[2 * s:2 * e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.binary()), *(pa.nulls(hi - lo, pa.int64()) for _ in range(2))], names)
            release()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some) + 1, pa.binary()), pa.array(np.append(some, -1)),
                                          pa.array(np.append(total[some], n))], names)

    return stored(docs.sparkSession, docs.select("text").mapInArrow(run, "cells binary, bucket long, n long"), "svd-cells")


def document_frequency(hashed: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of each bucket, over the whole corpus, and all documents."""
    rows = hashed.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(BUCKETS), 0
    for r in rows:  # at most BUCKETS + 1
        if r.bucket < 0:
            n = r.n
        else:
            out[r.bucket] = r.n
    return out, n


def _passages(cell: np.ndarray, offsets: np.ndarray, size: int):
    """Word ranges of passages of ``size`` words, half overlapping."""
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        for at in range(int(lo), max(int(lo) + 1, int(hi) - size // 2), size // 2):
            if at < hi:
                yield at, min(int(hi), at + size)


def _grid(cell: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half passages (halves x HALF buckets, filled up with BUCKETS), the first
    half of each passage, and the passages' half overlapping rows of buckets."""
    n = np.diff(offsets)
    halves = np.where(n > 0, np.maximum(2, -(-n // HALF)), 0)
    first = np.cumsum(halves) - halves
    out = np.full(int(halves.sum()) * HALF, BUCKETS, np.int64)
    out[np.arange(len(cell)) + np.repeat(first * HALF - offsets[:-1], n)] = cell
    out = out.reshape(-1, HALF)
    last = np.zeros(len(out), bool)
    last[(first + halves - 1)[halves > 0]] = True
    at = np.flatnonzero(~last)
    return out, at, np.concatenate([out[at], out[at + 1]], axis=1)


def _product(total: np.ndarray, right: np.ndarray, idf: np.ndarray, cell: np.ndarray, offsets: np.ndarray) -> None:
    """Adds A'(A right) to ``total`` (BUCKETS + 1 rows), where A are the unit
    TF-IDF vectors of the texts' passages; ``right`` is weighted by ``idf``."""
    half, at, rows = _grid(cell, offsets)
    if not len(at):
        return
    # lengths: equal buckets of a passage stand together and add up before they are squared
    order = np.sort(rows, axis=1).ravel()
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    new[::rows.shape[1]] = True
    run = np.flatnonzero(new)
    weight = np.add.reduceat(idf[order], run)
    norm = np.add.reduceat(weight * weight, np.searchsorted(run, np.arange(0, len(order), rows.shape[1])))
    norm = np.maximum(1e-9, np.sqrt(norm))
    sums = np.zeros((len(half), right.shape[1]), np.float32)
    for lo in range(0, len(half), 2048):
        sums[lo:lo + 2048] = right[half[lo:lo + 2048]].sum(axis=1)
    y = (sums[at] + sums[at + 1]) / (norm * norm)[:, None].astype(np.float32)
    back = np.zeros_like(sums)  # what the words of a half get, from both its passages
    back[at] += y
    back[at + 1] += y
    flat = half.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    flat = flat[order]
    for lo in range(0, len(flat), 1 << 16):
        c = flat[lo:lo + (1 << 16)]
        start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        part = np.add.reduceat(back[order[lo:lo + (1 << 16)] // HALF], start, axis=0)
        total[c[start]] += part * idf[c[start]][:, None]


def randomised_svd(hashed: DataFrame, items: list[bytes], idf: np.ndarray, n: int) -> np.ndarray:
    """(BUCKETS x RANK) right singular vectors of the passages' TF-IDF matrix A.

    One product A'(A omega) over all ``n`` documents and the items, whose
    partial sums are rows (bucket, vector) of whole numbers, so that any order
    gives the same. From it and omega alone the vectors of A'A follow (the
    single-pass form for a positive semidefinite matrix); that is small and local."""
    spark, width = hashed.sparkSession, RANK + OVERSAMPLED
    cells = hashed.where("cells IS NOT NULL").select("cells")
    idf = np.append(idf, 0.0)

    def weighted(right: np.ndarray) -> np.ndarray:
        return (np.vstack([right, np.zeros((1, width))]) * idf[:, None]).astype(np.float32)

    def product(right: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(right)

        def run(batches):
            total, m = np.zeros((BUCKETS + 1, width)), weighted(shared.value)
            for b in batches:
                rows = [x or b"" for x in b.column(0).to_pylist()]
                for lo, hi in slices(rows, 2 * SLICE // 8, 300):
                    offsets = np.append(0, np.cumsum([len(x) // 2 for x in rows[lo:hi]])).astype(np.int64)
                    _product(total, m, idf, np.frombuffer(b"".join(rows[lo:hi]), "<u2").astype(np.int64), offsets)
            total = np.rint(total[:-1] * FINE).astype(np.int64)
            some = np.flatnonzero(total.any(axis=1))
            for at in range(0, len(some), 2048):
                part = some[at:at + 2048]
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.ascontiguousarray(total[part, j])) for j in range(width))],
                                                 ["bucket", *(f"v{j}" for j in range(width))])
            release()

        own = np.zeros((BUCKETS + 1, width))
        _product(own, weighted(right), idf, *_buckets(items))
        out = ITEM_WEIGHT * n / DOCUMENTS * own[:-1]
        rows = cells.mapInArrow(run, "bucket long, " + ", ".join(f"v{j} long" for j in range(width)))
        for r in rows.groupBy("bucket").agg(*(F.sum(f"v{j}") for j in range(width))).toLocalIterator():  # at most BUCKETS rows
            out[r[0]] += np.array(r[1:], np.float64) / FINE
        return out

    return _from_sketch(product(_omega()), _omega().astype(np.float64))


def _from_sketch(y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Leading vectors of a positive semidefinite G, from y = G omega."""
    shift = 1e-7 * np.linalg.norm(y)  # keeps the small core matrix regular
    y = y + shift * omega
    core = omega.T @ y
    value, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = value > 1e-12 * max(value.max(), 1e-300)
    root = y @ (vectors[:, kept] / np.sqrt(value[kept]))
    found = np.linalg.svd(root, full_matrices=False)[0][:, :RANK]
    out = np.zeros((len(y), RANK))
    out[:, :found.shape[1]] = found
    return out.astype(np.float32)


class Items:
    """Benchmark items and what finding and checking them needs."""

    def __init__(self, rows: list[tuple[int, str]], basis: np.ndarray, idf: np.ndarray):
        self.table = (basis * idf[:, None]).astype(np.float32)
        self.table = np.vstack([self.table, np.zeros((1, RANK), np.float32)])
        self.ids = [i for i, _ in rows]
        self.words = [t.encode().lower().split() for _, t in rows]
        self.answers = [_answer(t) for _, t in rows]
        self.masks = [_masks(w) for w in self.words]
        self.parts = [[] for _ in LENGTHS]  # (item, from, to, vector) by window length
        for i, words in enumerate(self.words):
            cell = _buckets([b" ".join(words)])[0]
            cuts = -(-len(words) // PART)
            for lo, hi in zip((len(words) * j // cuts for j in range(cuts)), (len(words) * (j + 1) // cuts for j in range(cuts))):
                v = self.table[cell[lo:hi]].sum(axis=0)
                if (size := np.sqrt((v * v).sum())) > 0:
                    k = next((k for k, (blocks, _) in enumerate(LENGTHS) if hi - lo <= blocks * BLOCK * 1.15), len(LENGTHS) - 1)
                    self.parts[k].append((i, lo, hi, v / size))
        self.matrix = [np.array([p[3] for p in parts], np.float32).reshape(-1, RANK).T for parts in self.parts]
        # weights of each part's words by bucket, and their sums
        self.members = [np.zeros((len(parts), BUCKETS + 1), np.float32) for parts in self.parts]
        self.totals = [np.zeros(len(parts)) for parts in self.parts]
        for parts, member, total in zip(self.parts, self.members, self.totals):
            for k, (i, lo, hi, _) in enumerate(parts):
                cell = _buckets([b" ".join(self.words[i][lo:hi])])[0]
                member[k, cell] = idf[cell]
                total[k] = idf[cell].sum()


def _answer(text: str) -> list[bytes]:
    """Words of the last sentence; of the whole text if it is short."""
    parts = [p.split() for p in re.split(r"(?<=[.!?])\s+|\n+", text.lower().strip())]
    last = next((p for p in reversed(parts) if len(p) >= 3), None) or text.lower().split()
    return [w.encode() for w in last]


def _masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of the first."""
    full = (1 << size) - 1
    row = full
    for w in words:
        if m := masks.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return size - row.bit_count()


def check(items: Items, i: int, words: list[bytes], lo: int, hi: int) -> float:
    """Share of item ``i`` that is found around the words [lo, hi), 0 if that is too little."""
    size = len(items.words[i])
    margin = max(8, size - (hi - lo) + 8)
    around = words[max(0, lo - margin):hi + margin]
    share = common_subsequence(items.masks[i], size, around) / size
    if share >= COPY:
        return share
    if share >= PARAPHRASE:
        answer = items.answers[i]
        if common_subsequence(_masks(answer), len(answer), around) >= ANSWER * len(answer):
            return share
    return 0.0


def _search(items: Items, texts: list[bytes]):
    """For each text, found items with their shares."""
    found, offsets = _buckets(texts)
    size, split = np.diff(offsets), {}  # words themselves only where something is found
    # a gap behind each text, so that no window holds words of two texts
    blocks = -(-size // BLOCK)
    blocks += np.maximum(max(step for _, step in LENGTHS), LENGTHS[-1][0] - blocks)
    start = np.cumsum(blocks) - blocks
    n_blocks = int(blocks.sum())
    cell = np.full(n_blocks * BLOCK, BUCKETS, np.int64)
    n_words = int(size.sum())
    place = np.arange(n_words) + np.repeat(start * BLOCK - np.cumsum(size) + size, size)
    cell[place] = found
    out = [{} for _ in texts]
    if not n_words:
        return out
    sums = np.zeros((n_blocks + 1, RANK), np.float32)
    items.table[cell].reshape(n_blocks, BLOCK, RANK).sum(axis=1, out=sums[1:])
    np.cumsum(sums, axis=0, out=sums)
    for (length, step), parts, matrix, member, total in zip(LENGTHS, items.parts, items.matrix, items.members, items.totals):
        if not parts:
            continue
        v = sums[length::step] - sums[:-length:step]
        size = np.sqrt(np.einsum("ij,ij->i", v, v), dtype=np.float32)
        w, p = np.nonzero(v @ matrix >= np.maximum(COSINE * size, np.float32(1e-6))[:, None])
        # words of the part that the window and a block on either side hold, by weight
        for at in range(0, len(w), 20_000):
            j, k = w[at:at + 20_000] * step, p[at:at + 20_000]
            words = cell[np.clip((j[:, None] - 1) * BLOCK + np.arange((length + 2) * BLOCK), 0, len(cell) - 1)]
            weight = member[k[:, None], words].sum(axis=1)
            for x in np.flatnonzero(weight >= SHARE * total[k]).tolist():
                o = int(np.searchsorted(start, j[x], side="right")) - 1
                i, lo = parts[k[x]][0], (int(j[x]) - int(start[o])) * BLOCK
                if out[o].get(i, 0) < COPY:
                    if o not in split:
                        split[o] = texts[o].lower().split()
                    share = check(items, i, split[o], lo, min(len(split[o]), lo + length * BLOCK))
                    if share > out[o].get(i, 0):
                        out[o][i] = share
    return out


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, contaminated, item_ids, share): items found in each document, in
    order, and the largest share of one."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the benchmark is the stated query set
    asked = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    asked = sorted((r.i, r.t) for r in asked.where("i is not null and t is not null").distinct().collect() if r.t.split())
    hashed = hashed_words(rows)
    df, n = document_frequency(hashed)
    idf = np.log((n + 1) / (df + 1)) + 0.01
    basis = randomised_svd(hashed, [t.encode() for _, t in asked], idf, n)
    shared = spark.sparkContext.broadcast(Items(asked, basis, idf))

    def run(batches):
        items = shared.value
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in slices(texts, SLICE):
                found = _search(items, texts[lo:hi])
                ids = [sorted({items.ids[i] for i, s in f.items() if s > 0}) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([bool(x) for x in ids]), pa.array(ids, pa.list_(pa.int64())),
                     pa.array([max(f.values(), default=0.0) for f in found], pa.float64())], [id_col, "contaminated", "item_ids", "share"])
            release()

    return rows.mapInArrow(run, f"{id_col} {kind}, contaminated boolean, item_ids array<long>, share double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items found in them."""
    found = find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.where("contaminated")
