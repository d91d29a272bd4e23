"""Compression of vectors into product codes, with adaptive distance bounds.

Components become integers, ``floor(256 * x)``, and a vector is cut into
``PARTS`` equal parts. Each part position has a codebook of ``ENTRIES``
entries, which starts as that part of the smallest vec_ids and is moved by
``ROUNDS`` rounds of nearest assignment and componentwise ``floor(sum / count)``.

The first assignment measures every part against all entries and stores, for
each part, its ``b`` closest entries, a lower bound of the distance to each of
them after the first, and one outer bound for all others. When entries move,
bounds shrink by the distance their entry has moved, the outer one by the
largest move of the codebook. A part whose own entry is, measured in integers,
nearer than all its bounds stays where it is. Otherwise the stored entries are
measured, again in integers, as long as the outer bound shows that no other
can win, and all entries where it does not. Bounds are rounded down, and only
strict inequalities decide, so that ties always go to the lower index and all
results are those of plain assignment. ``b`` adapts: it starts at a quarter of
the entries, and later every slice of rows stores as many as all but
1/``SPARE`` of its parts had to measure, an eighth of the entries at least.

Tasks send one row a used entry (sums and count); only the codebooks, whose
size is fixed by the vector length, pass the driver. Each round reads what the
round before has stored, and that table goes once the next one is written.

Defined results: rows whose vector is null or holds a null or non-finite
component are dropped; equal ids and rows are coded each; among equal smallest
ids the vectors decide, null ids come last; shorter vectors are padded with
zeros at the end, up to the longest length, rounded up to a multiple of
``PARTS``; fewer rows than entries give so many entries; components beyond
+-2**25 after scaling count as +-2**25; a label sum beyond 64 bits is null; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import dropped, join_counted, stored, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, LIMIT = 256.0, 1 << 25
#: Vectors handled at a time inside a task.
ROWS = 1024
#: So many parts in one may need more entries than are stored for it.
SPARE = 20

Books = np.ndarray  # part, entry, position in the part: int64


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, ints) of the rows that take part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = F.col(vector_col).cast("array<double>")
    scaled = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(
        F.lit(float(LIMIT)), x * SCALE))).cast("int"))
    return df.where(v.isNotNull() & ~F.exists(v, odd)).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), scaled.alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of int64, padded with zeros to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(n) and n.min() == n.max() == width:
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact in int64; by a floating
    product where no step of it can exceed 2**53."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:
        f, g = x.astype(float), book.astype(float)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - book[:, j]) ** 2
    return out


def _below(squared: np.ndarray) -> np.ndarray:
    """Roots as half floats, rounded down."""
    r = np.minimum(np.sqrt(np.maximum(squared, 0).astype(float)), 65504.0)
    return _less(r)


def _less(r: np.ndarray) -> np.ndarray:
    """The half float at or below each value, at least 0."""
    r = np.clip(r, 0, 65504.0)
    h = r.astype(np.float16)
    return np.where(h.astype(float) > r, np.nextafter(h, np.float16(0)), h).astype(np.float16)


def nearest(d: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distances to all entries: the ``b`` closest in order of distance and
    index, lower bounds of theirs, and one of all the others."""
    order = np.argsort(d, axis=1, kind="stable")
    by = np.take_along_axis(d, order[:, :b + 1], 1)
    outer = _below(by[:, b]) if d.shape[1] > b else np.full(len(d), np.inf, np.float16)
    return order[:, :b].astype(np.uint8), _below(by[:, :b]), outer


def moved(x: np.ndarray, book: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray,
          drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New nearest entries of one part position after its entries have moved:
    the squared distance to the first, entries, bounds, outer bounds, and how
    many stored entries each row had to measure."""
    had = near.shape[1]
    low = _less(low.astype(float) - drift[near])
    outer = _less(outer.astype(float) - drift.max(initial=0)) if len(book) > had else outer
    best = ((x - book[near[:, 0]]) ** 2).sum(1)
    # strictly nearer, with room for the rounding of the root
    above = np.sqrt(best.astype(float)) * (1 + 1e-12) + 1e-9
    needed = 1 + (low[:, 1:] <= above[:, None]).sum(1)
    far = above < outer
    near, outer = near.copy(), outer.copy()
    some = np.flatnonzero(far & (needed > 1))
    if len(some):
        seen = near[some]
        d = ((x[some, None, :] - book[seen]) ** 2).sum(2)
        at = np.lexsort((seen, d), axis=1)
        near[some], d = np.take_along_axis(seen, at, 1), np.take_along_axis(d, at, 1)
        best[some], low[some] = d[:, 0], _below(d)
    every = np.flatnonzero(~far)
    if len(every):
        d = distances(x[every], book)
        near[every], low[every], outer[every] = nearest(d, had)
        best[every] = d[np.arange(len(every)), near[every][:, 0]]
        needed[every] = had
    return best, near, low, outer, needed


def adapted(near: np.ndarray, low: np.ndarray, outer: np.ndarray, needed: np.ndarray,
            least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stored entries cut to what nearly all parts of a slice needed; those
    that go join the others behind the outer bound."""
    b = max(least, int(np.quantile(needed, 1 - 1 / SPARE, method="higher")))
    if b >= near.shape[2]:
        return near, low, outer
    return near[:, :, :b], low[:, :, :b], np.minimum(outer, low[:, :, b:].min(2))


def _assign(frame: DataFrame, books: Books, drift: np.ndarray | None, last: bool) -> DataFrame:
    """One assignment: rows with their codes and bounds (the last one: codes
    and errors), and a row for each entry's sums in each task."""
    width, entries = PARTS * books.shape[2], books.shape[1]
    first, least = max(1, entries // 4), max(1, entries // 8)

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of rows that store equally many entries."""
        if drift is None:
            yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))
            return
        sizes = np.array([len(r) for r in batch["near"].to_pylist()])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            yield from (batch.take(pa.array(at[i:i + ROWS])) for i in range(0, len(at), ROWS))

    def read(part: pa.RecordBatch, name: str, kind: type, shape: tuple) -> np.ndarray:
        return np.frombuffer(b"".join(part[name].to_pylist()), kind).reshape(shape)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for part in pieces(batch):
                n = part.num_rows
                x = _matrix(part["ints"], width).reshape(n, PARTS, -1)
                best = np.zeros((n, PARTS), np.int64)
                if drift is None:
                    near, low = np.zeros((n, PARTS, first), np.uint8), np.zeros((n, PARTS, first), np.float16)
                    outer = np.zeros((n, PARTS), np.float16)
                    for p in range(PARTS):
                        d = distances(x[:, p], books[p])
                        near[:, p], low[:, p], outer[:, p] = nearest(d, first)
                else:
                    near, low = (read(part, c, kind, (n, PARTS, -1)).copy()
                                 for c, kind in (("near", np.uint8), ("low", np.float16)))
                    outer = read(part, "outer", np.float16, (n, PARTS)).copy()
                    needed = np.zeros((n, PARTS), np.int64)
                    for p in range(PARTS):
                        best[:, p], near[:, p], low[:, p], outer[:, p], needed[:, p] = moved(
                            x[:, p], books[p], near[:, p], low[:, p], outer[:, p], drift[p])
                code = np.ascontiguousarray(near[:, :, 0])
                if not last:
                    for p in range(PARTS):
                        np.add.at(sums[p], code[:, p], x[:, p])
                        counts[p] += np.bincount(code[:, p], minlength=entries)
                    if drift is not None:
                        near, low, outer = adapted(near, low, outer, needed, least)
                if last:
                    yield pa.RecordBatch.from_arrays(
                        [part["vec_id"], part["label"], pa.array([c.tobytes() for c in code], pa.binary()),
                         pa.array(best.sum(1))], ["vec_id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part["vec_id"], part["label"], part["ints"],
                         *[pa.array([r.tobytes() for r in v], pa.binary()) for v in (near, low, outer)],
                         *[pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]],
                        names)
        if not last:
            p, e = np.nonzero(counts)
            k = len(p)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, t) for t in (*own, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())]
                + [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]),
                   pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names)

    names = ["vec_id", "label", "ints", "near", "low", "outer", "part", "entry", "count", "sums"]
    from pyspark.sql.pandas.types import to_arrow_type
    own = [to_arrow_type(frame.schema[c].dataType) for c in ("vec_id", "label")]
    kinds = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    if last:
        return frame.mapInArrow(task, f"{kinds}, code binary, error long")
    return frame.mapInArrow(task, f"{kinds}, ints array<int>, near binary, low binary, outer binary, part int, "
                                  "entry int, count long, sums array<long>")


def _updated(done: DataFrame, books: Books) -> tuple[Books, np.ndarray]:
    """New codebooks and how far each entry has moved (rounded up)."""
    width = books.shape[2]
    sums = done.where("part IS NOT NULL").groupBy("part", "entry").agg(
        F.sum("count").alias("n"),
        *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]).collect()
    new = books.copy()
    for r in sums:
        new[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return new, np.sqrt(((new - books) ** 2).sum(2).astype(float)) * (1 + 1e-12)


def codes(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
          label_col: str = "label") -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error) of every kept row, the code as one byte a
    part, and the final codebooks."""
    rows = kept_vectors(df, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).collect()
    if not first:
        none = rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.limit(0), np.zeros((PARTS, 0, 0), np.int64)
    longest = rows.agg(F.max(F.size("ints"))).first()[0]
    width = -(-longest // PARTS)
    books = np.zeros((len(first), PARTS * width), np.int64)
    for i, r in enumerate(first):
        books[i, :len(r.ints)] = r.ints
    books = np.ascontiguousarray(books.reshape(len(first), PARTS, width).transpose(1, 0, 2))
    drift, frame, path = None, rows, None
    for r in range(ROUNDS):
        done, at = stored(spark, _assign(frame, books, drift, last=False), f"op12-round-{r}", with_path=True)
        if path:
            dropped(spark, path)
        books, drift = _updated(done, books)
        frame, path = done.where("part IS NULL"), at
    done = stored(spark, _assign(frame, books, drift, last=True), "op12-codes")
    dropped(spark, path)
    return done, books


def digest(books: Books) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, books = codes(spark, table(spark, sf_dir, "embeddings"))
    # equal labels: partial sums first; a label's one row then goes to all rows that hold it
    named = F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("of")
    totals = done.groupBy(*named).agg(F.expr("try_cast(sum(CAST(error AS DECIMAL(38,0))) AS BIGINT)").alias("label_error"),
                                      F.count("*").alias("n"))
    done = done.select("*", *named)
    joined = join_counted(done, totals, ["none", "of"])
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                         F.lit(digest(books)).alias("codebooks_sha256"))


def _assign_sql(books: str, out: str) -> str:
    return f"""{out} AS (SELECT vec_id, label, row, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT v.vec_id, v.label, v.row, v.p, b.e,
        list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.c[i]) * (v.x[i] - b.c[i]))) AS d
    FROM parts v JOIN {books} b USING (p)) GROUP BY ALL)"""


def _move_sql(books: str, found: str, out: str) -> str:
    return f"""{out}_s AS (SELECT p, e, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c FROM (
    SELECT f.p, f.e, unnest(v.x) AS c, generate_subscripts(v.x, 1) AS i FROM {found} f JOIN parts v USING (row, p)) GROUP BY ALL),
{out}_l AS (SELECT p, e, list(c ORDER BY i) AS c FROM {out}_s GROUP BY p, e),
{out} AS (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM {books} b LEFT JOIN {out}_l n USING (p, e))"""


ORACLE_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
        row_number() OVER (ORDER BY vec_id) AS row
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, row, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x
    FROM kept, range({PARTS}) t(p)),
b0 AS (SELECT p, row - 1 AS e, x AS c FROM parts WHERE row <= {ENTRIES}),
{_assign_sql("b0", "a0")},
{_move_sql("b0", "a0", "b1")},
{_assign_sql("b1", "a1")},
{_move_sql("b1", "a1", "b2")},
{_assign_sql("b2", "a2")},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
coded AS (SELECT vec_id, label, row, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code,
    CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books"""
