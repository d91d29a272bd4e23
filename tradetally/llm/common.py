"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tradetally.session import checkpoint_dir

#: Documents are handled in slices of about this many bytes inside a task.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``."""
    return checkpoint_dir(spark)


def stored(spark: SparkSession, df: DataFrame, name: str, with_path: bool = False):
    """``df`` written as a table of the shared folder and read again: a lost
    executor costs its running tasks only, and what follows starts from files.
    With ``with_path`` also the table's path, for ``dropped``."""
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return (back, path) if with_path else back


def dropped(spark: SparkSession, *paths: str) -> None:
    """Removes tables that ``stored`` has written, once nothing reads them."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """``rows`` with the row of ``per_key`` for their keys, which are never
    null; its column ``n`` counts the rows of the key. Keys that hold at least
    1/``most`` of all rows, of which there are at most ``most``, are broadcast;
    all other keys are small and joined by key."""
    total = per_key.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * most >= total
    hot = F.broadcast(per_key.where(often))
    rare = rows.join(F.broadcast(per_key.where(often).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rare.join(per_key.where(~often), keys))


def release() -> None:
    """Hands freed memory back to the system: Python workers live on between
    stages, and what they keep would add up."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other systems have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pooled() -> None:
    """Lets a task in Python take arrays of a few megabytes from memory that it
    already holds: fresh pages cost more than the arithmetic on them."""
    with suppress(OSError, AttributeError):  # other systems have no such call
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)  # arrays from here on get pages of their own
        libc.mallopt(-1, 32 << 20)  # what may stay unused at the heap's end


def text_once(docs: DataFrame, text_col: str, kept: list[str]) -> tuple[DataFrame, int, int]:
    """``docs`` with the columns ``kept`` and its text as a string, for a task
    in Python that must not get the text twice: the frame, the place of the
    text, and the place from which the kept columns follow."""
    if text_col in kept and docs.schema[text_col].dataType == StringType():
        return docs.select(*kept), kept.index(text_col), 0
    return docs.select(F.col(text_col).cast("string").alias("_read"), *kept), 0, 1


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The schema of ``df`` with further fields of the given SQL types."""
    more = df.sparkSession.range(0).select(*[F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
    return StructType(df.schema.fields + more.schema.fields)


def fold(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo ``modulus`` (null: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def utf8(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES, rows: int = 2000):
    """(from, to) index ranges of ``texts`` of about ``limit`` bytes or of ``rows`` texts."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i + 1 - at >= rows:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of all
    texts in a row, and the offsets of the texts among them."""
    words = [t.split() for t in texts]
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, offsets[-1]), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(h: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive values, by doubling."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mask = (1 << 64) - 1
    out, done, power, span, level = np.zeros(n, np.uint64), 0, 1, 1, h
    while True:
        if size & span:
            out += level[done:done + n] * np.uint64(power)
            power, done = power * pow(base, span, 1 << 64) & mask, done + span
        if span * 2 > size:
            return mix(out)
        level = level[:-span] + level[span:] * np.uint64(pow(base, span, 1 << 64))
        span *= 2


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of all runs of ``size`` consecutive values."""
    if len(x) < size:
        return x[:0]
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = size - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sample_of(labelled: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """(id_col, label_col) of about ``per_label`` rows of each label, chosen by
    a hash of the id, and never more than twice as many in all."""
    counts = labelled.groupBy(label_col).count().collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(label_col) == r[0], F.lit(per_label / r["count"])).otherwise(share)
    lot = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(1 << 30)) / F.lit(1 << 30)
    return labelled.select(id_col, label_col).where(lot < share).limit(2 * per_label * max(1, len(counts)))


def rows_of(rows: DataFrame, chosen: DataFrame, id_col: str, text_col: str, per_id: int = 8) -> DataFrame:
    """``rows`` of the ``chosen`` ids (unique, a bounded number) with the columns
    of ``chosen``: all different rows of an id that has up to ``per_id`` rows, and
    about so many of one that has more, chosen by a hash of the text. So what a
    bounded sample of ids brings to the driver is bounded in rows, too; equal
    rows are brought once, made one in the tasks that read them."""
    ids = rows.select(id_col).join(F.broadcast(chosen.select(id_col)), id_col)
    share = ids.groupBy(id_col).agg((F.lit(float(per_id)) / F.count(F.lit(1))).alias("_share"))
    lot = F.pmod(F.xxhash64(F.col(text_col), F.lit(4)), F.lit(1 << 30)) / F.lit(1 << 30)
    few = rows.join(F.broadcast(chosen.join(F.broadcast(share), id_col)), id_col)
    return few.where(lot < F.col("_share")).drop("_share").distinct()


class Adam:
    """Adam steps for a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9 ** self.t), self.v[k] / (1 - 0.999 ** self.t)
            self.p[k] -= self.rate * m / (np.sqrt(v) + 1e-8)
