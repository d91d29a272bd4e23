"""Event tables that grow by small files, clustered by key (K2, K4, L1, L3).

Writers append small files to the table's folder. ``compact`` rewrites all events
that are there, range-sorted by (key, order columns), into few files below
``<folder>_sorted/<generation>/``: ``rows/``, the small files it holds (``covers/``)
and the least and greatest key of each file (``ranges/``). ``ranges/`` is written
last; a generation without it does not exist for readers, so a lost job changes
nothing. Readers take the last whole generation and the small files it does not
cover. A keyed read opens only files whose range holds the key.

Range bounds are taken over (key, order columns), so a key that holds a third of
all rows spans many files. Rows are kept as they are, repeated ones too.

Defined results: a folder that is not there is an empty table; rows without a key
are kept, and no keyed read returns them. One compaction or ``tidy`` of a table
runs at a time; appends may run beside them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE_BYTES = 128 << 20


class EventTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, order: Sequence[str], key: str = "run_id"):
        self.spark, self.path, self.schema, self.order, self.key = spark, path.rstrip("/"), schema, list(order), key
        self.sorted_path = self.path + "_sorted"

    # ---- files ---------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _bytes(self, path: str) -> int:
        p, fs = self._fs(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def _generations(self) -> list[str]:
        """Whole generations, the last one first."""
        return [f"{self.sorted_path}/{n}" for n in reversed(self._names(self.sorted_path))
                if "_SUCCESS" in self._names(f"{self.sorted_path}/{n}/ranges")]

    def _covered(self, generation: str) -> set[str]:
        return {r["file"] for r in self.spark.read.parquet(f"{generation}/covers").collect()}

    def _small(self) -> list[str]:
        return [n for n in self._names(self.path) if not n.startswith(("_", "."))]

    def _load(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # ---- reads ---------------------------------------------------------------
    def _fresh(self, generation: str | None) -> list[str]:
        """Small files that the generation does not hold."""
        covered = self._covered(generation) if generation else set()
        return [f"{self.path}/{n}" for n in self._small() if n not in covered]

    def read(self) -> DataFrame:
        """All events."""
        last = next(iter(self._generations()), None)
        return self._load(([f"{last}/rows"] if last else []) + self._fresh(last))

    def read_key(self, value) -> DataFrame:
        """The events of one key, from files that can hold it."""
        last = next(iter(self._generations()), None)
        hit = []
        if last:
            ranges = self.spark.read.parquet(f"{last}/ranges")
            hit = [f"{last}/rows/{r['file']}" for r in
                   ranges.where(F.lit(value).between(F.col("first"), F.col("last"))).select("file").collect()]
        return self._load(hit + self._fresh(last)).where(F.col(self.key) == value)

    # ---- writes --------------------------------------------------------------
    def append(self, events: DataFrame) -> None:
        events.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.mode("append").parquet(self.path)

    def compact(self, file_bytes: int = FILE_BYTES) -> str | None:
        """A new generation with all events, if small files came since the last
        one; returns the folder of the last generation."""
        last = next(iter(self._generations()), None)
        fresh = self._fresh(last)
        if not fresh:
            return last
        size = sum(map(self._bytes, fresh)) + (self._bytes(f"{last}/rows") if last else 0)
        number = int(last.rsplit("/", 1)[1].split("-")[0]) + 1 if last else 0
        out = f"{self.sorted_path}/{number:010d}-{uuid.uuid4().hex}"
        by = [self.key, *self.order]
        (self._load(([f"{last}/rows"] if last else []) + fresh)
         .repartitionByRange(math.ceil(size / file_bytes), *by).sortWithinPartitions(*by).write.parquet(f"{out}/rows"))
        held = {p.rsplit("/", 1)[1] for p in fresh} | (self._covered(last) & set(self._small()) if last else set())
        self.spark.createDataFrame([(n,) for n in sorted(held)], "file string").coalesce(1).write.parquet(f"{out}/covers")
        (self._load([f"{out}/rows"]).groupBy(F.col("_metadata.file_name").alias("file"))
         .agg(F.min(self.key).alias("first"), F.max(self.key).alias("last")).coalesce(1).write.parquet(f"{out}/ranges"))
        return out

    def tidy(self) -> None:
        """Drops small files that the last two generations both hold, and the
        generations before them, so that reads planned before the last
        compaction still find their files."""
        whole = self._generations()
        if len(whole) < 2:
            return
        held = self._covered(whole[0]) & self._covered(whole[1])
        gone = [f"{self.path}/{n}" for n in self._small() if n in held] + whole[2:]
        for path in gone:
            p, fs = self._fs(path)
            fs.delete(p, True)
