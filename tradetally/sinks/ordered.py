"""A table kept in a total order (O3, O7): written once by a range sort, with
the number of rows of each range, from which every row's position and any page
of the order follow without sorting again.

Under the table's folder, ``rows/`` holds the sorted rows with their range and
place in it, ``ranges/`` a row for each range with its count and the rows before
it. A file of ``rows/`` holds one range, so the statistics of its range column
let a page skip all other files. The files are all there is: another session
opens the same folder.

Defined results: an empty table has no ranges and no positions; where rows are
equal in all order columns their order is undecided, but fixed once written;
nulls come first. The columns ``_range`` and ``_place`` belong to the table, and
an input that has them is refused.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWN = ("_range", "_place", "position")


class OrderedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, df: DataFrame, path: str, *order: str) -> OrderedTable:
        """Sorts and writes ``df``; no task sees more than its range."""
        taken = sorted(set(OWN) & set(df.columns))
        if taken:
            raise ValueError(f"columns {taken} belong to the ordered table")
        row = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
        out = cls(df.sparkSession, path)
        (df.orderBy(*order).select("*", F.shiftright(row, 33).alias("_range"),
                                   row.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
         .write.option("compression", "zstd").parquet(f"{path}/rows"))
        counts = sorted(out._rows().groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
        before = accumulate((r["n"] for r in counts), initial=0)
        ranges = [(r["_range"], r["n"], b) for r, b in zip(counts, before)]
        df.sparkSession.createDataFrame(ranges, "_range long, n long, before long").coalesce(1).write.parquet(f"{path}/ranges")
        return out

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _ranges(self) -> DataFrame:
        return self.spark.read.schema("_range long, n long, before long").parquet(f"{self.path}/ranges")

    def _placed(self, rows: DataFrame, ranges: DataFrame) -> DataFrame:
        # a row a range: bounded by the partitions of the sort, whatever the data
        return (rows.join(F.broadcast(ranges.select("_range", "before")), "_range")
                .withColumn("position", F.col("before") + F.col("_place") + 1).drop("_range", "_place", "before"))

    def positioned(self) -> DataFrame:
        """All rows with their ``position`` (from 1)."""
        return self._placed(self._rows(), self._ranges())

    def page(self, first: int, last: int) -> DataFrame:
        """Rows at the positions ``first`` to ``last``, in order; only the files
        of the ranges that hold them are read."""
        hit = self._ranges().where((F.col("before") < last) & (F.col("before") + F.col("n") >= first))
        ids = [r["_range"] for r in hit.select("_range").collect()]
        rows = self._rows().where(F.col("_range").isin(ids))
        return self._placed(rows, self._ranges()).where(F.col("position").between(first, last)).orderBy("position")
