"""Break and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradetally.schemas import SEVERITIES
from tradetally.session import scratch_path
from tradetally.sinks.ordered import OrderedTable
from tradetally.sinks.tables import staged


def severity_counts(breaks: DataFrame) -> DataFrame:
    """A2: breaks per severity."""
    return breaks.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def type_counts(breaks: DataFrame) -> DataFrame:
    """Breaks per type, in name order (at most a handful of rows)."""
    return breaks.groupBy("break_type").agg(F.count(F.lit(1)).alias("n")).orderBy("break_type")


def type_summary_map(breaks: DataFrame) -> DataFrame:
    """A3 as a single map column {break_type: n} (the map is at most 6 entries)."""
    t = type_counts(breaks)
    return t.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("break_type", "n"))))
                 .alias("type_summary"))


def severity_rank(col: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col),
                      F.lit(len(SEVERITIES) + 1))


def ordered_breaks(breaks: DataFrame, by_rank: bool = False) -> DataFrame:
    """O3: lexical (severity, break_type) as stored, or severity rank when ``by_rank``;
    trade id and step make the order total."""
    first = severity_rank(F.col("severity")) if by_rank else F.col("severity")
    return breaks.orderBy(first, "break_type", "trade_id", "step")


def positioned(df: DataFrame, *order: str) -> DataFrame:
    """All rows with their ``position`` (from 1) in the given order, which must
    be total: read from an ordered table written in the shared folder. The rows are
    staged there first, as the sort reads them twice (range bounds, then rows)."""
    return OrderedTable.write(staged(df, "unordered"), scratch_path(df.sparkSession, "ordered"), *order).positioned()


def run_status(error_count: Column, total_breaks: Column) -> Column:
    """Errors and no breaks -> FAILED; errors -> PARTIAL; else COMPLETED."""
    return (F.when((error_count > 0) & (total_breaks == 0), "FAILED")
             .when(error_count > 0, "PARTIAL")
             .otherwise("COMPLETED"))
