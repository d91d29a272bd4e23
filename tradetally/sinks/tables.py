"""Co-located storage for a feed that is reconciled every day.

A feed kept as a table bucketed by ``trade_id`` is aggregated and joined
without an exchange of its own: only the other feed is shuffled (into the
same number of partitions as the buckets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradetally.session import scratch_path

KEY = "trade_id"


def write_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None,
                   key: str = KEY) -> None:
    """Save ``df`` as a catalog table in ``buckets`` hash buckets on ``key``,
    each bucket sorted by the key. ``path`` places the data in a shared folder
    (an external table) instead of the warehouse."""
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: what follows starts
    from files that outlive an executor, and holds no blocks in the session."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
