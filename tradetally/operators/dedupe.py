"""Duplicate detection and keep-first.

All forms aggregate before the shuffle: a trade id that holds a third of
all rows is reduced to one row per map task before it crosses the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradetally.functions.text import strip

KEY = "trade_id"


def usable_key(key: str = KEY) -> Column:
    """The id is neither null nor blank."""
    return F.coalesce(strip(F.col(key)) != "", F.lit(False))


def valid_key(df: DataFrame, key: str = KEY) -> DataFrame:
    """Rows with a usable id (null or blank ids are left out of matching)."""
    return df.where(usable_key(key))


def blank_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """The other rows: those without a usable id."""
    return df.where(~usable_key(key))


def duplicate_groups(df: DataFrame, key: str = KEY, sort: bool = False) -> DataFrame:
    """A1: one row per id occurring more than once, with its count.

    Partial + final hash aggregate; null ids are not reported. ``sort`` adds
    the ascending id order of the report (O2, a distributed sort).
    """
    out = (df.where(F.col(key).isNotNull())
             .groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"))
             .where(F.col("occurrences") > 1))
    return out.orderBy(key) if sort else out


def mark_duplicates(df: DataFrame, key: str = KEY) -> DataFrame:
    """Every row with ``is_duplicate``.

    Counts are pre-aggregated and joined back (many-to-one), so a hot id is
    streamed through a sort-merge join that AQE can split, instead of being
    buffered whole in one window task.
    """
    known = df.where(F.col(key).isNotNull())
    counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    marked = known.join(counts, key).withColumn("is_duplicate", F.col("_n") > 1).drop("_n")
    # rows without an id never meet in one task
    return marked.unionByName(df.where(F.col(key).isNull()).withColumn("is_duplicate", F.lit(False)))


def collapse(df: DataFrame, order_by: Sequence[str], key: str = KEY,
             payload: Sequence[str] | None = None, count_col: str = "occurrences") -> DataFrame:
    """W1 + A1 in one aggregate: one row per id, the first row by ``order_by``
    (file order when ``order_by`` is the ingest sequence) plus the id's count.

    ``min`` over a struct whose leading fields are the order keys gives the
    first row; it is computed partially on the map side.
    """
    payload = [c for c in (payload or df.columns) if c != key]
    # order keys lead the struct (min picks the first row); payload columns
    # that are already order keys are not carried twice
    first = F.struct(*[F.col(c) for c in order_by],
                     *[F.col(c) for c in payload if c not in order_by])
    agg = df.groupBy(key).agg(F.count(F.lit(1)).alias(count_col), F.min(first).alias("_first"))
    return agg.select(key, count_col, *[F.col(f"_first.{c}").alias(c) for c in payload])


def keep_first(df: DataFrame, order_by: Sequence[str], key: str = KEY) -> DataFrame:
    """The first row per id, without the count column."""
    cols = df.columns
    return collapse(df, order_by, key).select(*cols)
