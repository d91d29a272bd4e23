"""Key joins and set operations on trade ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "trade_id"


def distinct_ids(df: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct non-null ids (partial aggregate: a hot id is one row per task)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def common_ids(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """Ids in both. Both sides are reduced to distinct ids first, so the
    semi join sees unique keys on each side whatever the skew."""
    return distinct_ids(a, key).join(distinct_ids(b, key), key, "left_semi")


def ids_only_in(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """Ids of ``a`` absent from ``b`` (EXCEPT DISTINCT on unique keys)."""
    return distinct_ids(a, key).join(distinct_ids(b, key), key, "left_anti")


def missing_from(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of ``a`` whose id is absent from ``b`` (left anti against
    ``b``'s distinct ids; ``a`` streams, AQE may split a hot id of ``a``)."""
    return a.join(distinct_ids(b, key), key, "left_anti")


def common_trades(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of ``a`` whose id is present in ``b`` (left semi on distinct ids)."""
    return a.join(distinct_ids(b, key), key, "left_semi")


def matched_pairs(a: DataFrame, b: DataFrame, key: str = KEY,
                  suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner join on the id; overlapping columns get ``_a``/``_b`` suffixes.

    Duplicated ids multiply, as an inner join does; dedupe first to avoid it.
    """
    overlap = (set(a.columns) & set(b.columns)) - {key}
    ra = a.select(key, *[F.col(c).alias(c + suffixes[0]) if c in overlap else F.col(c)
                         for c in a.columns if c != key])
    rb = b.select(key, *[F.col(c).alias(c + suffixes[1]) if c in overlap else F.col(c)
                         for c in b.columns if c != key])
    return ra.join(rb, key, "inner")


def concat_frames(*frames: DataFrame) -> DataFrame:
    """U4: UNION ALL by column name (break lists of several steps)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def detect_missing(a: DataFrame, b: DataFrame, order_by, key: str = KEY,
                   payload=("ticker", "side", "quantity", "price"), sort: bool = False) -> DataFrame:
    """J5 as a stand-alone operator: both directions of missing ids, each with
    the first copy's payload and the side it was found on. The two keep-first
    outputs meet in one full outer join (one exchange per side) and the rows
    present on one side only are kept: the same rows two anti joins and a
    union give, without aggregating either feed twice."""
    from tradetally.operators.dedupe import keep_first, valid_key
    cols = [c for c in payload if c in a.columns and c in b.columns]
    keep = list(dict.fromkeys([key, *cols, *order_by]))
    fa = keep_first(valid_key(a).select(*keep), order_by, key)
    fb = keep_first(valid_key(b).select(*keep), order_by, key)
    j = (fa.select(key, F.struct(*cols).alias("_a"))
         .join(fb.select(key, F.struct(*cols).alias("_b")), key, "full_outer"))
    one_sided = j.where(F.col("_a").isNull() | F.col("_b").isNull())
    out = one_sided.select(key, *[F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}")).alias(c) for c in cols],
                           F.when(F.col("_b").isNull(), "source_a").otherwise("source_b").alias("source"))
    # O1: A-only ids ascending, then B-only ids ascending (presentation order)
    return out.orderBy("source", key) if sort else out


def pair_counts(a: DataFrame, b: DataFrame, same: Sequence[str] = (), key: str = KEY) -> DataFrame:
    """J3 without its rows: for each id of both frames the copies ``n_a`` and
    ``n_b``, the ``pairs`` an inner join would list, and for each column c of
    ``same`` in how many of them both sides agree (``same_<c>``; a null agrees
    with nothing). An id that holds a third of both frames has n x m pairs, but
    costs a row for each of its distinct values and map task.

    The rows of either frame are counted by id and value before they meet, so the
    products are of counts; ids that are null take no part; counts beyond a long
    fail under ANSI arithmetic instead of wrapping."""
    def counted(df: DataFrame, side: str) -> DataFrame:
        known = df.where(F.col(key).isNotNull())
        # one row for the id itself (column number -1) and for each compared value
        facts = F.array(F.struct(F.lit(-1).alias("c"), F.lit("").alias("v")),
                        *[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(same)])
        return (known.select(key, F.inline(facts)).where(F.col("v").isNotNull())
                .groupBy(key, "c", "v").agg(F.count(F.lit(1)).alias(side)))

    both = counted(a, "n_a").join(counted(b, "n_b"), [key, "c", "v"])
    product, own = F.col("n_a") * F.col("n_b"), F.col("c") == -1
    return both.groupBy(key).agg(
        F.max(F.when(own, F.col("n_a"))).alias("n_a"), F.max(F.when(own, F.col("n_b"))).alias("n_b"),
        F.sum(F.when(own, product)).alias("pairs"),
        *[F.coalesce(F.sum(F.when(F.col("c") == i, product)), F.lit(0)).alias(f"same_{c}") for i, c in enumerate(same)])


def member_blocks(a: DataFrame, b: DataFrame, payload: Sequence[str], size: int = 1000, key: str = KEY) -> DataFrame:
    """J3 factorised: the members of the ids that both frames have, in blocks:
    (id, ``side`` a or b, ``block``, ``blocks`` of this side, ``members``). The
    pairs of an id are all members of a with all of b, so n + m members stand for
    n x m rows. An id of n copies has n / ``size`` blocks, dealt by chance, of about
    ``size`` members each; so no task gathers a hot id."""
    ids = common_ids(a, b, key)

    def side(df: DataFrame, name: str) -> DataFrame:
        sizes = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(ids, key, "left_semi")
                 .select(key, F.ceil(F.col("_n") / size).cast("int").alias("_blocks")))
        rows = df.select(key, F.struct(*payload).alias("_member"), F.rand(7).alias("_lot")).join(sizes, key)
        return (rows.groupBy(key, "_blocks", F.floor(F.col("_lot") * F.col("_blocks")).cast("int").alias("_block"))
                .agg(F.sort_array(F.collect_list("_member")).alias("_members"))
                .select(key, F.lit(name).alias("side"), F.col("_block").alias("block"), F.col("_blocks").alias("blocks"),
                        F.col("_members").alias("members")))

    return side(a, "a").unionByName(side(b, "b"))
