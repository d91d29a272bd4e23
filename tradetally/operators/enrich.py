"""Security-master enrichment and per-asset-class tolerances.

The joins carry no hint: Spark broadcasts a dimension below its byte
threshold, by its statistics or at run time, and shuffles a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradetally.operators.compare import Tolerances

def enrich(trades: DataFrame, master: DataFrame, key: str = "ticker") -> DataFrame:
    """Left join of trades to the security master on ``key``."""
    return trades.join(master, key, "left")


def unmatched_keys(trades: DataFrame, master: DataFrame, key: str = "ticker") -> DataFrame:
    """Keys of trades absent from the master."""
    return trades.select(key).distinct().join(master.select(key), key, "left_anti")


def tolerance_table(spark, overrides: dict[str, dict]) -> DataFrame:
    """The configured per-class overrides as a tiny table (one row per class)."""
    rows = [(k.lower(), float(v.get("quantity_tolerance")) if "quantity_tolerance" in v else None,
             float(v.get("price_tolerance")) if "price_tolerance" in v else None,
             float(v.get("consideration_tolerance")) if "consideration_tolerance" in v else None,
             int(v.get("settlement_date_tolerance_days")) if "settlement_date_tolerance_days" in v else None)
            for k, v in overrides.items()]
    return spark.createDataFrame(rows, "asset_class string, quantity_tolerance double, "
                                       "price_tolerance double, consideration_tolerance double, "
                                       "settlement_date_tolerance_days int")


# Master asset classes that name a configured class differently (compared lower-case).
CLASS_ALIASES = {"equity": "equities"}


def with_class_tolerances(pairs: DataFrame, master: DataFrame, overrides: DataFrame,
                          default: Tolerances,
                          class_aliases: dict[str, str] = CLASS_ALIASES) -> tuple[DataFrame, Tolerances]:
    """Pairs gain their asset class (via A's ticker, B's when A is absent)
    and per-row tolerance columns = coalesce(class override, default).
    Classes are compared lower-case after ``class_aliases`` (the configuration
    says ``equities`` where security-master data says ``EQUITY``)."""
    cls = F.lower(F.col("asset_class"))
    if class_aliases:
        m_alias = F.create_map(*[F.lit(x) for kv in class_aliases.items() for x in kv])
        cls = F.coalesce(F.try_element_at(m_alias, cls), cls)
    m = master.select(F.col("ticker").alias("_tk"), cls.alias("asset_class"))
    p = pairs.withColumn("_tk", F.coalesce(F.col("ticker_a"), F.col("ticker_b")))
    p = p.join(m, "_tk", "left").drop("_tk")
    p = p.join(overrides, "asset_class", "left")

    def col(name: str, dflt) -> Column:
        return F.coalesce(F.col(name), F.lit(dflt))

    tol = Tolerances(quantity=col("quantity_tolerance", default.quantity),
                     price=col("price_tolerance", default.price),
                     consideration=col("consideration_tolerance", default.consideration),
                     settlement_days=col("settlement_date_tolerance_days", default.settlement_days))
    return p, tol
