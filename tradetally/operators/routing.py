"""Routing of break subsets to recipients by role (D6). Sending is not built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BREAK_SUBSETS = ["all_breaks", "critical_breaks"]


def recipients_table(spark: SparkSession, recipients) -> DataFrame:
    """Flat table (group, name, email, role, item) from the deployment's
    configuration: (group, name, email, role, [items]) rows."""
    rows = [(g, n, e, r, item) for g, n, e, r, items in recipients for item in items]
    return spark.createDataFrame(rows, "recipient_group string, name string, email string, "
                                       "role string, item string")


def break_subsets(breaks: DataFrame) -> DataFrame:
    """Each break tagged with the subsets it belongs to (at most two rows per break)."""
    tags = F.array(F.lit("all_breaks"),
                   F.when(F.col("severity") == "CRITICAL", F.lit("critical_breaks")))
    return breaks.select("*", F.explode(tags).alias("item")).where(F.col("item").isNotNull())


def route(severities: DataFrame, recipients: DataFrame) -> DataFrame:
    """Per recipient and item, the number of breaks it receives (reports such
    as ``summary`` count as one item), from the (severity, n) counts."""
    per_item = severities.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("severity") == "CRITICAL", F.col("n"))).alias("critical"))
    per_item = per_item.select(F.expr("stack(2, 'all_breaks', all, 'critical_breaks', critical) AS (item, n)"))
    r = recipients.join(per_item, "item", "left")
    n = (F.when(F.col("item").isin(*BREAK_SUBSETS), F.coalesce(F.col("n"), F.lit(0)))
          .otherwise(F.lit(1))).cast("bigint")
    return r.select("recipient_group", "name", "role", "item", n.alias("n"))


def routed_breaks(breaks: DataFrame, recipients: DataFrame) -> DataFrame:
    """The (recipient, break) rows themselves: each break goes to the
    recipients of its subsets; Spark broadcasts a small recipients table."""
    rs = recipients.where(F.col("item").isin(*BREAK_SUBSETS))
    return break_subsets(breaks).join(rs, "item").select("name", "email", "role", "item",
                                                         "break_id", "trade_id", "break_type",
                                                         "severity")
