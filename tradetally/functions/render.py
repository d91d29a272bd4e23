"""Text rendering of typed breaks into the reference's three text columns
(F12). Display only: numbers printed by Spark can differ from other
engines in the last digits or exponent notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _num(c: Column) -> Column:
    return c.cast("string")


def render_columns() -> tuple[Column, Column, Column]:
    bt = F.col("break_type")
    missing_text = lambda s, q: F.concat_ws(" ", F.coalesce(F.col("ticker"), F.lit("?")),
                                             F.coalesce(F.col(s), F.lit("?")),
                                             F.concat(F.coalesce(_num(F.col(q)), F.lit("?")), F.lit("@"),
                                                      F.coalesce(_num(F.col("unit_price")), F.lit("?"))))
    a = (F.when(bt == "DUPLICATE", F.concat(F.col("source"), F.lit(": "),
                                            F.col("occurrences").cast("string"), F.lit(" occurrences")))
          .when((bt == "MISSING") & (F.col("source") == "source_a"), missing_text("a_str", "a_num"))
          .when(bt == "MISSING", F.lit("NOT FOUND"))
          .when(bt == "SIDE_BREAK", F.col("a_str"))
          .when(bt.isin("QTY_BREAK", "PRICE_BREAK"), _num(F.col("a_num")))
          .when(bt == "SETTLE_BREAK", F.date_format("a_date", "yyyy-MM-dd")))
    b = (F.when(bt == "DUPLICATE", F.lit(None).cast("string"))
          .when((bt == "MISSING") & (F.col("source") == "source_b"), missing_text("b_str", "b_num"))
          .when(bt == "MISSING", F.lit("NOT FOUND"))
          .when(bt == "SIDE_BREAK", F.col("b_str"))
          .when(bt.isin("QTY_BREAK", "PRICE_BREAK"), _num(F.col("b_num")))
          .when(bt == "SETTLE_BREAK", F.date_format("b_date", "yyyy-MM-dd")))
    d = (F.when(bt == "DUPLICATE", F.concat(F.lit("Expected 1, found "), F.col("occurrences").cast("string")))
          .when((bt == "MISSING") & (F.col("source") == "source_a"),
                F.lit("Trade present in Source A, absent in Source B"))
          .when(bt == "MISSING", F.lit("Trade present in Source B, absent in Source A"))
          .when(bt == "SIDE_BREAK", F.concat(F.lit("Source A="), F.col("a_str"), F.lit(", Source B="),
                                             F.col("b_str")))
          .when(bt == "QTY_BREAK", _num(F.col("diff_num")))
          .when(bt == "PRICE_BREAK", F.format_string("%+.4f", F.col("diff_num")))
          .when(bt == "SETTLE_BREAK", F.concat(F.col("diff_days").cast("string"), F.lit(" day(s)"))))
    return a, b, d


def render(breaks: DataFrame) -> DataFrame:
    """Adds ``source_a_value, source_b_value, difference``."""
    a, b, d = render_columns()
    return breaks.select("*", a.alias("source_a_value"), b.alias("source_b_value"), d.alias("difference"))
