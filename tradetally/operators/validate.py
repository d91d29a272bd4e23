"""Row validation against the trade contract (V1-V15) as column expressions.

``error_codes`` joins stable codes with ``'; '`` (``errors`` is the same as an
array); ``valid`` is ``error_codes = ''``. No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradetally.functions.text import strip, upper_trim
from tradetally.operators.normalise import MALFORMED
from tradetally.schemas import (ERROR_LIST_LIMIT, ERROR_TEXT_LIMIT, SIDES, TRADE_STATUSES)

REQUIRED_NON_NULL = ["trade_id", "trade_date", "settlement_date", "ticker", "isin", "side",
                     "quantity", "price", "consideration", "counterparty", "broker", "status"]
MIN_LENGTH_1 = ["trade_id", "ticker", "counterparty", "broker"]
POSITIVE = ["quantity", "price", "consideration"]
STRICT_ISIN = r"^[A-Z]{2}[A-Z0-9]{10}$"


def _code(cond: Column, code: str) -> Column:
    return F.when(cond, F.lit(code))


def field_error_codes(strict_isin: bool = False, date_range: tuple[str, str] | None = None,
                      stripped: bool = False) -> list[Column]:
    """V1-V7 (+ D7): one nullable code per rule, in field order. ``stripped``
    says that text columns are stripped already, as ``normalise`` leaves them."""
    c = F.col
    codes: list[Column] = []
    for f in REQUIRED_NON_NULL:
        codes.append(_code(c(f).isNull(), f"{f}:required"))
        if f in MIN_LENGTH_1:
            codes.append(_code((c(f) if stripped else strip(c(f))) == "", f"{f}:empty"))
        if f == "isin":
            isin = F.upper(c("isin")) if stripped else upper_trim(c("isin"))
            codes.append(_code((F.length(isin) != 12) | ~isin.rlike("^[A-Z]{2}"), "isin:format"))
            if strict_isin:
                codes.append(_code(~isin.rlike(STRICT_ISIN), "isin:strict"))
        if f == "side":
            codes.append(_code(~c("side").isin(*SIDES), "side:enum"))
        if f == "status":
            codes.append(_code(~c("status").isin(*TRADE_STATUSES), "status:enum"))
        if f in POSITIVE:
            codes.append(_code(c(f) <= 0, f"{f}:not_positive"))
    if date_range:
        lo, hi = date_range
        codes.append(_code(~c("trade_date").between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))),
                           "trade_date:out_of_range"))
    return codes


def settlement_error() -> Column:
    """V8."""
    return F.col("settlement_date") < F.col("trade_date")


def consideration_error() -> Column:
    """V9: |consideration - q*p| > max(1% of q*p, 0.01)."""
    qp = F.col("quantity") * F.col("price")
    return F.abs(F.col("consideration") - qp) > F.greatest(qp * 0.01, F.lit(0.01))


SEP = "; "


def error_text(strict_isin: bool = False, date_range: tuple[str, str] | None = None,
               stripped: bool = False) -> Column:
    """All codes of a row joined by ``'; '`` (empty when valid). V10: the
    cross-field rules run only when every field rule passed, and V9 only when
    V8 passed. ``concat_ws`` skips the NULL codes and stays in generated code."""
    fields = F.concat_ws(SEP, *field_error_codes(strict_isin, date_range, stripped))
    cross = (F.when(settlement_error(), F.lit("settlement_date:before_trade_date"))
              .when(consideration_error(), F.lit("consideration:mismatch"))
              .otherwise(F.lit("")))
    return F.when(fields != "", fields).otherwise(F.coalesce(cross, F.lit("")))


def validate(df: DataFrame, strict_isin: bool = False,
             date_range: tuple[str, str] | None = None, stripped: bool = False) -> DataFrame:
    """Adds ``error_codes`` (text), ``errors`` (array<string>) and ``valid``, and
    replaces trade_id, ticker and isin by their V13 output forms (trimmed;
    ticker and isin upper-cased). ``stripped`` says that text columns come from
    ``normalise`` and need no strip of their own."""
    # one select (chained withColumn calls would re-analyse the plan each time)
    v13 = {"isin": F.upper, "ticker": F.upper} if stripped else {"isin": upper_trim, "ticker": upper_trim, "trade_id": strip}
    # the codes come out of a one-element generator: a filter on ``valid``
    # then stays above it, instead of being pushed below with the whole rule
    # tree substituted into it (the rules run once per row either way)
    text = error_text(strict_isin, date_range, stripped)
    if MALFORMED in df.columns:
        text = F.when(F.col(MALFORMED).isNotNull(), F.lit("row:malformed")).otherwise(text)
    codes = df.select("*", F.explode(F.array(text)).alias("error_codes"))
    valid = F.col("error_codes") == ""
    return codes.select(
        *[v13[c](F.col(c)).alias(c) if c in v13 else F.col(c) for c in df.columns],
        "error_codes", valid.alias("valid"),
        F.when(valid, F.array().cast("array<string>")).otherwise(F.split("error_codes", SEP)).alias("errors"))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) over one validated frame; persist
    the frame first when both are consumed."""
    return validated.where("valid"), validated.where("NOT valid")


def counts(validated: DataFrame) -> DataFrame:
    """A5: record / valid / invalid counts per source (one aggregate job)."""
    return validated.groupBy("source").agg(
        F.count(F.lit(1)).cast("bigint").alias("record_count"),
        F.count_if(F.col("valid")).cast("bigint").alias("valid_count"),
        F.count_if(~F.col("valid")).cast("bigint").alias("invalid_count"))


def error_message(source: Column, trade_id: Column, errors: Column) -> Column:
    """``source[trade_id]: codes`` with the code text cut at 200 characters."""
    return F.concat(source, F.lit("["), F.coalesce(trade_id, F.lit("?")), F.lit("]: "),
                    F.substring(errors, 1, ERROR_TEXT_LIMIT))


def first_errors(validated: DataFrame, order_by: list[str | Column] | None = None,
                 limit: int = ERROR_LIST_LIMIT) -> DataFrame:
    """The first ``limit`` error messages in ingest order
    (top-k: each task keeps ``limit`` rows, the driver merges them)."""
    bad = validated.where(~F.col("valid"))
    msg = error_message(F.col("source"), F.col("trade_id"), F.col("error_codes")).alias("message")
    order = order_by or ["ingest_seq"]
    return bad.select(*order, msg).orderBy(*order, "message").limit(limit).select("message")


def check_non_negative(cols: list[str]) -> Column:
    """Any negative count in a run/ingestion row."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c) < 0, F.lit(False))
    return cond
