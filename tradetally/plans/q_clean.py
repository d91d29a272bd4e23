"""Catalogue: normalisation and validation over the dirty raw feed (P, S8, V, A5, O5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.operators import normalise as N
from tradetally.operators import validate as V
from tradetally.plans import sql_dirty as D
from tradetally.plans.registry import query
from tradetally.plans.sql_feeds import FEEDS, with_ctes
from tradetally.sources.fixtures import RAW_COLUMNS, dirty_raw, feed_a, feed_b


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty feed through P9 with the explicit format and quarantine-mode dates."""
    return N.normalise(dirty_raw(spark, sf_dir), "source_a", date_format="%Y-%m-%d",
                       keep_raw_dates=True)


def validated(spark, sf_dir, strict_isin=False) -> DataFrame:
    return V.validate(normalised(spark, sf_dir), strict_isin=strict_isin, stripped=True)


def _codes() -> F.Column:
    return F.col("error_codes")


@query("normalise_side", with_ctes(D.NORM, "SELECT trade_id, side FROM norm"))
def normalise_side(spark, sf_dir):
    """P3."""
    return normalised(spark, sf_dir).select("trade_id", "side")


@query("normalise_numerics", with_ctes(D.NORM, "SELECT trade_id, quantity, price, consideration FROM norm"))
def normalise_numerics(spark, sf_dir):
    """P5: regex-guarded cast, NaN -> NULL."""
    return normalised(spark, sf_dir).select("trade_id", "quantity", "price", "consideration")


@query("normalise_dates", with_ctes(D.NORM, """
SELECT trade_id, trade_date, settlement_date,
       (trade_date_raw IS NOT NULL AND trade_date IS NULL)
       OR (settlement_date_raw IS NOT NULL AND settlement_date IS NULL) AS date_parse_failed
FROM norm"""))
def normalise_dates(spark, sf_dir):
    """P4 in quarantine mode: unparsed dates are flagged, not fatal."""
    n = normalised(spark, sf_dir)
    return n.select("trade_id", "trade_date", "settlement_date",
                    N.date_failures(n).alias("date_parse_failed"))


_NULLS_SQL = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in RAW_COLUMNS)


@query("na_tokens", with_ctes(D.NORM, f"""
SELECT (SELECT count(*) FROM raw) AS raw_rows, count(*) AS kept_rows, {_NULLS_SQL} FROM norm"""))
def na_tokens(spark, sf_dir):
    """S8 + P8: NULLs per column after token folding, and rows left after the
    all-empty drop, in one aggregate over the raw feed."""
    n = N.normalise(dirty_raw(spark, sf_dir), "source_a", date_format="%Y-%m-%d", drop_empty=False)
    kept = ~F.col("empty_row")
    return n.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(kept).alias("kept_rows"),
                 *[F.count_if(kept & F.col(c).isNull()).alias(f"null_{c}") for c in RAW_COLUMNS])


@query("trim_strings", with_ctes(D.NORM, """
SELECT trade_id, ticker, isin, counterparty, broker, trader_id, status FROM norm"""))
def trim_strings(spark, sf_dir):
    """P7."""
    return normalised(spark, sf_dir).select("trade_id", "ticker", "isin", "counterparty", "broker",
                                            "trader_id", "status")


@query("validate_rows", with_ctes(D.validated(), """
SELECT v_trade_id AS trade_id, upper(trim(ticker)) AS ticker, upper(trim(isin)) AS isin,
       error_codes = '' AS valid, error_codes FROM validated"""))
def validate_rows(spark, sf_dir):
    """V1-V10, V13."""
    return validated(spark, sf_dir).select("trade_id", "ticker", "isin", "valid", _codes())


@query("validation_counts", with_ctes(D.validated(), """
SELECT source, count(*) AS record_count, count(*) FILTER (WHERE error_codes = '') AS valid_count,
       count(*) FILTER (WHERE error_codes <> '') AS invalid_count FROM validated GROUP BY source"""))
def validation_counts(spark, sf_dir):
    """A5."""
    return V.counts(validated(spark, sf_dir))


@query("validation_error_top10", with_ctes(D.validated(), """
SELECT message FROM (
  SELECT source || '[' || coalesce(v_trade_id, '?') || ']: ' || substring(error_codes, 1, 200) AS message,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM validated WHERE error_codes <> ''
) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, message LIMIT 10"""))
def validation_error_top10(spark, sf_dir):
    """First ten messages in ingest order."""
    return V.first_errors(validated(spark, sf_dir), order_by=["ingest_seq"])


@query("quarantine_rows", with_ctes(D.validated(), """
SELECT v_trade_id AS trade_id, error_codes FROM validated WHERE error_codes <> ''"""))
def quarantine_rows(spark, sf_dir):
    """The quarantined side of the split."""
    _, bad = V.split(validated(spark, sf_dir))
    return bad.select("trade_id", _codes())


@query("valid_rows", with_ctes(D.validated(), """
SELECT v_trade_id AS trade_id, trade_date, settlement_date, upper(trim(ticker)) AS ticker,
       upper(trim(isin)) AS isin, side, quantity, price, consideration, counterparty, broker,
       trader_id, status, source
FROM validated WHERE error_codes = ''"""))
def valid_rows(spark, sf_dir):
    """V11 + P11: valid rows projected to the contract."""
    good, _ = V.split(validated(spark, sf_dir))
    return N.to_contract(good).drop("ingest_seq")


@query("strict_isin", with_ctes(D.validated(strict_isin=True), """
SELECT v_trade_id AS trade_id, upper(trim(isin)) AS isin, error_codes FROM validated
WHERE contains(error_codes, 'isin:strict')"""))
def strict_isin(spark, sf_dir):
    """V7: the stricter ISIN pattern as an option."""
    v = validated(spark, sf_dir, strict_isin=True)
    return (v.where(F.array_contains("errors", "isin:strict"))
             .select("trade_id", "isin", _codes()))


@query("ingestion_counts", with_ctes(FEEDS + """,
feeds_ab AS (SELECT * FROM feed_a UNION ALL SELECT * FROM feed_b)""", """
SELECT source, count(*) AS record_count,
       count(*) FILTER (WHERE abs(consideration - quantity * price) <= greatest(quantity * price * 0.01, 0.01)) AS valid_count,
       count(*) FILTER (WHERE abs(consideration - quantity * price) > greatest(quantity * price * 0.01, 0.01)) AS invalid_count
FROM feeds_ab GROUP BY source"""))
def ingestion_counts(spark, sf_dir):
    """A5 over both feeds: record / valid / invalid counts per source (B's
    quantity-shifted rows fail the consideration rule)."""
    both = feed_a(spark, sf_dir).unionByName(feed_b(spark, sf_dir))
    return V.counts(V.validate(both))
