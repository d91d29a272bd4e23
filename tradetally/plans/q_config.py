"""Catalogue: operators declared by configuration (D1-D7), business-day
settlement (F7) and break rendering (F12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.functions.dates import add_business_days
from tradetally.functions.render import render
from tradetally.operators import enrich, routing
from tradetally.operators import validate as V
from tradetally.operators.compare import Checks, Tolerances
from tradetally.operators.reconcile import pair_frame, reconcile
from tradetally.plans import sql_dirty as D
from tradetally.plans import sql_feeds as S
from tradetally.plans.q_clean import normalised
from tradetally.plans.q_match import BREAK_SELECT, RUN_ID, recon
from tradetally.plans.registry import query
from tradetally.schemas import ESCALATION, SEVERITY_BY_TYPE
from tradetally.sources.fixtures import FEED_ORDER, feed_a, feed_b
from tradetally.sources.tables import table


def security_master_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security master from ``part``: one row per ticker (``P`` + partkey mod 100),
    the lowest part key wins; asset class from the part type."""
    p = table(spark, sf_dir, "part")
    g = p.groupBy((F.col("p_partkey") % 100).alias("k")).agg(
        F.min_by(F.struct("p_name", "p_type"), "p_partkey").alias("s"))
    return g.select(F.concat(F.lit("P"), F.col("k").cast("string")).alias("ticker"),
                    F.col("s.p_name").alias("security_name"), F.col("s.p_type").alias("asset_class"))


MASTER_SQL = """
master AS (
  SELECT 'P' || CAST(k AS VARCHAR) AS ticker, arg_min(p_name, p_partkey) AS security_name,
         arg_min(p_type, p_partkey) AS asset_class
  FROM (SELECT *, p_partkey % 100 AS k FROM part) GROUP BY k
)"""


# Severity map used by the D1 query (a configuration change, not the default).
ALT_SEVERITY = dict(SEVERITY_BY_TYPE, PRICE_BREAK="HIGH", SETTLE_BREAK="LOW", DUPLICATE="MEDIUM")


@query("severity_from_config", S.with_ctes(S.BREAKS, """
SELECT CASE break_type WHEN 'PRICE_BREAK' THEN 'HIGH' WHEN 'SETTLE_BREAK' THEN 'LOW'
            WHEN 'DUPLICATE' THEN 'MEDIUM' ELSE severity END AS severity, count(*) AS n
FROM breaks GROUP BY 1"""))
def severity_from_config(spark, sf_dir):
    """Severities read from configuration instead of constants."""
    r = recon(spark, sf_dir, checks=Checks(severity=ALT_SEVERITY), detail=False)
    return r.severity_counts()


# Asset-class overrides used by the D2 query (classes are the part types).
CLASS_OVERRIDES = {
    "promo": {"price_tolerance": 0.10},
    "large": {"settlement_date_tolerance_days": 1},
    "economy": {"quantity_tolerance": 100.0},
}


@query("asset_class_tolerance", S.with_ctes(S.SIDES + "," + MASTER_SQL + f""",
tp AS (
  SELECT pairs.*, lower(m.asset_class) AS asset_class FROM pairs
  LEFT JOIN master m ON m.ticker = coalesce(pairs.ticker_a, pairs.ticker_b)
),
tol AS (
  SELECT *, CASE WHEN asset_class = 'economy' THEN 100.0::DOUBLE ELSE 0::DOUBLE END AS qt,
         CASE WHEN asset_class = 'promo' THEN 0.10::DOUBLE ELSE 0.01::DOUBLE END AS pt,
         CASE WHEN asset_class = 'large' THEN 1 ELSE 0 END AS st
  FROM tp
),
flagged AS (SELECT *, {S.flags('qt', 'pt', 'st')} FROM tol)""", """
SELECT 'CLEAN' AS break_type, count(*) FILTER (WHERE clean) AS n FROM flagged
UNION ALL SELECT 'QTY_BREAK', count(*) FILTER (WHERE qty_break) FROM flagged
UNION ALL SELECT 'PRICE_BREAK', count(*) FILTER (WHERE price_break) FROM flagged
UNION ALL SELECT 'SETTLE_BREAK', count(*) FILTER (WHERE settle_break) FROM flagged"""))
def asset_class_tolerance(spark, sf_dir):
    """Per-asset-class tolerance overrides through the security master."""
    pairs = pair_frame(feed_a(spark, sf_dir), feed_b(spark, sf_dir), FEED_ORDER)
    master = security_master_table(spark, sf_dir)
    ov = enrich.tolerance_table(spark, CLASS_OVERRIDES)
    p, tol = enrich.with_class_tolerances(pairs, master, ov, Tolerances())
    r = reconcile(None, None, run_id=RUN_ID, tolerances=tol, pairs=p)
    return r.summary().where(F.col("break_type").isin("CLEAN", "QTY_BREAK", "PRICE_BREAK",
                                                      "SETTLE_BREAK"))


@query("escalation", S.with_ctes(S.BREAKS + f""",
bx AS ({BREAK_SELECT}),
risk AS (
  SELECT CAST(coalesce(sum(CAST(coalesce(p.consideration_a, p.consideration_b) AS DECIMAL(28,6))), 0) AS DOUBLE) AS r
  FROM (SELECT DISTINCT trade_id FROM bx) t LEFT JOIN pairs p ON p.trade_id = t.trade_id
)""", f"""
SELECT run_id, total_breaks, critical_breaks, r AS consideration_at_risk,
       total_breaks > {ESCALATION['break_count_threshold']} OR r > {ESCALATION['consideration_threshold']} OR critical_breaks > 0 AS escalate,
       concat_ws(', ', CASE WHEN total_breaks > {ESCALATION['break_count_threshold']} THEN 'break_count' END,
                 CASE WHEN r > {ESCALATION['consideration_threshold']} THEN 'consideration' END,
                 CASE WHEN critical_breaks > 0 THEN 'critical' END) AS reasons
FROM (SELECT run_id, count(*) AS total_breaks, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_breaks
      FROM bx GROUP BY run_id), risk"""))
def escalation(spark, sf_dir):
    """Escalation flags and reasons per run."""
    pairs = pair_frame(feed_a(spark, sf_dir), feed_b(spark, sf_dir), FEED_ORDER,
                       payload=["side", "quantity", "price", "settlement_date", "consideration"])
    return reconcile(None, None, run_id=RUN_ID, pairs=pairs).escalation(**ESCALATION)


@query("security_master", S.with_ctes(S.FEEDS + "," + MASTER_SQL, """
SELECT a.trade_id, a.ticker, m.asset_class, m.security_name FROM feed_a a LEFT JOIN master m ON m.ticker = a.ticker"""))
def security_master(spark, sf_dir):
    """Trades enriched from the security master."""
    a = feed_a(spark, sf_dir).select("trade_id", "ticker")
    return enrich.enrich(a, security_master_table(spark, sf_dir)).select(
        "trade_id", "ticker", "asset_class", "security_name")


@query("unmatched_tickers", S.with_ctes(S.FEEDS + "," + MASTER_SQL, """
SELECT DISTINCT ticker FROM feed_b WHERE ticker NOT IN (SELECT ticker FROM master WHERE length(ticker) < 3)"""))
def unmatched_tickers(spark, sf_dir):
    """Tickers of B with no row in a security master of the short tickers."""
    master = security_master_table(spark, sf_dir).where("length(ticker) < 3")
    return enrich.unmatched_keys(feed_b(spark, sf_dir), master)


# An example of a deployment's recipients.
RECIPIENTS = [
    ("desk", "Desk One", "desk-one@example.org", "matching", ["all_breaks", "summary"]),
    ("desk", "Desk Two", "desk-two@example.org", "settlements", ["all_breaks"]),
    ("managers", "Duty Manager", "duty@example.org", "manager", ["critical_breaks", "summary", "full_report"]),
]
_RECIP = ", ".join(f"('{g}', '{n}', '{r}', '{i}')" for g, n, _, r, items in RECIPIENTS for i in items)


@query("routing", S.with_ctes(S.BREAKS + f""",
recipients(recipient_group, name, role, item) AS (VALUES {_RECIP}),
per_item AS (
  SELECT 'all_breaks' AS item, count(*) AS n FROM breaks
  UNION ALL SELECT 'critical_breaks', count(*) FROM breaks WHERE severity = 'CRITICAL'
)""", """
SELECT r.recipient_group, r.name, r.role, r.item,
       CASE WHEN r.item IN ('all_breaks', 'critical_breaks') THEN coalesce(p.n, 0) ELSE 1 END AS n
FROM recipients r LEFT JOIN per_item p ON p.item = r.item"""))
def routing_counts(spark, sf_dir):
    """What each configured recipient receives for the run."""
    return routing.route(recon(spark, sf_dir, detail=False).severity_counts(),
                         routing.recipients_table(spark, RECIPIENTS))


DATE_RANGE = ("1996-01-01", "2000-12-31")


@query("date_range", S.with_ctes(D.validated(date_range=DATE_RANGE), """
SELECT v_trade_id AS trade_id, error_codes FROM validated WHERE contains(error_codes, 'trade_date:out_of_range')"""))
def date_range(spark, sf_dir):
    """A trade-date window as one more validation rule."""
    v = V.validate(normalised(spark, sf_dir), date_range=DATE_RANGE)
    return v.where(F.array_contains("errors", "trade_date:out_of_range")).select("trade_id", "error_codes")


_BD_SQL = """
SELECT o_orderkey, d AS trade_date, n,
  CASE WHEN n = 0 THEN d
       ELSE (d - CASE WHEN w = 5 THEN 1 WHEN w = 6 THEN 2 ELSE 0 END)
            + CAST(n + 2 * floor((least(w, 4) + n) / 5) AS INTEGER) END AS settlement_date
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 4 AS INTEGER) AS n,
             isodow(CAST(o_orderdate AS DATE)) - 1 AS w FROM orders)"""


@query("business_day_settlement", _BD_SQL)
def business_day_settlement(spark, sf_dir):
    """T+n settlement over weekdays for every order date (n = 0..3)."""
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    n = (F.col("o_orderkey") % 4).cast("int")
    return o.select("o_orderkey", d.alias("trade_date"), n.alias("n"),
                    add_business_days(d, n).alias("settlement_date"))


@query("render_breaks", S.with_ctes(S.BREAKS + f", bx AS ({BREAK_SELECT})", """
SELECT break_id, break_type,
  CASE WHEN break_type = 'DUPLICATE' THEN source || ': ' || CAST(occurrences AS VARCHAR) || ' occurrences'
       WHEN break_type = 'MISSING' AND source = 'source_a' THEN ticker || ' ' || a_str || ' ' || CAST(a_num AS VARCHAR) || '@' || CAST(unit_price AS VARCHAR)
       WHEN break_type = 'MISSING' THEN 'NOT FOUND'
       WHEN break_type = 'SIDE_BREAK' THEN a_str
       WHEN break_type IN ('QTY_BREAK', 'PRICE_BREAK') THEN CAST(a_num AS VARCHAR)
       WHEN break_type = 'SETTLE_BREAK' THEN strftime(a_date, '%Y-%m-%d') END AS source_a_value,
  CASE WHEN break_type = 'MISSING' AND source = 'source_b' THEN ticker || ' ' || b_str || ' ' || CAST(b_num AS VARCHAR) || '@' || CAST(unit_price AS VARCHAR)
       WHEN break_type = 'MISSING' THEN 'NOT FOUND'
       WHEN break_type = 'SIDE_BREAK' THEN b_str
       WHEN break_type IN ('QTY_BREAK', 'PRICE_BREAK') THEN CAST(b_num AS VARCHAR)
       WHEN break_type = 'SETTLE_BREAK' THEN strftime(b_date, '%Y-%m-%d') END AS source_b_value,
  CASE WHEN break_type = 'DUPLICATE' THEN 'Expected 1, found ' || CAST(occurrences AS VARCHAR)
       WHEN break_type = 'MISSING' AND source = 'source_a' THEN 'Trade present in Source A, absent in Source B'
       WHEN break_type = 'MISSING' THEN 'Trade present in Source B, absent in Source A'
       WHEN break_type = 'SIDE_BREAK' THEN 'Source A=' || a_str || ', Source B=' || b_str
       WHEN break_type = 'QTY_BREAK' THEN CAST(diff_num AS VARCHAR)
       WHEN break_type = 'PRICE_BREAK' THEN printf('%+.4f', diff_num)
       WHEN break_type = 'SETTLE_BREAK' THEN CAST(diff_days AS VARCHAR) || ' day(s)' END AS difference
FROM bx"""))
def render_breaks(spark, sf_dir):
    """the reference's text columns rendered from typed breaks."""
    return render(recon(spark, sf_dir).breaks()).select(
        "break_id", "break_type", "source_a_value", "source_b_value", "difference")
