"""Catalogue: matching core (C, J, U, W, A1-A4, O3) over feeds A and B."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.operators import dedupe, joins, summary
from tradetally.operators.compare import Tolerances
from tradetally.operators.reconcile import Reconciliation, reconcile
from tradetally.plans import sql_feeds as S
from tradetally.plans.registry import query
from tradetally.sources.fixtures import FEED_ORDER, feed_a, feed_b

RUN_ID = "run-0001"


def recon(spark: SparkSession, sf_dir: str, **kw) -> Reconciliation:
    return reconcile(feed_a(spark, sf_dir), feed_b(spark, sf_dir), order_by=FEED_ORDER,
                     run_id=RUN_ID, **kw)


BREAK_SELECT = (f"SELECT sha256(concat_ws('|', '{RUN_ID}', CAST(step AS VARCHAR), source, break_type, trade_id)) "
                f"AS break_id, '{RUN_ID}' AS run_id, * FROM breaks")

SUMMARY_SQL = S.with_ctes(S.FLAGGED, """
SELECT 'CLEAN' AS break_type, count(*) FILTER (WHERE clean) AS n FROM flagged
UNION ALL SELECT 'DUPLICATE', count(*) FILTER (WHERE dup_a) + count(*) FILTER (WHERE dup_b) FROM flagged
UNION ALL SELECT 'MISSING', count(*) FILTER (WHERE missing_in_a OR missing_in_b) FROM flagged
UNION ALL SELECT 'SIDE_BREAK', count(*) FILTER (WHERE side_break) FROM flagged
UNION ALL SELECT 'QTY_BREAK', count(*) FILTER (WHERE qty_break) FROM flagged
UNION ALL SELECT 'PRICE_BREAK', count(*) FILTER (WHERE price_break) FROM flagged
UNION ALL SELECT 'SETTLE_BREAK', count(*) FILTER (WHERE settle_break) FROM flagged""")


@query("recon_summary", SUMMARY_SQL)
def recon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: break counts per type plus the clean-match count."""
    return recon(spark, sf_dir, detail=False).summary()


@query("recon_breaks", S.with_ctes(S.BREAKS, BREAK_SELECT))
def recon_breaks(spark, sf_dir):
    return recon(spark, sf_dir).breaks()


@query("duplicates_a", S.with_ctes(S.FEEDS, """
SELECT trade_id, count(*) AS occurrences FROM feed_a WHERE trade_id IS NOT NULL
GROUP BY trade_id HAVING count(*) > 1"""))
def duplicates_a(spark, sf_dir):
    return dedupe.duplicate_groups(feed_a(spark, sf_dir), sort=True)


@query("duplicates_b", S.with_ctes(S.FEEDS, """
SELECT trade_id, count(*) AS occurrences FROM feed_b WHERE trade_id IS NOT NULL
GROUP BY trade_id HAVING count(*) > 1"""))
def duplicates_b(spark, sf_dir):
    return dedupe.duplicate_groups(feed_b(spark, sf_dir))


@query("duplicate_rows_b", S.with_ctes(S.FEEDS, """
SELECT trade_id, side, quantity, price, count(*) OVER (PARTITION BY trade_id) > 1 AS is_duplicate
FROM feed_b"""))
def duplicate_rows_b(spark, sf_dir):
    """Every row of B marked when its id occurs more than once."""
    return (dedupe.mark_duplicates(feed_b(spark, sf_dir))
            .select("trade_id", "side", "quantity", "price", "is_duplicate"))


_FIRST_COLS = ("trade_id, trade_date, settlement_date, ticker, isin, side, quantity, price, "
               "consideration, counterparty, broker, status, l_suppkey")


@query("dedup_first_b", S.with_ctes(S.FEEDS, f"""
SELECT {_FIRST_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY {S.ORDER}) AS rn FROM feed_b
) WHERE rn = 1"""))
def dedup_first_b(spark, sf_dir):
    """The surviving first copy of each id in B."""
    cols = [c.strip() for c in _FIRST_COLS.split(",")]
    return dedupe.keep_first(feed_b(spark, sf_dir).select(*cols), FEED_ORDER)


@query("dedup_first_a", S.with_ctes(S.FEEDS, f"""
SELECT {_FIRST_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY {S.ORDER}) AS rn FROM feed_a
) WHERE rn = 1"""))
def dedup_first_a(spark, sf_dir):
    """W1 on A (whose copies come from the table's own repeated keys)."""
    cols = [c.strip() for c in _FIRST_COLS.split(",")]
    return dedupe.keep_first(feed_a(spark, sf_dir).select(*cols), FEED_ORDER)


_MISSING_COLS = "trade_id, ticker, side, quantity, price"
# what crosses the shuffle: the key, the order keys and the output columns
_CARRIED = list(dict.fromkeys(_MISSING_COLS.split(", ") + FEED_ORDER))


@query("missing_in_b", S.with_ctes(S.SIDES, f"""
SELECT {_MISSING_COLS} FROM fa WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fb.trade_id = fa.trade_id)"""))
def missing_in_b(spark, sf_dir):
    """First copy of every A trade whose id is absent from B."""
    a = dedupe.keep_first(dedupe.valid_key(feed_a(spark, sf_dir)).select(*_CARRIED), FEED_ORDER)
    return joins.missing_from(a, feed_b(spark, sf_dir)).select(*_MISSING_COLS.split(", "))


@query("missing_in_a", S.with_ctes(S.SIDES, f"""
SELECT {_MISSING_COLS} FROM fb WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.trade_id = fb.trade_id)"""))
def missing_in_a(spark, sf_dir):
    """First copy of every B trade whose id is absent from A."""
    b = dedupe.keep_first(dedupe.valid_key(feed_b(spark, sf_dir)).select(*_CARRIED), FEED_ORDER)
    return joins.missing_from(b, feed_a(spark, sf_dir)).select(*_MISSING_COLS.split(", "))


@query("common_ids", S.with_ctes(S.FEEDS, """
SELECT trade_id FROM feed_a INTERSECT SELECT trade_id FROM feed_b"""))
def common_ids(spark, sf_dir):
    return joins.common_ids(feed_a(spark, sf_dir), feed_b(spark, sf_dir))


@query("ids_only_a", S.with_ctes(S.FEEDS, """
SELECT trade_id FROM feed_a EXCEPT SELECT trade_id FROM feed_b"""))
def ids_only_a(spark, sf_dir):
    return joins.ids_only_in(feed_a(spark, sf_dir), feed_b(spark, sf_dir))


@query("ids_only_b", S.with_ctes(S.FEEDS, """
SELECT trade_id FROM feed_b EXCEPT SELECT trade_id FROM feed_a"""))
def ids_only_b(spark, sf_dir):
    return joins.ids_only_in(feed_b(spark, sf_dir), feed_a(spark, sf_dir))


@query("distinct_ids_b", S.with_ctes(S.FEEDS, "SELECT DISTINCT trade_id FROM feed_b"))
def distinct_ids_b(spark, sf_dir):
    """A8."""
    return joins.distinct_ids(feed_b(spark, sf_dir))


@query("common_trades", S.with_ctes(S.FEEDS, """
SELECT trade_id, side, quantity, price, source FROM feed_a
WHERE EXISTS (SELECT 1 FROM feed_b WHERE feed_b.trade_id = feed_a.trade_id)"""))
def common_trades(spark, sf_dir):
    """Rows of A (all copies) whose id is present in B."""
    return (joins.common_trades(feed_a(spark, sf_dir), feed_b(spark, sf_dir))
            .select("trade_id", "side", "quantity", "price", "source"))


@query("matched_pairs", S.with_ctes(S.SIDES, """
SELECT fa.trade_id, fa.side AS side_a, fb.side AS side_b, fa.quantity AS quantity_a,
       fb.quantity AS quantity_b, fa.price AS price_a, fb.price AS price_b,
       fa.settlement_date AS settlement_date_a, fb.settlement_date AS settlement_date_b
FROM fa JOIN fb ON fa.trade_id = fb.trade_id"""))
def matched_pairs(spark, sf_dir):
    """J3 on deduplicated sides, ``_a``/``_b`` suffixes."""
    cols = ["trade_id", "side", "quantity", "price", "settlement_date"]
    carried = list(dict.fromkeys(cols + FEED_ORDER))
    a = dedupe.keep_first(feed_a(spark, sf_dir).select(*carried), FEED_ORDER).select(*cols)
    b = dedupe.keep_first(feed_b(spark, sf_dir).select(*carried), FEED_ORDER).select(*cols)
    return joins.matched_pairs(a, b)


def _typed(bt: str) -> str:
    return S.with_ctes(S.BREAKS, BREAK_SELECT.replace("FROM breaks", f"FROM breaks WHERE break_type = '{bt}'"))


def _breaks_of(spark, sf_dir, bt):
    return recon(spark, sf_dir).breaks(kinds=[bt])


@query("side_breaks", _typed("SIDE_BREAK"))
def side_breaks(spark, sf_dir):
    return _breaks_of(spark, sf_dir, "SIDE_BREAK")


@query("qty_breaks", _typed("QTY_BREAK"))
def qty_breaks(spark, sf_dir):
    return _breaks_of(spark, sf_dir, "QTY_BREAK")


@query("price_breaks", _typed("PRICE_BREAK"))
def price_breaks(spark, sf_dir):
    return _breaks_of(spark, sf_dir, "PRICE_BREAK")


@query("settle_breaks", _typed("SETTLE_BREAK"))
def settle_breaks(spark, sf_dir):
    return _breaks_of(spark, sf_dir, "SETTLE_BREAK")


@query("clean_count", S.with_ctes(S.FLAGGED, """
SELECT count(*) FILTER (WHERE clean) AS clean_count,
       count(*) FILTER (WHERE n_a IS NOT NULL AND n_b IS NOT NULL) AS matched_ids FROM flagged"""))
def clean_count(spark, sf_dir):
    """C5 / A4."""
    c = recon(spark, sf_dir, detail=False).counts()
    return c.select(F.col("clean").alias("clean_count"), "matched_ids")


_TOL1 = S.SIDES + f""",
flagged AS (SELECT *, {S.flags(settle_tol='1', price_tol='0.05::DOUBLE')} FROM pairs)"""


@query("settle_tolerance_1", S.with_ctes(_TOL1, """
SELECT 'CLEAN' AS break_type, count(*) FILTER (WHERE clean) AS n FROM flagged
UNION ALL SELECT 'PRICE_BREAK', count(*) FILTER (WHERE price_break) FROM flagged
UNION ALL SELECT 'SETTLE_BREAK', count(*) FILTER (WHERE settle_break) FROM flagged"""))
def settle_tolerance_1(spark, sf_dir):
    """C4/C11 with wider tolerances: 1 settlement day and 0.05 price."""
    r = recon(spark, sf_dir, tolerances=Tolerances(price=0.05, settlement_days=1), detail=False)
    return r.summary().where(F.col("break_type").isin("CLEAN", "PRICE_BREAK", "SETTLE_BREAK"))


@query("severity_counts", S.with_ctes(S.BREAKS, """
SELECT severity, count(*) AS n FROM breaks GROUP BY severity"""))
def severity_counts(spark, sf_dir):
    """A2."""
    return recon(spark, sf_dir, detail=False).severity_counts()


@query("type_counts", S.with_ctes(S.BREAKS, """
SELECT break_type, count(*) AS n FROM breaks GROUP BY break_type"""))
def type_counts(spark, sf_dir):
    """A3 / O6."""
    return recon(spark, sf_dir, detail=False).type_counts()


_ORDERED = S.with_ctes(S.BREAKS, BREAK_SELECT.replace("SELECT sha256", """SELECT *, row_number() OVER (
  ORDER BY severity, break_type, trade_id, step) AS position FROM (SELECT sha256""") + ")")


@query("breaks_ordered_topk", _ORDERED)
def breaks_ordered_topk(spark, sf_dir):
    """O3: every break of a run with its position by (severity, break_type) lexical,
    then trade id and step."""
    return summary.positioned(recon(spark, sf_dir).breaks(), "severity", "break_type", "trade_id", "step")


@query("missing_trades", S.with_ctes(S.SIDES, """
SELECT trade_id, ticker, side, quantity, price, 'source_a' AS source FROM fa
WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fb.trade_id = fa.trade_id)
UNION ALL
SELECT trade_id, ticker, side, quantity, price, 'source_b' AS source FROM fb
WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.trade_id = fb.trade_id)"""))
def missing_trades(spark, sf_dir):
    """Both directions of missing trades, ids ascending per direction."""
    return joins.detect_missing(feed_a(spark, sf_dir), feed_b(spark, sf_dir), FEED_ORDER, sort=True)


@query("derived_consideration", S.with_ctes(S.FEEDS, """
SELECT trade_id, quantity, price, round(quantity * price, 2) AS derived_consideration,
       abs(round(quantity * price, 2) - consideration) <= 0.01 AS agrees
FROM feed_a"""))
def derived_consideration(spark, sf_dir):
    """Consideration recomputed as round(quantity * price, 2)."""
    from tradetally.functions.numeric import derived_consideration as dc
    a = feed_a(spark, sf_dir)
    d = dc(F.col("quantity"), F.col("price"))
    return a.select("trade_id", "quantity", "price", d.alias("derived_consideration"),
                    (F.abs(d - F.col("consideration")) <= 0.01).alias("agrees"))


@query("matched_pair_counts", S.with_ctes(S.FEEDS, """
SELECT a.trade_id, CAST(max(a.n) AS BIGINT) AS n_a, CAST(max(b.n) AS BIGINT) AS n_b, count(*) AS pairs,
       count(*) FILTER (WHERE a.side = b.side) AS same_side,
       count(*) FILTER (WHERE a.settlement_date = b.settlement_date) AS same_settlement_date
FROM (SELECT *, count(*) OVER (PARTITION BY trade_id) AS n FROM feed_a) a
JOIN (SELECT *, count(*) OVER (PARTITION BY trade_id) AS n FROM feed_b) b ON a.trade_id = b.trade_id
GROUP BY a.trade_id"""))
def matched_pair_counts(spark, sf_dir):
    """J3 on feeds with repeated ids: pairs counted and compared, not listed."""
    return joins.pair_counts(feed_a(spark, sf_dir), feed_b(spark, sf_dir), same=["side", "settlement_date"])
