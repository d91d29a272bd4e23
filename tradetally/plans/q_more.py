"""Catalogue: loader edge cases, guards, ordered and unioned breaks, the
consideration check, excluded rows and routed breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradetally.functions.dates import parse_date
from tradetally.operators import dedupe, joins, routing, summary
from tradetally.operators import validate as V
from tradetally.operators.compare import Checks
from tradetally.operators.elect import elect
from tradetally.operators.normalise import MALFORMED
from tradetally.operators.reconcile import reconcile
from tradetally.plans import sql_dirty as D
from tradetally.plans import sql_feeds as S
from tradetally.plans.q_clean import normalised
from tradetally.plans.q_config import _RECIP, MASTER_SQL, RECIPIENTS, security_master_table
from tradetally.plans.q_ledger import audit_events
from tradetally.plans.q_match import BREAK_SELECT, RUN_ID, recon
from tradetally.plans.q_sources import CANON, FIXED_WIDTH, _canon, _fixture_dir, write_feed_csv
from tradetally.plans.registry import query
from tradetally.schemas import AUDIT_STATUSES
from tradetally.sinks.ledger import enum_violations
from tradetally.sources import readers
from tradetally.sources.fixtures import FEED_ORDER, feed_a, feed_b
from tradetally.sources.tables import table

_H = "CAST(regexp_extract(trade_id, 'TRD([0-9]+)-', 1) AS BIGINT) % 10"


@query("csv_malformed_rows", S.with_ctes(S.FEEDS, f"""
SELECT CASE WHEN k = 3 THEN 'surplus' ELSE 'short' END AS kind, count(*) AS n
FROM (SELECT {_H} AS k FROM feed_a) WHERE k IN (3, 4) GROUP BY 1
UNION ALL SELECT 'kept', count(*) FROM (SELECT {_H} AS k FROM feed_a) WHERE k NOT IN (3, 4)"""))
def csv_malformed_rows(spark, sf_dir):
    """An unquoted comma makes a field too many, a missing tail fields too
    few; both are quarantined whole, the other rows load."""
    path = _fixture_dir(spark, "feed_malformed")
    cols = [c for c in CANON if c != "source"]
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    k = F.expr(_H.replace("BIGINT", "LONG"))
    line = F.when(k == 3, F.concat(text, F.lit(",CONFIRMED"))).when(k == 4, F.concat_ws(",", *cols[:3])).otherwise(text)
    # one column whose name is the header line
    feed_a(spark, sf_dir).select(line.alias(",".join(cols))).write.option("header", True).option("quote", "") \
        .option("sep", "\uffff").csv(path)
    df = readers.load_csv(spark, path, "source_a", date_format="%Y-%m-%d", dates="quarantine")
    v = V.validate(df)
    fields = F.size(F.split(MALFORMED, ","))
    kind = (F.when(F.array_contains("errors", "row:malformed"), F.when(fields > len(cols), "surplus").otherwise("short"))
             .otherwise("kept"))
    return v.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("fixed_width_latin1", S.with_ctes(S.FEEDS, """
SELECT trade_id, 'Société ' || counterparty AS counterparty, broker, status FROM feed_a"""))
def fixed_width_latin1(spark, sf_dir):
    """A single-byte encoding; later fields keep their places."""
    path = _fixture_dir(spark, "feed_latin1")
    value = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c, _, _ in FIXED_WIDTH}
    value["counterparty"] = F.concat(F.lit("Société "), value["counterparty"])
    line = F.concat(*[F.rpad(value[n], e - s, " ") for n, s, e in FIXED_WIDTH])
    feed_a(spark, sf_dir).select(line.alias("value")).write.option("encoding", "ISO-8859-1").option("quote", "") \
        .option("sep", "\u0001").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    df = readers.load_fixed_width(spark, path, "source_a", colspecs=[(s, e) for _, s, e in FIXED_WIDTH],
                                  col_names=[n for n, _, _ in FIXED_WIDTH], encoding="ISO-8859-1", date_format="%Y-%m-%d")
    return _canon(df).select("trade_id", "counterparty", "broker", "status")


@query("source_guards", S.with_ctes(S.FEEDS, """
SELECT 'full' AS feed, 'loaded' AS outcome, count(*) AS n FROM feed_a
UNION ALL SELECT 'no rows', 'empty', 0 UNION ALL SELECT 'no side', 'missing columns', 0"""))
def source_guards(spark, sf_dir):
    """An empty source and one without a required column are refused."""
    feed, out = feed_a(spark, sf_dir).drop("l_suppkey", "source"), []
    for name, df in (("full", feed), ("no rows", feed.where("trade_id = ''")), ("no side", feed.drop("side"))):
        try:
            out.append((name, "loaded", readers.load_frame(df, "source_a", "%Y-%m-%d", dates="quarantine").count()))
        except readers.SourceError as e:
            out.append((name, "empty" if "is empty" in str(e) else "missing columns", 0))
    return spark.createDataFrame(out, "feed string, outcome string, n long")


@query("reference_csv", "WITH " + MASTER_SQL.strip() + """
SELECT upper(ticker) AS ticker, security_name, asset_class FROM master""")
def reference_csv(spark, sf_dir):
    """A security master read from CSV files."""
    path = _fixture_dir(spark, "master")
    master = security_master_table(spark, sf_dir)
    master.select(F.lower("ticker").alias(" Ticker "), F.col("security_name").alias("Security Name"),
                  "asset_class").write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.load_reference_csv(spark, path)


@query("dates_inferred", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders""")
def dates_inferred(spark, sf_dir):
    """P4 without a format: every order date written in one of four ways."""
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    text = F.element_at(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy/MM/dd"),
                                F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "yyyyMMdd")),
                        (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", parse_date(text).alias("parsed"))


@query("dates_elected", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS trade_date,
  make_date(year(o_orderdate), month(o_orderdate), least(day(o_orderdate), 12)) AS settlement_date,
  'dd/MM/yyyy' AS trade_format, 'dd/MM/yyyy' AS settlement_format FROM orders""")
def dates_elected(spark, sf_dir):
    """P4 without a format, for the whole column: days first, and a column
    that no value of its own decides takes the format of the source."""
    d = F.to_date("o_orderdate")
    early = F.make_date(F.year(d), F.month(d), F.least(F.dayofmonth(d), F.lit(12)))
    src = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "dd/MM/yyyy").alias("trade_date"),
                                                F.date_format(early, "dd/MM/yyyy").alias("settlement_date"))
    found = elect(src, ["trade_date", "settlement_date"])
    return src.select("o_orderkey", *[parse_date(F.col(c), f).alias(c) for c, f in found.items()],
                      F.lit(found["trade_date"]).alias("trade_format"),
                      F.lit(found["settlement_date"]).alias("settlement_format"))


@query("reference_csv_malformed", "WITH " + MASTER_SQL.strip() + """
SELECT upper(ticker) AS ticker, CASE WHEN length(ticker) % 2 = 1 THEN NULL ELSE security_name END AS security_name,
  length(ticker) % 2 = 1 AS malformed FROM master""")
def reference_csv_malformed(spark, sf_dir):
    """Rows of a security master that do not fit its header are kept and marked."""
    path = _fixture_dir(spark, "master_malformed")
    master = security_master_table(spark, sf_dir)
    odd = F.length("ticker") % 2 == 1
    line = F.concat("ticker", F.lit(","), "security_name", F.lit(","), "asset_class", F.when(odd, ",x,y").otherwise(""))
    lines = master.select(line.alias("ticker,security_name,asset_class"))
    lines.write.option("header", True).option("quote", "").option("sep", "\uffff").csv(path)
    back = readers.load_reference_csv(spark, path, malformed="quarantine")
    ticker = F.coalesce(F.col("ticker"), F.upper(F.split_part(F.col(MALFORMED), F.lit(","), F.lit(1))))
    return back.select(ticker.alias("ticker"), "security_name", F.col(MALFORMED).isNotNull().alias("malformed"))


_AUDIT = "SELECT event_id, user_id % 13 AS r, event_type, CAST(floor(value * 10) AS BIGINT) AS duration_ms FROM events"


@query("audit_violations", f"""
SELECT count(*) AS n, count(*) FILTER (WHERE duration_ms - 500 < 0) AS negative,
       count(*) FILTER (WHERE event_type = 'signup') AS unknown_status FROM ({_AUDIT})""")
def audit_violations(spark, sf_dir):
    """V14 and V15 as row conditions, over audit rows made to break them."""
    a = audit_events(spark, sf_dir).withColumn("duration_ms", F.col("duration_ms") - 500)
    bad = enum_violations(a, {"status": [s for s in AUDIT_STATUSES if s != "INFO"]})
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if(V.check_non_negative(["duration_ms"])).alias("negative"),
                 F.count_if(bad).alias("unknown_status"))


@query("recon_absent_column", S.with_ctes(S.SIDES + f""",
flagged AS (SELECT * REPLACE (false AS price_break, both_ids AND NOT (side_break OR qty_break OR settle_break) AS clean)
            FROM (SELECT *, {S.flags()}, n_a IS NOT NULL AND n_b IS NOT NULL AS both_ids FROM pairs))""", """
SELECT 'CLEAN' AS break_type, count(*) FILTER (WHERE clean) AS n FROM flagged
UNION ALL SELECT 'SIDE_BREAK', count(*) FILTER (WHERE side_break) FROM flagged
UNION ALL SELECT 'PRICE_BREAK', 0"""))
def recon_absent_column(spark, sf_dir):
    """A feed without prices switches the price check off."""
    b = feed_b(spark, sf_dir)
    r = reconcile(feed_a(spark, sf_dir), b.drop("price"), order_by=FEED_ORDER, run_id=RUN_ID, detail=False,
                  order_by_b=[c if c != "price" else "consideration" for c in FEED_ORDER])
    return r.summary().where(F.col("break_type").isin("CLEAN", "SIDE_BREAK", "PRICE_BREAK"))


_RANK = ("array_position(['DUPLICATE', 'MISSING', 'SIDE_BREAK', 'QTY_BREAK', 'PRICE_BREAK', 'SETTLE_BREAK'], break_type)")


@query("breaks_emission_order", S.with_ctes(S.BREAKS, f"""
SELECT step, trade_id, break_type, row_number() OVER (ORDER BY step, trade_id, {_RANK}) AS position FROM breaks"""))
def breaks_emission_order(spark, sf_dir):
    """Positions of all breaks in emission order."""
    kinds = ["DUPLICATE", "MISSING", "SIDE_BREAK", "QTY_BREAK", "PRICE_BREAK", "SETTLE_BREAK"]
    b = recon(spark, sf_dir).breaks().select("step", "trade_id", "break_type").withColumn(
        "rank", F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("break_type")))
    return summary.positioned(b, "step", "trade_id", "rank").drop("rank")


@query("break_lists_union", S.with_ctes(S.BREAKS, f"""
SELECT break_id, trade_id, break_type, source FROM ({BREAK_SELECT}) WHERE break_type IN ('DUPLICATE', 'MISSING')"""))
def break_lists_union(spark, sf_dir):
    """U4: break lists of two steps in one."""
    r = recon(spark, sf_dir)
    both = joins.concat_frames(r.breaks(kinds=["DUPLICATE"]), r.breaks(kinds=["MISSING"]))
    return both.select("break_id", "trade_id", "break_type", "source")


_CONSIDERATION = S.SIDES.replace("'source_b' AS source, h", "'source_b' AS source, h, l_suppkey % 10 AS cut").replace(
    "consideration, counterparty, broker, trader_id, status, l_suppkey, 'source_b'",
    "CASE WHEN l_suppkey % 10 = 3 THEN consideration + 5 ELSE consideration END AS consideration, "
    "counterparty, broker, trader_id, status, l_suppkey, 'source_b'").replace("EXCLUDE (h)", "EXCLUDE (h, cut)")
_CONS_FLAG = "(n_a IS NOT NULL AND n_b IS NOT NULL AND coalesce(abs(consideration_a - consideration_b) > 1.0, false))"


def _with_consideration(spark, sf_dir, detail):
    b = feed_b(spark, sf_dir)
    b = b.withColumn("consideration", F.when(F.col("l_suppkey") % 10 == 3, F.col("consideration") + 5)
                     .otherwise(F.col("consideration")))
    return reconcile(feed_a(spark, sf_dir), b, order_by=FEED_ORDER, run_id=RUN_ID,
                     checks=Checks(consideration=True), detail=detail)


@query("consideration_breaks", S.with_ctes(_CONSIDERATION, f"""
SELECT trade_id, consideration_a AS a_num, consideration_b AS b_num, consideration_a - consideration_b AS diff_num
FROM pairs WHERE {_CONS_FLAG}"""))
def consideration_breaks(spark, sf_dir):
    """D3 switched on."""
    return _with_consideration(spark, sf_dir, True).breaks(kinds=["CONSIDERATION_BREAK"]).select(
        "trade_id", "a_num", "b_num", "diff_num")


@query("run_summary_consideration", S.with_ctes(_CONSIDERATION + f""",
flagged AS (SELECT *, {S.flags()}, {_CONS_FLAG} AS cons FROM pairs)""", f"""
SELECT '{RUN_ID}' AS run_id,
  count(*) FILTER (WHERE dup_a) + count(*) FILTER (WHERE dup_b) + count(*) FILTER (WHERE missing_in_a OR missing_in_b)
  + count(*) FILTER (WHERE side_break) + count(*) FILTER (WHERE qty_break) + count(*) FILTER (WHERE price_break)
  + count(*) FILTER (WHERE settle_break) + count(*) FILTER (WHERE cons) AS total_breaks,
  count(*) FILTER (WHERE price_break) + count(*) FILTER (WHERE settle_break) + count(*) FILTER (WHERE cons) AS medium_breaks,
  count(*) FILTER (WHERE clean AND NOT cons) AS matched_count FROM flagged"""))
def run_summary_consideration(spark, sf_dir):
    """A6 with D3 on: the check's breaks are in every total."""
    return _with_consideration(spark, sf_dir, False).run_row().select("run_id", "total_breaks", "medium_breaks", "matched_count")


@query("excluded_rows", S.with_ctes(D.NORM + "," + S.FEEDS, """
SELECT count(*) FILTER (WHERE trade_id IS NOT NULL AND trade_id <> '') AS source_a_rows,
       count(*) FILTER (WHERE trade_id IS NULL OR trade_id = '') AS excluded_a_rows,
       (SELECT count(*) FROM feed_b) AS source_b_rows, 0 AS excluded_b_rows FROM norm"""))
def excluded_rows(spark, sf_dir):
    """Q11: rows without a usable id are left out of matching and counted."""
    a = normalised(spark, sf_dir).select(*[c for c in CANON], "ingest_seq")
    r = reconcile(a, feed_b(spark, sf_dir), order_by=["ingest_seq"], order_by_b=FEED_ORDER, run_id=RUN_ID, detail=False)
    return r.counts().select("source_a_rows", "excluded_a_rows", "source_b_rows", "excluded_b_rows")


@query("blank_id_rows", S.with_ctes(D.NORM, """
SELECT trade_id, isin, counterparty FROM norm WHERE trade_id IS NULL OR trim(trade_id) = ''"""))
def blank_id_rows(spark, sf_dir):
    """Q11: the excluded rows themselves."""
    return dedupe.blank_keys(normalised(spark, sf_dir)).select("trade_id", "isin", "counterparty")


@query("routed_breaks", S.with_ctes(S.BREAKS + f""", bx AS ({BREAK_SELECT}),
recipients(recipient_group, name, role, item) AS (VALUES {_RECIP})""", """
SELECT r.name, r.role, r.item, bx.break_id, bx.trade_id, bx.break_type, bx.severity FROM bx JOIN recipients r
ON r.item = 'all_breaks' OR (r.item = 'critical_breaks' AND bx.severity = 'CRITICAL')"""))
def routed_breaks(spark, sf_dir):
    """The breaks that each recipient receives."""
    return routing.routed_breaks(recon(spark, sf_dir).breaks(), routing.recipients_table(spark, RECIPIENTS)).drop("email")
