"""Catalogue: run/audit event tables and the break ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.functions.ids import sha256_hex
from tradetally.operators.summary import run_status as status_of
from tradetally.plans import sql_feeds as S
from tradetally.plans.q_match import BREAK_SELECT, RUN_ID, recon
from tradetally.plans.registry import query
from tradetally.session import scratch_path
from tradetally.sinks import ledger as L
from tradetally.sinks.tables import staged
from tradetally.sources.tables import table


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events derived from ``events``: one run per ``user_id mod 10``;
    signups open a run, other events update it."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.concat(F.lit("run-"), (F.col("user_id") % 10).cast("string")).alias("run_id"),
        F.col("ts").alias("updated_at"), F.col("event_id").alias("event_seq"),
        F.when(et == "signup", "create").otherwise("complete").alias("event"),
        F.when(et == "signup", "RUNNING").when(et == "purchase", "COMPLETED")
         .when(et == "error", "FAILED").otherwise("PARTIAL").alias("status"),
        F.floor("value").cast("bigint").alias("total_breaks"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows derived from ``events`` (run ids over ``user_id mod 13``, so
    some reference runs that do not exist)."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        sha256_hex(F.col("event_id").cast("string")).alias("audit_id"),
        F.concat(F.lit("run-"), (F.col("user_id") % 13).cast("string")).alias("run_id"),
        F.concat(et, F.lit("_agent")).alias("agent_name"),
        F.concat(F.lit("event_"), et).alias("action"),
        F.when(et == "error", "FAILURE").when(et == "signup", "INFO").otherwise("SUCCESS").alias("status"),
        F.to_json(F.struct("event_id", "user_id", "event_type")).alias("detail"),
        F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"),
        F.col("ts").alias("created_at"))


RUN_EVENTS_SQL = """
ev AS (
  SELECT 'run-' || CAST(user_id % 10 AS VARCHAR) AS run_id, ts AS updated_at, event_id AS event_seq,
         CASE WHEN event_type = 'signup' THEN 'create' ELSE 'complete' END AS event,
         CASE WHEN event_type = 'signup' THEN 'RUNNING' WHEN event_type = 'purchase' THEN 'COMPLETED'
              WHEN event_type = 'error' THEN 'FAILED' ELSE 'PARTIAL' END AS status,
         CAST(floor(value) AS BIGINT) AS total_breaks
  FROM events
),
runs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, event_seq DESC) AS rn FROM ev
  ) WHERE rn = 1 AND run_id IN (SELECT run_id FROM ev WHERE event = 'create')
),
audit AS (
  SELECT sha256(CAST(event_id AS VARCHAR)) AS audit_id, 'run-' || CAST(user_id % 13 AS VARCHAR) AS run_id,
         event_type || '_agent' AS agent_name, 'event_' || event_type AS action,
         CASE WHEN event_type = 'error' THEN 'FAILURE' WHEN event_type = 'signup' THEN 'INFO' ELSE 'SUCCESS' END AS status,
         CAST(json_object('event_id', event_id, 'user_id', user_id, 'event_type', event_type) AS VARCHAR) AS detail,
         CAST(floor(value * 10) AS BIGINT) AS duration_ms, ts AS created_at
  FROM events
)"""


@query("runs_latest", S.with_ctes(RUN_EVENTS_SQL, """
SELECT run_id, status, event, updated_at, event_seq, total_breaks FROM runs"""))
def runs_latest(spark, sf_dir):
    """Latest state per run from an append-only event table."""
    return L.latest_run_state(run_events(spark, sf_dir)).select(
        "run_id", "status", "event", "updated_at", "event_seq", "total_breaks")


@query("runs_latest_clock", """
WITH ev AS (SELECT 'run-' || CAST(user_id % 10 AS VARCHAR) AS run_id, date_trunc('day', ts) AS updated_at,
    event_id % 4 AS event_seq, 'writer-' || CAST(event_id // 4 % 5 AS VARCHAR) || '-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS writer,
    CASE WHEN event_type = 'signup' THEN 'create' ELSE 'complete' END AS event FROM events)
SELECT run_id, updated_at, event_seq, writer, event FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, event_seq DESC, writer DESC) AS rn FROM ev
) WHERE rn = 1 AND run_id IN (SELECT run_id FROM ev WHERE event = 'create')""")
def runs_latest_clock(spark, sf_dir):
    """W4 with many events of one instant: number and writer decide."""
    ev = run_events(spark, sf_dir).withColumn("id", F.col("event_seq")).select(
        "run_id", F.date_trunc("day", "updated_at").alias("updated_at"), (F.col("id") % 4).alias("event_seq"),
        F.concat(F.lit("writer-"), (F.floor(F.col("id") / 4) % 5).cast("string"), F.lit("-"),
                 F.lpad(F.col("id").cast("string"), 12, "0")).alias("writer"), "event")
    return L.latest_run_state(ev).select("run_id", "updated_at", "event_seq", "writer", "event")


@query("run_lookup", S.with_ctes(RUN_EVENTS_SQL, """
SELECT run_id, status, updated_at FROM runs WHERE run_id = 'run-7'"""))
def run_lookup(spark, sf_dir):
    """L1."""
    r = L.latest_run_state(run_events(spark, sf_dir))
    return r.where(F.col("run_id") == "run-7").select("run_id", "status", "updated_at")


@query("audit_json", S.with_ctes(RUN_EVENTS_SQL, "SELECT * FROM audit"))
def audit_json(spark, sf_dir):
    """Audit entries with a JSON detail payload."""
    return audit_events(spark, sf_dir)


@query("audit_for_run", S.with_ctes(RUN_EVENTS_SQL, """
SELECT audit_id, action, status, created_at FROM audit WHERE run_id = 'run-3' ORDER BY created_at"""))
def audit_for_run(spark, sf_dir):
    """L3: one run's audit trail in time order."""
    a = audit_events(spark, sf_dir)
    return (a.where(F.col("run_id") == "run-3").orderBy("created_at")
             .select("audit_id", "action", "status", "created_at"))


@query("audit_for_run_clustered", S.with_ctes(RUN_EVENTS_SQL, """
SELECT audit_id, action, status, created_at FROM audit WHERE run_id = 'run-3'"""))
def audit_for_run_clustered(spark, sf_dir):
    """L3 from a stored table: audit rows appended before and after a compaction."""
    audit = L.Ledger(spark, scratch_path(spark, "ledger")).audit_table()
    rows = audit_events(spark, sf_dir).withColumn("input_hash", F.lit(None)).withColumn("error_message", F.lit(None))
    late = F.col("status") == "FAILURE"
    audit.append(rows.where(~late))
    audit.compact()
    audit.append(rows.where(late))
    return audit.read_key("run-3").select("audit_id", "action", "status", "created_at")


@query("fk_violations", S.with_ctes(RUN_EVENTS_SQL, """
SELECT audit_id, run_id FROM audit WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM runs)"""))
def fk_violations(spark, sf_dir):
    """K6: audit rows whose run does not exist."""
    runs = L.latest_run_state(run_events(spark, sf_dir))
    return L.fk_violations(audit_events(spark, sf_dir), runs).select("audit_id", "run_id")


@query("run_status", S.with_ctes(RUN_EVENTS_SQL, """
SELECT run_id, error_count, total_breaks,
       CASE WHEN error_count > 0 AND total_breaks = 0 THEN 'FAILED' WHEN error_count > 0 THEN 'PARTIAL'
            ELSE 'COMPLETED' END AS status
FROM (SELECT run_id, count(*) FILTER (WHERE status = 'FAILED') AS error_count,
             count(*) FILTER (WHERE status = 'COMPLETED') AS total_breaks FROM ev GROUP BY run_id)"""))
def run_status(spark, sf_dir):
    """A7 per run: error events and completed events decide the final status."""
    ev = run_events(spark, sf_dir)
    g = ev.groupBy("run_id").agg(F.count_if(F.col("status") == "FAILED").alias("error_count"),
                                 F.count_if(F.col("status") == "COMPLETED").alias("total_breaks"))
    return g.select("run_id", "error_count", "total_breaks",
                    status_of(F.col("error_count"), F.col("total_breaks")).alias("status"))


@query("run_summary", S.with_ctes(S.FLAGGED, f"""
SELECT '{RUN_ID}' AS run_id,
  count(*) FILTER (WHERE dup_a) + count(*) FILTER (WHERE dup_b) + count(*) FILTER (WHERE missing_in_a OR missing_in_b)
  + count(*) FILTER (WHERE side_break) + count(*) FILTER (WHERE qty_break) + count(*) FILTER (WHERE price_break)
  + count(*) FILTER (WHERE settle_break) AS total_breaks,
  count(*) FILTER (WHERE side_break) AS critical_breaks,
  count(*) FILTER (WHERE dup_a) + count(*) FILTER (WHERE dup_b) + count(*) FILTER (WHERE missing_in_a OR missing_in_b)
  + count(*) FILTER (WHERE qty_break) AS high_breaks,
  count(*) FILTER (WHERE price_break) + count(*) FILTER (WHERE settle_break) AS medium_breaks,
  CAST(coalesce(sum(n_a), 0) AS BIGINT) AS source_a_count, CAST(coalesce(sum(n_b), 0) AS BIGINT) AS source_b_count,
  count(*) FILTER (WHERE clean) AS matched_count,
  (SELECT count(*) FROM feed_a WHERE trade_id IS NULL OR trim(trade_id) = '') AS excluded_a_rows,
  (SELECT count(*) FROM feed_b WHERE trade_id IS NULL OR trim(trade_id) = '') AS excluded_b_rows
FROM flagged"""))
def run_summary(spark, sf_dir):
    """The run row from one aggregate over the matched pairs."""
    return recon(spark, sf_dir, detail=False).run_row()


@query("breaks_insert_ignore", S.with_ctes(S.BREAKS, f"""
SELECT break_id, trade_id, break_type FROM ({BREAK_SELECT}) WHERE step > 2"""))
def breaks_insert_ignore(spark, sf_dir):
    """K1: new breaks minus those already stored (here: the duplicate breaks
    of an earlier partial write), by ``break_id``."""
    new = staged(recon(spark, sf_dir).breaks(), "new-breaks")  # computed once, read twice
    existing = new.where(F.col("step") <= 2)
    return L.insert_ignore(new, existing).select("break_id", "trade_id", "break_type")


@query("explanations_merge", S.with_ctes(S.BREAKS, f"""
SELECT break_id, break_type,
       CASE WHEN break_type = 'SIDE_BREAK' THEN 'Side differs: ' || a_str || ' vs ' || b_str END AS explanation
FROM ({BREAK_SELECT})"""))
def explanations_merge(spark, sf_dir):
    """K5: explanations arrive as a table and are merged onto the breaks."""
    b = staged(recon(spark, sf_dir).breaks(), "breaks")  # computed once, read twice
    exp = (b.where(F.col("break_type") == "SIDE_BREAK")
            .select("break_id", F.concat(F.lit("Side differs: "), "a_str", F.lit(" vs "), "b_str")
                    .alias("explanation"), F.current_timestamp().alias("explained_at")))
    return L.merge_explanations(b, exp).select("break_id", "break_type", "explanation")


@query("explanations_written", S.with_ctes(S.BREAKS, f"""
SELECT break_id, break_type,
       CASE WHEN break_type = 'SIDE_BREAK' THEN 'Side differs: ' || a_str || ' vs ' || b_str
            WHEN break_type = 'MISSING' THEN 'No counterpart' END AS explanation
FROM ({BREAK_SELECT})"""))
def explanations_written(spark, sf_dir):
    """K5 end to end: explanations of a stored run are written, those of side
    breaks a second time; reads show the later ones."""
    led = L.Ledger(spark, scratch_path(spark, "ledger"))
    led.create_run(RUN_ID, dt.date(2026, 3, 1))
    led.write_breaks(recon(spark, sf_dir).breaks(), run_ids=[RUN_ID])
    kind, stored = F.col("break_type"), led.read_breaks()
    led.update_break_explanations(stored.where(kind.isin("SIDE_BREAK", "MISSING"))
                                  .select("break_id", F.lit("No counterpart").alias("explanation")))
    led.update_break_explanations(stored.where(kind == "SIDE_BREAK").select(
        "break_id", F.concat(F.lit("Side differs: "), "a_str", F.lit(" vs "), "b_str").alias("explanation")))
    return led.get_breaks_for_run(RUN_ID).select("break_id", "break_type", "explanation")


@query("ledger_breaks_for_run", S.with_ctes(S.BREAKS, f"""
SELECT break_id, trade_id, break_type, severity, step FROM ({BREAK_SELECT})"""))
def ledger_breaks_for_run(spark, sf_dir):
    """K1 + K2 + L2 end to end: open a run, write its breaks twice (the second
    write inserts nothing), read them back by run id."""
    led = L.Ledger(spark, scratch_path(spark, "ledger"))
    led.create_run(RUN_ID, dt.date(2026, 3, 1))
    breaks = staged(recon(spark, sf_dir).breaks(), "new-breaks")  # computed once, written twice
    led.write_breaks(breaks, run_ids=[RUN_ID], stored=True)
    led.write_breaks(breaks, run_ids=[RUN_ID], stored=True)
    return led.get_breaks_for_run(RUN_ID).select("break_id", "trade_id", "break_type", "severity", "step")
