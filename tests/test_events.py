"""Event tables: compaction, keyed reads, lost jobs; the quarantine partition of an ingested feed."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import TRADE_HEADER
from test_reconcile import OWN_A
from tradetally.runner import SourceSpec, feed_path, ingest, quarantined
from tradetally.schemas import AUDIT_SCHEMA
from tradetally.sinks.events import EventTable
from tradetally.sinks.ledger import Ledger

T0 = dt.datetime(2026, 3, 1)


def audit(spark, lo, hi):
    """Rows of 20 runs, a third of them of run r07, some without a run."""
    rows = []
    for i in range(lo, hi):
        run = None if i % 50 == 0 else "r07" if i % 3 == 0 else f"r{i % 20:02d}"
        rows.append((f"id{i}", run, "agent", "act", "INFO", "x" * 40, i, None, None, T0 + dt.timedelta(seconds=i % 700)))
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def rows(df):
    return sorted(map(str, df.collect()))


def files(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_compaction_keeps_rows_and_prunes_files(spark, tmpdir_path):
    t = EventTable(spark, f"{tmpdir_path}/audit", AUDIT_SCHEMA, ["created_at"])
    assert t.read().count() == 0 and t.read_key("r01").count() == 0 and t.compact() is None
    whole = audit(spark, 0, 4000)
    t.append(audit(spark, 0, 2000).repartition(5))
    t.append(audit(spark, 2000, 3000).repartition(3))
    first = t.compact(file_bytes=4000)
    t.append(audit(spark, 3000, 4000).repartition(2))
    t.append(audit(spark, 0, 1))                                # a repeated row stays one
    whole = whole.unionByName(audit(spark, 0, 1))
    sorted_files = [f for f in os.listdir(f"{first}/rows") if f.endswith(".parquet")]
    assert len(sorted_files) > 8
    for run in ("r01", "r07", "r19", "none"):
        got = t.read_key(run)
        assert rows(got) == rows(whole.where(f"run_id = '{run}'"))
        read = files(got) & set(sorted_files)
        holds = {f for f in sorted_files if spark.read.parquet(f"{first}/rows/{f}").where(f"run_id = '{run}'").count()}
        assert holds <= read and len(read) <= len(holds) + 2     # its own files and what borders on them
    assert len(files(t.read_key("r07")) & set(sorted_files)) > 2  # a hot run spans files
    assert rows(t.read()) == rows(whole)
    second = t.compact()
    assert second != first and t.compact() == second
    assert rows(t.read()) == rows(whole) and rows(t.read_key("r07")) == rows(whole.where("run_id = 'r07'"))
    small = len(t._small())
    t.tidy()
    assert 0 < len(t._small()) < small
    assert rows(t.read()) == rows(whole)
    t.append(audit(spark, 5000, 5010))
    t.compact()
    t.tidy()
    assert len(t._generations()) == 2 and first not in t._generations()
    assert rows(t.read()) == rows(whole.unionByName(audit(spark, 5000, 5010)))


def test_a_lost_compaction_changes_nothing(spark, tmpdir_path):
    t = EventTable(spark, f"{tmpdir_path}/audit", AUDIT_SCHEMA, ["created_at"])
    t.append(audit(spark, 0, 100))
    kept = rows(t.read())
    first = t.compact()
    t.append(audit(spark, 100, 120))
    os.makedirs(f"{t.sorted_path}/0000000001-lost")               # rows written, ranges not
    audit(spark, 0, 7).write.parquet(f"{t.sorted_path}/0000000001-lost/rows")
    assert t._generations() == [first]
    assert rows(t.read()) == sorted(kept + rows(audit(spark, 100, 120)))
    t.compact()
    assert rows(t.read()) == sorted(kept + rows(audit(spark, 100, 120)))


def test_ledger_reads_after_compaction(spark, tmpdir_path):
    led = Ledger(spark, f"{tmpdir_path}/ledger")
    for run in ("a", "b", "c"):
        led.create_run(run, dt.date(2026, 3, 1))
        led.quick_audit("agent", "start", "INFO", run_id=run)
        led.quick_audit("agent", "end", "SUCCESS", run_id=run)
    led.complete_run("b", "COMPLETED", {"total_breaks": 3})
    led.compact()
    led.complete_run("c", "FAILED")
    led.compact()
    assert {r["run_id"]: r["status"] for r in led.runs().collect()} == {"a": "RUNNING", "b": "COMPLETED", "c": "FAILED"}
    assert led.get_run("b").first()["total_breaks"] == 3 and led.get_run("z").count() == 0
    assert [r["action"] for r in led.get_audit_for_run("b").collect()] == ["start", "end"]


def test_feed_is_written_once_and_quarantine_is_a_partition(spark, tmpdir_path):
    bad = "\nBAD1,2026-03-01,2026-02-01,ABC,short,HOLD,-5,0,1,CP,BR,,PENDING"
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write(TRADE_HEADER + "\n" + OWN_A + bad + "\n")
    led = Ledger(spark, f"{tmpdir_path}/ledger")
    led.create_run("q", dt.date(2026, 3, 1))
    ing = ingest(spark, led, "q", SourceSpec(f"{tmpdir_path}/a.csv", "source_a"))
    assert ing.invalid_count == 1 and len(ing.errors) == 1 and ing.errors[0].startswith("source_a[BAD1]: ")
    assert sorted(d for d in os.listdir(feed_path(led, "q", "source_a")) if "=" in d) == ["valid=false", "valid=true"]
    q = quarantined(ing.frame)
    assert [r["trade_id"] for r in q.collect()] == ["BAD1"]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(valid" in plan and "csv" not in plan.lower()
    assert not os.path.exists(f"{tmpdir_path}/ledger/quarantine")


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_now_is_utc_wherever_the_driver_is(spark, tmpdir_path, monkeypatch, zone):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        led = Ledger(spark, f"{tmpdir_path}/ledger")
        led.create_run("n", dt.date(2026, 3, 1))
        led.complete_run("n", "COMPLETED")
        led.quick_audit("agent", "act", "INFO", run_id="n")
        led.create_run("given", dt.date(2026, 3, 1), started_at=dt.datetime(2026, 3, 1, 12))
        off = [F.abs(F.unix_timestamp(c) - F.unix_timestamp(F.current_timestamp())) for c in ("started_at", "completed_at", "updated_at")]
        assert max(led.get_run("n").select(*off).first()) < 120
        assert led.get_audit_for_run("n").select(F.abs(F.unix_timestamp("created_at") - F.unix_timestamp(F.current_timestamp()))).first()[0] < 120
        assert led.get_run("given").select(F.date_format("started_at", "HH:mm")).first()[0] == "12:00"
        state = led.get_run("n").select("status", "event_seq").first()
        assert (state.status, state.event_seq) == ("COMPLETED", 0)  # completed later than created
    finally:
        monkeypatch.undo()
        time.tzset()
