"""A whole day through ``run_day``: an invented day, and a failing pre-flight."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import TRADE_HEADER
from test_reconcile import OWN_A, OWN_B
from tradetally.runner import SourceSpec, run_day
from tradetally.sinks.ledger import Ledger


def test_own_day(spark, tmpdir_path):
    for name, body in (("a.csv", OWN_A), ("b.csv", OWN_B)):
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write(TRADE_HEADER + "\n" + body + "\n")
    root = f"{tmpdir_path}/ledger"
    run = run_day(spark, root, "g1", dt.date(2026, 3, 1), SourceSpec(f"{tmpdir_path}/a.csv", "source_a"),
                  SourceSpec(f"{tmpdir_path}/b.csv", "source_b")).first()
    assert run["status"] == "COMPLETED"
    assert (run["total_breaks"], run["critical_breaks"], run["high_breaks"], run["medium_breaks"]) == (4, 0, 3, 1)
    assert (run["source_a_count"], run["source_b_count"], run["matched_count"]) == (8, 8, 5)
    led = Ledger(spark, root)
    assert led.get_breaks_for_run("g1").count() == 4
    actions = [r["action"] for r in led.get_audit_for_run("g1").collect()]
    assert actions[0] == "pre_flight_validation" and actions[-1] == "run_complete"
    assert actions.count("load_source") == 2
    import hashlib
    one = hashlib.sha256(open(f"{tmpdir_path}/a.csv", "rb").read()).hexdigest()
    whole = hashlib.sha256(f"a.csv:{one}".encode()).hexdigest()
    parts = [str(int(whole[i:i + 8], 16)) for i in range(0, 64, 8)]
    want = hashlib.sha256(":".join(["1", *parts]).encode()).hexdigest()
    hashes = {r["input_hash"] for r in led.get_audit_for_run("g1").collect() if r["action"] == "load_source"}
    assert want in hashes


def test_missing_source_fails_preflight(spark, tmpdir_path):
    root = f"{tmpdir_path}/ledger"
    run = run_day(spark, root, "f1", dt.date(2026, 3, 1), SourceSpec(f"{tmpdir_path}/none.csv", "source_a"),
                  SourceSpec(f"{tmpdir_path}/none_b.csv", "source_b")).first()
    assert run["status"] == "FAILED" and "not found" in run["error_message"]


def lineitem(spark, path):
    """Own rows: repeated, null and wide keys."""
    spark.range(400).selectExpr(
        "CASE WHEN id % 41 = 7 THEN NULL WHEN id % 5 = 1 THEN 3 + id % 20 ELSE id * 700001 END AS l_orderkey", "id % 7 AS l_linenumber",
        "id * 13 % 97 AS l_partkey", "id % 11 AS l_suppkey", "CAST(id % 50 AS DOUBLE) AS l_quantity", "id * 1.25D AS l_extendedprice",
        "date_add(DATE'1995-01-01', CAST(id % 90 AS INT)) AS l_shipdate", "CASE WHEN id % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag",
        "CASE WHEN id % 2 = 0 THEN 'O' ELSE 'F' END AS l_linestatus").repartition(3).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_feeds_are_sorted_before_their_columns_are_derived(spark, tmpdir_path):
    """The files hold the feed in its order, and the shuffle holds ``lineitem``'s columns only."""
    from tradetally.sources import fixtures as fx
    sf_dir = lineitem(spark, tmpdir_path)
    for side, feed in (("a", fx.feed_a), ("b", fx.feed_b)):
        got = fx.ordered_feed(spark, sf_dir, side)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "trade_id" not in plan[plan.index("Sort ["):].split("\n", 1)[1]
        want = feed(spark, sf_dir).orderBy("trade_id", *fx.FEED_ORDER)
        assert got.columns == want.columns and got.collect() == want.collect()


def test_break_ids_are_not_staged(spark, tmpdir_path, monkeypatch):
    import datetime as dt

    from tradetally.operators.reconcile import break_id, reconcile
    from tradetally.sources.fixtures import FEED_ORDER, feed_a, feed_b
    sf_dir = lineitem(spark, tmpdir_path)
    rows, staged, insert = [], [], Ledger._insert
    monkeypatch.setattr(Ledger, "_insert", lambda self, df, ids: (
        staged.append(set(spark.read.parquet(*df.inputFiles()).columns)), insert(self, df, ids))[1])
    breaks = reconcile(feed_a(spark, sf_dir), feed_b(spark, sf_dir), order_by=FEED_ORDER, run_id="r").breaks()
    for name, derived in (("whole", None), ("derived", {"break_id": break_id(F.col("run_id"))})):
        led = Ledger(spark, f"{tmpdir_path}/{name}")
        led.create_run("r", dt.date(2026, 3, 1))
        n = led.write_breaks(breaks, run_ids=["r"], derived=derived)
        assert led.write_breaks(breaks, run_ids=["r"], derived=derived) == 0
        got = led.read_breaks().drop("created_at")
        rows.append((n, got.columns, sorted(map(str, got.collect()))))
    assert rows[0] == rows[1] and rows[0][0] == len(rows[0][2]) > 0
    assert ["break_id" in s for s in staged] == [True, True, False, False]
