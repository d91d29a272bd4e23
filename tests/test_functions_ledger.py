"""Business days (F7), ids (F6), rendering, ledger tables (K, L, W4), routing and escalation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import trades_df
from tradetally.functions.dates import add_business_days, to_spark_pattern
from tradetally.operators import routing, summary
from tradetally.operators.reconcile import pair_frame, reconcile
from tradetally.sinks.ledger import Ledger, LedgerError


def brute_force(d: dt.date, n: int) -> dt.date:
    added = 0
    while added < n:
        d += dt.timedelta(days=1)
        if d.weekday() < 5:
            added += 1
    return d


def test_business_days_against_loop(spark):
    cases = [(dt.date(2024, 1, 1) + dt.timedelta(days=k), n) for k in range(21) for n in range(12)]
    df = spark.createDataFrame(cases, "d date, n int")
    got = df.select("d", "n", add_business_days(F.col("d"), F.col("n")).alias("s")).collect()
    bad = [(r["d"], r["n"]) for r in got if r["s"] != brute_force(r["d"], r["n"])]
    assert len(got) == 252 and bad == []


def test_strptime_mapping():
    assert to_spark_pattern("%Y-%m-%d") == "yyyy-MM-dd"
    assert to_spark_pattern("%d/%m/%Y %H:%M") == "dd/MM/yyyy HH:mm"
    assert to_spark_pattern("yyyy-MM-dd") == "yyyy-MM-dd"


def test_ledger_runs_breaks_audit(spark, tmpdir_path):
    led = Ledger(spark, tmpdir_path + "/ledger")
    led.create_run("r1", dt.date(2026, 3, 1))
    assert led.get_run("r1").first()["status"] == "RUNNING"
    led.complete_run("r1", "COMPLETED", {"total_breaks": 2, "matched_count": 1})
    run = led.get_run("r1").first()
    assert run["status"] == "COMPLETED" and run["total_breaks"] == 2 and run["matched_count"] == 1
    assert led.get_run("nope").count() == 0
    with pytest.raises(LedgerError):
        led.complete_run("r1", "DONE")

    a = trades_df(spark, [{"trade_id": "T1"}, {"trade_id": "T2", "side": "SELL"}])
    b = trades_df(spark, [{"trade_id": "T2"}], "source_b")
    br = reconcile(a, b, run_id="r1").breaks()
    assert led.write_breaks(br, run_ids=["r1"]) == 2
    assert led.write_breaks(br, run_ids=["r1"]) == 0      # idempotent
    got = led.get_breaks_for_run("r1").collect()
    assert [(r["severity"], r["break_type"]) for r in got] == [("CRITICAL", "SIDE_BREAK"), ("HIGH", "MISSING")]
    with pytest.raises(LedgerError, match="runs that do not exist"):
        led.write_breaks(reconcile(a, b, run_id="r9").breaks())

    side_id = [r["break_id"] for r in got if r["break_type"] == "SIDE_BREAK"][0]
    led.update_break_explanations(spark.createDataFrame([(side_id, "booked on the wrong side")],
                                                        "break_id string, explanation string"))
    exp = {r["break_type"]: r["explanation"] for r in led.get_breaks_for_run("r1").collect()}
    assert exp == {"SIDE_BREAK": "booked on the wrong side", "MISSING": None}

    led.quick_audit("recon", "reconcile", "SUCCESS", run_id="r1", detail={"breaks": 2}, duration_ms=5)
    led.quick_audit("guard", "startup", "INFO")
    trail = led.get_audit_for_run("r1").collect()
    assert len(trail) == 1 and trail[0]["detail"] == '{"breaks": 2}'
    with pytest.raises(LedgerError):
        led.quick_audit("x", "y", "SUCCESS", run_id="missing-run")


def test_routing_and_escalation(spark):
    a = trades_df(spark, [{"trade_id": "T1", "side": "SELL", "consideration": 200000.0}, {"trade_id": "T2"}])
    b = trades_df(spark, [{"trade_id": "T1"}], "source_b")
    br = reconcile(a, b, run_id="r").breaks()
    to = routing.recipients_table(spark, [("g", "One", "one@example.org", "r", ["all_breaks", "summary"]),
                                          ("h", "Two", "two@example.org", "s", ["critical_breaks"])])
    routed = {(r["name"], r["item"]): r["n"] for r in routing.route(summary.severity_counts(br), to).collect()}
    assert routed == {("One", "all_breaks"): 2, ("One", "summary"): 1, ("Two", "critical_breaks"): 1}
    assert routing.routed_breaks(br, to).count() == 2 + 1
    pairs = pair_frame(a, b, payload=["side", "consideration"])
    e = reconcile(None, None, pairs=pairs).escalation().first()
    assert e["escalate"] and e["consideration_at_risk"] == 200000.0 + 185500.0
    assert e["reasons"] == "consideration, critical"


def test_type_summary_map(spark):
    a = trades_df(spark, [{"trade_id": "T1", "side": "SELL"}, {"trade_id": "T2"}, {"trade_id": "T3", "price": 1.0}])
    b = trades_df(spark, [{"trade_id": "T1"}, {"trade_id": "T3"}], "source_b")
    m = summary.type_summary_map(reconcile(a, b).breaks()).first()["type_summary"]
    assert m == {"MISSING": 1, "PRICE_BREAK": 1, "SIDE_BREAK": 1}


def test_consideration_check_is_optional(spark):
    from tradetally.operators.compare import Checks, Tolerances
    a = trades_df(spark, [{"trade_id": "T1", "consideration": 185500.0}])
    b = trades_df(spark, [{"trade_id": "T1", "consideration": 185502.0}], "source_b")
    assert reconcile(a, b).breaks().count() == 0                      # off by default
    on = reconcile(a, b, checks=Checks(consideration=True)).breaks().collect()
    assert [(r["break_type"], r["diff_num"]) for r in on] == [("CONSIDERATION_BREAK", -2.0)]
    loose = reconcile(a, b, checks=Checks(consideration=True), tolerances=Tolerances(consideration=5.0))
    assert loose.breaks().count() == 0


def test_negative_counts_rejected(spark, tmpdir_path):
    led = Ledger(spark, tmpdir_path + "/neg")
    led.create_run("n1", dt.date(2026, 3, 1))
    with pytest.raises(LedgerError, match=">= 0"):
        led.complete_run("n1", "COMPLETED", {"total_breaks": -1})


def test_class_tolerances_with_configured_keys(spark):
    from tradetally.operators import enrich
    from tradetally.operators.compare import Tolerances
    from tradetally.schemas import ASSET_CLASS_TOLERANCES
    master = spark.createDataFrame([("AAPL", "EQUITY"), ("SPY", "ETF")], "ticker string, asset_class string")
    ov = enrich.tolerance_table(spark, dict(ASSET_CLASS_TOLERANCES, etf={"price_tolerance": 0.5}))
    a = trades_df(spark, [{"trade_id": "T1", "ticker": "AAPL"}, {"trade_id": "T2", "ticker": "SPY"}])
    b = trades_df(spark, [{"trade_id": "T1", "ticker": "AAPL", "price": 185.60},
                          {"trade_id": "T2", "ticker": "SPY", "price": 185.60}], "source_b")
    p, tol = enrich.with_class_tolerances(pair_frame(a, b), master, ov, Tolerances())
    got = {r["asset_class"]: r["asset_class"] for r in p.select("asset_class").collect()}
    assert set(got) == {"equities", "etf"}
    r = reconcile(None, None, tolerances=tol, pairs=p)
    assert [x["trade_id"] for x in r.breaks().collect()] == ["T1"]     # 0.10 > 0.01; within 0.5 for etf


def test_render_every_break_type(spark):
    from tradetally.functions.render import render
    a = trades_df(spark, [{"trade_id": "D1"}, {"trade_id": "D1"}, {"trade_id": "M1", "ticker": "GOOGL",
                                                                   "quantity": 4698.0, "price": 274.0989},
                          {"trade_id": "S1"}, {"trade_id": "Q1"}, {"trade_id": "P1", "price": 185.51},
                          {"trade_id": "T1"}])
    b = trades_df(spark, [{"trade_id": "D1"}, {"trade_id": "S1", "side": "SELL"},
                          {"trade_id": "Q1", "quantity": 900.0}, {"trade_id": "P1", "price": 185.40},
                          {"trade_id": "T1", "settlement_date": dt.date(2024, 1, 19)},
                          {"trade_id": "M2", "ticker": "MSFT", "quantity": 10.0, "price": 2.5}], "source_b")
    rows = {(r["trade_id"], r["break_type"]): (r["source_a_value"], r["source_b_value"], r["difference"])
            for r in render(reconcile(a, b).breaks()).collect()}
    assert rows[("D1", "DUPLICATE")] == ("source_a: 2 occurrences", None, "Expected 1, found 2")
    assert rows[("M1", "MISSING")] == ("GOOGL BUY 4698.0@274.0989", "NOT FOUND",
                                       "Trade present in Source A, absent in Source B")
    assert rows[("M2", "MISSING")] == ("NOT FOUND", "MSFT BUY 10.0@2.5",
                                       "Trade present in Source B, absent in Source A")
    assert rows[("S1", "SIDE_BREAK")] == ("BUY", "SELL", "Source A=BUY, Source B=SELL")
    assert rows[("Q1", "QTY_BREAK")] == ("1000.0", "900.0", "100.0")
    assert rows[("P1", "PRICE_BREAK")] == ("185.51", "185.4", "+0.1100")
    assert rows[("T1", "SETTLE_BREAK")] == ("2024-01-17", "2024-01-19", "2 day(s)")


def test_tolerance_config_defaults():
    from tradetally.operators.compare import Tolerances
    t = Tolerances.from_config({"defaults": {"price_tolerance": 0.05}})
    assert (t.quantity, t.price, t.consideration, t.settlement_days) == (0.0, 0.05, 1.0, 0)
    assert Tolerances.from_config(None).price == 0.01
    assert Tolerances.from_config({"settlement_date_tolerance_days": 2}).settlement_days == 2


def test_break_order_lexical_and_by_rank(spark):
    a = trades_df(spark, [{"trade_id": "T1", "side": "SELL"}, {"trade_id": "T2", "price": 1.0},
                          {"trade_id": "T3"}])
    b = trades_df(spark, [{"trade_id": "T1"}, {"trade_id": "T2"}], "source_b")
    br = reconcile(a, b).breaks()
    lex = [r["severity"] for r in summary.ordered_breaks(br).collect()]
    rank = [r["severity"] for r in summary.ordered_breaks(br, by_rank=True).collect()]
    assert lex == ["CRITICAL", "HIGH", "MEDIUM"] and rank == ["CRITICAL", "HIGH", "MEDIUM"]
    sev = spark.createDataFrame([("LOW", "X", "T9", 5), ("MEDIUM", "Y", "T8", 5), ("HIGH", "Z", "T7", 5)],
                                "severity string, break_type string, trade_id string, step int")
    assert [r["severity"] for r in summary.ordered_breaks(sev).collect()] == ["HIGH", "LOW", "MEDIUM"]
    assert [r["severity"] for r in summary.ordered_breaks(sev, by_rank=True).collect()] == ["HIGH", "MEDIUM", "LOW"]


def test_load_frame_with_explicit_order(spark):
    from tradetally.sources.readers import load_frame
    src = spark.createDataFrame(
        [("T1", "2024-01-15", "2024-01-17", "AAPL", "US0378331005", "B", "10", "2", "20", "C", "K", "CONFIRMED", 2),
         ("T1", "2024-01-15", "2024-01-17", "AAPL", "US0378331005", "S", "10", "2", "20", "C", "K", "CONFIRMED", 1)],
        "trade_id string, trade_date string, settlement_date string, ticker string, isin string, side string, "
        "quantity string, price string, consideration string, counterparty string, broker string, "
        "status string, seq int")
    df = load_frame(src, "a", order_by=["seq"])
    from tradetally.operators.dedupe import keep_first
    assert keep_first(df, ["ingest_seq"]).first()["side"] == "SELL"     # seq 1 survives


def test_concat_and_run_status(spark):
    from tradetally.operators import joins
    a = trades_df(spark, [{"trade_id": "T1", "side": "SELL"}, {"trade_id": "T2", "price": 1.0}, {"trade_id": "T3"}])
    b = trades_df(spark, [{"trade_id": "T1"}, {"trade_id": "T2"}], "source_b")
    br1 = reconcile(a, b, run_id="r1").breaks()
    br2 = reconcile(a, a, run_id="r2").breaks()             # no breaks for r2
    both = joins.concat_frames(br1, br2)                     # U4
    assert {(r["run_id"], r["break_type"]) for r in both.collect()} == {
        ("r1", "SIDE_BREAK"), ("r1", "PRICE_BREAK"), ("r1", "MISSING")}
    assert summary.run_status(F.lit(0), F.lit(0)) is not None
    st = spark.createDataFrame([(1, 0), (1, 5), (0, 5)], "e int, t int").select(
        summary.run_status(F.col("e"), F.col("t")).alias("s")).collect()
    assert [r["s"] for r in st] == ["FAILED", "PARTIAL", "COMPLETED"]


def test_events_of_one_instant_have_an_order(spark, tmpdir_path):
    import datetime as dt
    from tradetally.sinks.ledger import Ledger, latest_run_state
    led = Ledger(spark, tmpdir_path, writer="w1")
    future = dt.datetime(2999, 1, 1)
    led.create_run("r", dt.date(2024, 1, 1), started_at=future)   # this writer's clock was ahead
    led.complete_run("r", "FAILED")
    led.complete_run("r", "COMPLETED")
    row = led.get_run("r").first()
    assert (row.status, row.event_seq, row.updated_at, row.writer) == ("COMPLETED", 2, future, "w1")
    ev = [("r", future, n, w, "create") for n, w in [(0, "a"), (1, "a"), (1, "c"), (1, "b")]]
    for order in (ev, ev[::-1]):
        df = spark.createDataFrame(order, "run_id string, updated_at timestamp, event_seq long, writer string, event string")
        assert [(r.event_seq, r.writer) for r in latest_run_state(df.repartition(3)).collect()] == [(1, "c")]
