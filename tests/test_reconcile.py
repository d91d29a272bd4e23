"""Matching semantics: expectations carried over from the reference's tests,
the six-break case, an invented day, tolerance edges,
partition invariance and idempotence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import trades_df
from tradetally.operators import dedupe
from tradetally.operators.compare import Tolerances
from tradetally.operators.reconcile import reconcile


def _breaks(r):
    return sorted((b["trade_id"], b["break_type"], b["source"]) for b in r.breaks().collect())


def _counts(r):
    return r.counts().first().asDict()


def test_three_equal_ids_make_one_duplicate_break(spark):
    a = trades_df(spark, [{"trade_id": "T001"}] * 3 + [{"trade_id": "T002"}])
    g = dedupe.duplicate_groups(a).collect()
    assert [(x["trade_id"], x["occurrences"]) for x in g] == [("T001", 3)]


def test_keep_first_survivor_order(spark):
    a = trades_df(spark, [{"trade_id": "T001", "quantity": 1.0}, {"trade_id": "T002"},
                          {"trade_id": "T001", "quantity": 2.0}])
    kept = dedupe.keep_first(a, ["ingest_seq"]).orderBy("trade_id").collect()
    assert [r["trade_id"] for r in kept] == ["T001", "T002"]
    assert kept[0]["quantity"] == 1.0


def test_six_break_case(spark):
    a = trades_df(spark, [{"trade_id": f"T00{i}"} for i in range(1, 7)]
                  + [{"trade_id": "T007"}, {"trade_id": "T007"}])
    b = trades_df(spark, [{"trade_id": "T001"},
                          {"trade_id": "T003", "side": "SELL"},
                          {"trade_id": "T004", "quantity": 900.0},
                          {"trade_id": "T005", "price": 186.00},
                          {"trade_id": "T006", "settlement_date": dt.date(2024, 1, 18)},
                          {"trade_id": "T008"}, {"trade_id": "T008"}], "source_b")
    r = reconcile(a, b, run_id="r1")
    assert _breaks(r) == sorted([
        ("T007", "DUPLICATE", "source_a"), ("T008", "DUPLICATE", "source_b"),
        ("T002", "MISSING", "source_a"), ("T007", "MISSING", "source_a"),
        ("T008", "MISSING", "source_b"), ("T003", "SIDE_BREAK", None),
        ("T004", "QTY_BREAK", None), ("T005", "PRICE_BREAK", None),
        ("T006", "SETTLE_BREAK", None)])
    assert _counts(r)["clean"] == 1
    sev = {b["break_type"]: b["severity"] for b in r.breaks().collect()}
    assert sev == {"DUPLICATE": "HIGH", "MISSING": "HIGH", "SIDE_BREAK": "CRITICAL",
                   "QTY_BREAK": "HIGH", "PRICE_BREAK": "MEDIUM", "SETTLE_BREAK": "MEDIUM"}


def test_break_ids_unique_and_deterministic(spark):
    a = trades_df(spark, [{"trade_id": f"T{i}", "quantity": float(i)} for i in range(20)])
    b = trades_df(spark, [{"trade_id": f"T{i}"} for i in range(5, 25)], "source_b")
    ids1 = [x["break_id"] for x in reconcile(a, b, run_id="r").breaks().collect()]
    ids2 = [x["break_id"] for x in reconcile(a, b, run_id="r").breaks().collect()]
    assert len(ids1) == len(set(ids1)) and sorted(ids1) == sorted(ids2)


def test_empty_b_means_every_a_trade_is_missing(spark):
    a = trades_df(spark, [{"trade_id": f"T{i}"} for i in range(4)])
    b = a.limit(0)
    r = reconcile(a, b)
    assert _breaks(r) == [(f"T{i}", "MISSING", "source_a") for i in range(4)]
    assert _counts(r)["clean"] == 0


@pytest.mark.parametrize("pb,expect", [(185.505, 0), (185.52, 1)])
def test_price_tolerance_edges(spark, pb, expect):
    a = trades_df(spark, [{"trade_id": "T1"}])
    b = trades_df(spark, [{"trade_id": "T1", "price": pb}], "source_b")
    assert _counts(reconcile(a, b))["price_break"] == expect


def test_binary_double_tolerance_parity(spark):
    # |100.01 - 100.00| > 0.01 is true on doubles; |185.51 - 185.50| > 0.01 is false
    a = trades_df(spark, [{"trade_id": "T1", "price": 100.01}, {"trade_id": "T2", "price": 185.51}])
    b = trades_df(spark, [{"trade_id": "T1", "price": 100.00}, {"trade_id": "T2", "price": 185.50}], "source_b")
    got = {x["trade_id"] for x in reconcile(a, b).breaks().collect()}
    assert got == {"T1"}


def test_settlement_tolerance_one_day(spark):
    a = trades_df(spark, [{"trade_id": "T1"}])
    b = trades_df(spark, [{"trade_id": "T1", "settlement_date": dt.date(2024, 1, 18)}], "source_b")
    assert _counts(reconcile(a, b, tolerances=Tolerances(settlement_days=1)))["settle_break"] == 0
    assert _counts(reconcile(a, b))["settle_break"] == 1


def test_quantity_values_and_signed_difference(spark):
    a = trades_df(spark, [{"trade_id": "T1", "quantity": 1000.0}])
    b = trades_df(spark, [{"trade_id": "T1", "quantity": 900.0}], "source_b")
    row = reconcile(a, b).breaks().first()
    assert (row["a_num"], row["b_num"], row["diff_num"]) == (1000.0, 900.0, 100.0)
    from tradetally.functions.render import render
    txt = render(reconcile(a, b).breaks()).first()
    assert (txt["source_a_value"], txt["source_b_value"], txt["difference"]) == ("1000.0", "900.0", "100.0")


def test_side_nulls_and_case(spark):
    a = trades_df(spark, [{"trade_id": "T1", "side": " buy "}, {"trade_id": "T2", "side": None},
                          {"trade_id": "T3", "side": None}])
    b = trades_df(spark, [{"trade_id": "T1", "side": "BUY"}, {"trade_id": "T2", "side": "SELL"},
                          {"trade_id": "T3", "side": None}], "source_b")
    got = {x["trade_id"] for x in reconcile(a, b).breaks().collect()}
    assert got == {"T2"}      # one-sided value is a break, two NULLs are not


def test_duplicate_pair_still_counts_clean(spark):
    a = trades_df(spark, [{"trade_id": "T1"}, {"trade_id": "T1"}])
    b = trades_df(spark, [{"trade_id": "T1"}], "source_b")
    c = _counts(reconcile(a, b))
    assert c["clean"] == 1 and c["duplicate_a"] == 1


def test_null_and_blank_ids_are_excluded_and_counted(spark):
    a = trades_df(spark, [{"trade_id": None}, {"trade_id": "  "}, {"trade_id": "\t\u00a0"}, {"trade_id": "T1"}])
    b = trades_df(spark, [{"trade_id": None}, {"trade_id": "  "}, {"trade_id": "T1"}], "source_b")
    r = reconcile(a, b)
    c = _counts(r)
    assert _breaks(r) == [] and c["clean"] == c["matched_ids"] == 1
    assert (c["source_a_rows"], c["source_b_rows"], c["excluded_a_rows"], c["excluded_b_rows"]) == (1, 1, 3, 2)
    assert dedupe.blank_keys(a).count() == 3


def test_long_order_keys_stay_apart(spark):
    from tradetally.sources.fixtures import _base
    rows = [(k, 1, 1, 1, 1.0, 1.0, "N", "O", dt.datetime(2024, 1, 1)) for k in (123456789, 123456780, 7)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, "
                                     "l_quantity double, l_extendedprice double, l_returnflag string, "
                                     "l_linestatus string, l_shipdate timestamp")
    ids = {r["trade_id"] for r in _base(li).collect()}
    assert ids == {"TRD123456789-1", "TRD123456780-1", "TRD00000007-1"}


def test_breaks_conform_to_the_schema(spark):
    from tradetally.schemas import BREAK_SCHEMA
    a = trades_df(spark, [{"trade_id": "T1", "quantity": 5.0}])
    got = reconcile(a, a.limit(0)).breaks().schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in BREAK_SCHEMA]


def test_consideration_is_in_every_total(spark):
    from tradetally.operators.compare import Checks
    a = trades_df(spark, [{"trade_id": "T1"}])
    b = trades_df(spark, [{"trade_id": "T1", "consideration": 1.0}], "source_b")
    r = reconcile(a, b, checks=Checks(consideration=True))
    row = r.run_row().first()
    assert (row["total_breaks"], row["medium_breaks"], row["matched_count"]) == (1, 1, 0)
    assert {x["break_type"]: x["n"] for x in r.type_counts().collect()} == {"CONSIDERATION_BREAK": 1}
    assert r.escalation(break_count_threshold=0).first()["total_breaks"] == 1


def test_kinds_build_the_same_breaks(spark):
    a = trades_df(spark, [{"trade_id": "T1", "side": "SELL"}, {"trade_id": "T2"}, {"trade_id": "T2"}])
    b = trades_df(spark, [{"trade_id": "T1", "price": 1.0}], "source_b")
    r = reconcile(a, b)
    for kinds in (["SIDE_BREAK"], ["DUPLICATE", "MISSING"], ["QTY_BREAK"]):
        assert _breaks_of(r, kinds) == [x for x in _breaks(r) if x[1] in kinds]


def _breaks_of(r, kinds):
    return sorted((b["trade_id"], b["break_type"], b["source"]) for b in r.breaks(kinds=kinds).collect())


def test_partition_invariance(spark):
    from tradetally.sources.fixtures import FEED_ORDER, feed_a, feed_b
    sf = "/root/testdata/sf0.001"
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            a = feed_a(spark, sf).repartition(n)
            b = feed_b(spark, sf).repartition(n + 1)
            r = reconcile(a, b, order_by=FEED_ORDER, run_id="p")
            results.append(sorted(tuple(x) for x in r.breaks().select("break_id", "a_num", "b_num").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_flagship_plan_has_one_exchange_per_side(spark):
    from tradetally.plans.q_match import recon_breaks
    df = recon_breaks(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(trade_id") == 2
    assert "SortMergeJoin" in plan and "FullOuter" in plan


def test_observed_counts_come_with_the_breaks_write(spark, tmpdir_path):
    a = trades_df(spark, [{"trade_id": "T1"}, {"trade_id": "T2", "price": 1.0}])
    b = trades_df(spark, [{"trade_id": "T1"}, {"trade_id": "T2"}], "source_b")
    breaks, obs = reconcile(a, b).observed_breaks()
    breaks.write.mode("overwrite").parquet(tmpdir_path + "/b")
    assert obs.get["clean"] == 1 and obs.get["price_break"] == 1


# An invented day: eight trades, written out by hand. B repeats N-104, lacks
# N-105, has another quantity for N-102 and another price for N-107.
OWN_A = """N-101,2025-06-02,2025-06-04,KELP,GB00KELP0017,BUY,300,12.5,3750,NORTHBANK,OAKDESK,,CONFIRMED
N-102,2025-06-02,2025-06-04,FERN,GB00FERN0024,SELL,40,210,8400,EASTBANK,OAKDESK,,CONFIRMED
N-103,2025-06-02,2025-06-04,MOSS,IE00MOSS0031,B,1000,3.25,3250,NORTHBANK,ELMDESK,,PENDING
N-104,2025-06-02,2025-06-04,KELP,GB00KELP0017,SELL,75,12.6,945,WESTBANK,ELMDESK,,CONFIRMED
N-105,2025-06-02,2025-06-04,REED,IE00REED0048,BUY,20,99.5,1990,WESTBANK,OAKDESK,,CONFIRMED
N-106,2025-06-02,2025-06-05,REED,IE00REED0048,S,60,99.75,5985,EASTBANK,OAKDESK,,CONFIRMED
N-107,2025-06-02,2025-06-04,MOSS,IE00MOSS0031,BUY,500,3.2,1600,EASTBANK,ELMDESK,,CONFIRMED
N-108,2025-06-02,2025-06-04,FERN,GB00FERN0024,BUY,10,211,2110,NORTHBANK,ELMDESK,,CANCELLED"""
OWN_B = """N-108,2025-06-02,2025-06-04,FERN,GB00FERN0024,BUY,10,211,2110,NORTHBANK,ELMDESK,,CANCELLED
N-104,2025-06-02,2025-06-04,KELP,GB00KELP0017,SELL,75,12.6,945,WESTBANK,ELMDESK,,CONFIRMED
N-101,2025-06-02,2025-06-04,KELP,GB00KELP0017,1,300,12.5,3750,NORTHBANK,OAKDESK,,CONFIRMED
N-102,2025-06-02,2025-06-04,FERN,GB00FERN0024,SELL,45,210,9450,EASTBANK,OAKDESK,,CONFIRMED
N-103,2025-06-02,2025-06-04,MOSS,IE00MOSS0031,BUY,1000,3.255,3255,NORTHBANK,ELMDESK,,PENDING
N-104,2025-06-02,2025-06-04,KELP,GB00KELP0017,SELL,75,12.6,945,WESTBANK,ELMDESK,,CONFIRMED
N-106,2025-06-02,2025-06-05,REED,IE00REED0048,-1,60,99.75,5985,EASTBANK,OAKDESK,,CONFIRMED
N-107,2025-06-02,2025-06-04,MOSS,IE00MOSS0031,BUY,500,3.28,1640,EASTBANK,ELMDESK,,CONFIRMED"""


def test_own_day(spark, tmpdir_path):
    from tradetally.sources.readers import load_csv
    from conftest import TRADE_HEADER
    for name, body in (("a.csv", OWN_A), ("b.csv", OWN_B)):
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write(TRADE_HEADER + "\n" + body + "\n")
    a, b = (load_csv(spark, f"{tmpdir_path}/{x}.csv", f"source_{x}", date_format="%Y-%m-%d") for x in "ab")
    r = reconcile(a, b, run_id="own")
    assert _breaks(r) == [("N-102", "QTY_BREAK", None), ("N-104", "DUPLICATE", "source_b"),
                          ("N-105", "MISSING", "source_a"), ("N-107", "PRICE_BREAK", None)]
    c = _counts(r)
    assert (c["source_a_rows"], c["source_b_rows"], c["clean"]) == (8, 8, 5)


def test_scan_reads_only_needed_columns(spark):
    from tradetally.plans.q_match import recon_summary
    plan = recon_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # tax, discount and line status are never read by the summary
    assert "l_tax" not in plan and "l_discount" not in plan and "l_linestatus" not in plan


def test_ledger_reads_prune_run_partitions(spark, tmpdir_path):
    import datetime as dt
    from tradetally.sinks.ledger import Ledger
    led = Ledger(spark, tmpdir_path + "/l")
    for rid in ("r1", "r2"):
        led.create_run(rid, dt.date(2026, 3, 1))
        a = trades_df(spark, [{"trade_id": "T1"}])
        led.write_breaks(reconcile(a, a.limit(0), run_id=rid).breaks(), run_ids=[rid])
    df = led.get_breaks_for_run("r2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and df.count() == 1


def test_hot_id_holding_a_third_of_rows(spark):
    """One id holds a third of A: partial aggregation before the exchange,
    results whole (every row counted, one DUPLICATE break)."""
    from pyspark.sql import types as T
    from tradetally.operators import joins
    n = 30000
    a = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("T"), F.col("id").cast("string")))
        .alias("trade_id"),
        F.lit("BUY").alias("side"), F.lit(10.0).alias("quantity"), F.lit(1.0).alias("price"),
        F.to_date(F.lit("2024-01-17")).alias("settlement_date"), F.lit("X").alias("ticker"),
        F.col("id").alias("ingest_seq"))
    b = a.where(F.col("trade_id") != "HOT").union(a.where(F.col("ingest_seq") == 0))
    r = reconcile(a, b, run_id="hot")
    c = r.counts().first()
    assert c["source_a_rows"] == n and c["duplicate_a"] == 1 and c["clean"] == n - n // 3 + 1
    dup = r.breaks().where("break_type = 'DUPLICATE'").first()
    assert dup["trade_id"] == "HOT" and dup["occurrences"] == n // 3
    plan = r.counts()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_min" in plan
    assert joins.common_ids(a, b).where("trade_id = 'HOT'").count() == 1
    assert joins.missing_from(a, b).count() == 0


def test_check_skipped_when_a_column_is_absent(spark):
    """A compared column missing from one source switches that check off."""
    a = trades_df(spark, [{"trade_id": "T1"}])
    b = trades_df(spark, [{"trade_id": "T1", "settlement_date": dt.date(2024, 2, 1), "price": 1.0}],
                  "source_b").drop("settlement_date")
    c = reconcile(a, b).counts().first()
    assert c["settle_break"] == 0 and c["price_break"] == 1


def test_bucketed_feed_is_not_shuffled(spark, tmpdir_path):
    """A feed stored bucketed by trade_id skips its exchange; results unchanged."""
    from tradetally.sinks.tables import write_bucketed
    from tradetally.sources.fixtures import FEED_ORDER, feed_a, feed_b
    sf = "/root/testdata/sf0.001"
    write_bucketed(feed_a(spark, sf), "tt_feed_a_bucketed", 8, path=tmpdir_path + "/a_bucketed")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a_b = spark.table("tt_feed_a_bucketed")
        r1 = reconcile(a_b, feed_b(spark, sf), order_by=FEED_ORDER, run_id="bk")
        r2 = reconcile(feed_a(spark, sf), feed_b(spark, sf), order_by=FEED_ORDER, run_id="bk")
        plan = r1.breaks()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(trade_id") == 1
        ids = lambda r: sorted(x["break_id"] for x in r.breaks().select("break_id").collect())
        assert ids(r1) == ids(r2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS tt_feed_a_bucketed")


def test_presentation_orders(spark):
    from tradetally.operators import joins
    a = trades_df(spark, [{"trade_id": t} for t in ["T3", "T1", "T3", "T2", "T1"]])
    b = trades_df(spark, [{"trade_id": t} for t in ["T9", "T2", "T5"]], "source_b")
    assert [r["trade_id"] for r in dedupe.duplicate_groups(a, sort=True).collect()] == ["T1", "T3"]
    got = [(r["source"], r["trade_id"]) for r in joins.detect_missing(a, b, ["ingest_seq"], sort=True).collect()]
    assert got == [("source_a", "T1"), ("source_a", "T3"), ("source_b", "T5"), ("source_b", "T9")]


def test_emission_order(spark):
    a = trades_df(spark, [{"trade_id": "T5", "side": "SELL", "price": 1.0}, {"trade_id": "T1"},
                          {"trade_id": "T1"}, {"trade_id": "T4"}])
    b = trades_df(spark, [{"trade_id": "T5"}, {"trade_id": "T2"}, {"trade_id": "T2"}, {"trade_id": "T1"}],
                  "source_b")
    got = [(r["step"], r["trade_id"], r["break_type"]) for r in reconcile(a, b).breaks(ordered=True).collect()]
    assert got == [(1, "T1", "DUPLICATE"), (2, "T2", "DUPLICATE"), (3, "T4", "MISSING"),
                   (4, "T2", "MISSING"), (5, "T5", "SIDE_BREAK"), (5, "T5", "PRICE_BREAK")]
