"""Ordered tables, factorised pairs and ties between explanations."""

import datetime as dt
import random
from collections import Counter

import pytest

from tradetally.operators import joins
from tradetally.sinks.ledger import merge_explanations
from tradetally.sinks.ordered import OrderedTable


def test_ordered_table_in_another_session(spark, tmp_path):
    rows = [(random.Random(1).randrange(50) * 7 % 50 + i % 3, f"k{i:05d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "rank int, name string, n long").repartition(5)
    OrderedTable.write(df, str(tmp_path / "t"), "rank", "name")
    table = OrderedTable(spark.newSession(), str(tmp_path / "t"))
    want = sorted(rows, key=lambda r: r[:2])
    got = sorted((r.position, (r.rank, r.name, r.n)) for r in table.positioned().collect())
    assert got == list(enumerate(want, 1))
    for first, last in ((1, 10), (995, 1310), (2999, 9000), (4000, 5000)):
        assert [(r.rank, r.name, r.n) for r in table.page(first, last).collect()] == want[first - 1:last]


def test_page_reads_only_its_ranges(spark, tmp_path):
    df = spark.range(0, 100_000, 1, 8).withColumnRenamed("id", "n")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the ranges stay as many as the shuffle partitions
    try:
        table = OrderedTable.write(df, str(tmp_path / "t"), "n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert table._ranges().count() > 2
    page = table.page(10, 20)
    assert "PushedFilters: [IsNotNull(_range), EqualTo(_range,0)" in page._jdf.queryExecution().toString() or \
        "In(_range" in page._jdf.queryExecution().toString()
    assert [r.n for r in page.collect()] == list(range(9, 20))


def test_ordered_table_empty_and_clashing(spark, tmp_path):
    table = OrderedTable.write(spark.createDataFrame([], "n long"), str(tmp_path / "e"), "n")
    assert table.positioned().count() == 0 and table.page(1, 5).count() == 0
    with pytest.raises(ValueError, match="_place"):
        OrderedTable.write(spark.createDataFrame([(1, 2)], "n long, _place long"), str(tmp_path / "c"), "n")


def _copies(spark, seed):
    rng = random.Random(seed)
    ids = ["HOT"] * 400 + [f"T{rng.randrange(60)}" for _ in range(300)] + [None] * 5
    rows = [(t, rng.choice(["BUY", "SELL", None]), rng.randrange(4)) for t in ids]
    return rows, spark.createDataFrame(rows, "trade_id string, side string, quantity int").repartition(3)


def test_pairs_are_counted_without_listing(spark):
    (ra, a), (rb, b) = _copies(spark, 1), _copies(spark, 2)
    want = {}
    for t in {r[0] for r in ra} & {r[0] for r in rb} - {None}:
        pairs = [(x, y) for x in ra if x[0] == t for y in rb if y[0] == t]
        want[t] = (len([r for r in ra if r[0] == t]), len([r for r in rb if r[0] == t]), len(pairs),
                   sum(x[1] == y[1] and x[1] is not None for x, y in pairs), sum(x[2] == y[2] for x, y in pairs))
    got = {r.trade_id: tuple(r)[1:] for r in joins.pair_counts(a, b, ["side", "quantity"]).collect()}
    assert got == want
    assert joins.pair_counts(a.limit(0), b, ["side"]).count() == 0


def test_members_in_bounded_blocks(spark):
    (ra, a), (rb, b) = _copies(spark, 3), _copies(spark, 4)
    got = joins.member_blocks(a, b, ["side", "quantity"], size=40).collect()
    both = {r[0] for r in ra} & {r[0] for r in rb} - {None}
    for name, rows in (("a", ra), ("b", rb)):
        members = Counter((r.trade_id, m.side, m.quantity) for r in got if r.side == name for m in r.members)
        assert members == Counter(r for r in rows if r[0] in both)
    hot = [r for r in got if r.trade_id == "HOT"]
    assert {r.blocks for r in hot} == {10} and max(len(r.members) for r in hot) < 80


def test_explanations_of_one_instant(spark):
    at = dt.datetime(2026, 3, 1)
    exp = spark.createDataFrame([("x", "a", at), ("x", "b", at), ("y", "old", at), ("y", "new", at + dt.timedelta(1))],
                                "break_id string, explanation string, explained_at timestamp")
    breaks = spark.createDataFrame([("x",), ("y",), ("z",)], "break_id string")
    got = {r.break_id: r.explanation for r in merge_explanations(breaks, exp).collect()}
    assert got == {"x": "b", "y": "new", "z": None}
