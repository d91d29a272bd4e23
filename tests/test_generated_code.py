"""Rows go through compiled code: the JVM leaves methods of more than 8000 bytes to
its interpreter, and a plain session runs them so. And work that is done once."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, trades_df
from tradetally.functions.dates import parse_date
from tradetally.functions.text import strip
from tradetally.operators.reconcile import reconcile
from tradetally.plans.q_match import recon
from tradetally.plans.registry import all_queries
from tradetally.session import scratch_path
from tradetally.sinks import ledger as L
from tradetally.sources import readers
from tradetally.sources.fixtures import ordered_feed

COMPILED = 8000


def largest_method(df) -> int:
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue()))


def test_breaks_are_built_in_compiled_code(spark):
    assert largest_method(recon(spark, SF_SMALL).breaks()) < COMPILED


@pytest.mark.parametrize("name", ["csv_load", "csv_multiline", "fixed_width_load", "fixed_width_latin1"])
def test_files_are_loaded_in_compiled_code(spark, name):
    assert largest_method(all_queries()[name](spark, SF_SMALL)) < COMPILED


@pytest.mark.parametrize("side", ["a", "b"])
def test_a_written_feed_is_sorted_by_a_column(spark, side):
    plan = ordered_feed(spark, SF_SMALL, side)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Sort \[id_tail#\d+ ASC", plan)     # an expression is worked out again for every comparison
    ids = [r[0] for r in ordered_feed(spark, SF_SMALL, side).select("trade_id").collect()]
    assert ids == sorted(ids) and ids


def test_plain_dates_are_cast_and_others_parsed_as_before(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-13-01", "2024-1-5", "2024-01-15T10:00:00", "2024", "0000-01-01", "0999-12-31",
             "1000-01-01", "1582-10-10", "9999-12-31", "12024-01-01", "+2024-01-01", "2024-01-15\n", "2024-01-15 ", "", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    quick = parse_date(F.col("t"), "%Y-%m-%d", stripped=True)
    assert "CAST" in str(quick).upper()
    assert df.where(~quick.eqNullSafe(F.try_to_date("t", "yyyy-MM-dd"))).collect() == []
    assert df.where(quick.isNotNull()).count() >= 5


def test_the_end_of_a_text_is_looked_up_in_its_bytes(spark):
    texts = ["a", " a", "a ", "a\u00a0", "\u00e9", "a\u00e9", "\u00e9a", "a\x7f", "\u3000a\u2028", "", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"))
    assert "cast(t#" in df._jdf.queryExecution().optimizedPlan().toString().lower()   # not a string's last character
    assert [r.s for r in df.collect()] == [t and t.strip() for t in texts]


def test_wide_characters_keep_their_places(spark, tmpdir_path):
    path = f"{tmpdir_path}/wide"
    names = ["trade_id", "trade_date", "settlement_date", "ticker", "isin", "side", "quantity", "price",
             "consideration", "counterparty", "broker", "status"]
    rows = [("T1", "2024-01-15", "2024-01-17", "AAPL", "US0378331005", "B", "10", "2", "20", "Soci\u00e9t\u00e9", "\u00c6BR", "PENDING"),
            ("T2", "2024-01-15", "", "AAPL", "US0378331005", "NA", "x", "2", "20", " CITI", "BR", "PENDING")]
    spark.createDataFrame([("".join(v.ljust(14) for v in r),) for r in rows], "value string").write.text(path)
    df = readers.load_fixed_width(spark, path, "a", [(i * 14, i * 14 + 14) for i in range(12)], names, date_format="%Y-%m-%d")
    got = {r["trade_id"]: r for r in df.collect()}
    assert (got["T1"]["counterparty"], got["T1"]["broker"], got["T1"]["side"]) == ("Soci\u00e9t\u00e9", "\u00c6BR", "BUY")
    assert (got["T2"]["counterparty"], got["T2"]["side"], got["T2"]["quantity"], got["T2"]["settlement_date"]) == ("CITI", None, None, None)


def _ledger(spark):
    import datetime as dt
    led = L.Ledger(spark, scratch_path(spark, "ledger"))
    led.create_run("r", dt.date(2024, 1, 15))
    a = trades_df(spark, [{"trade_id": f"T{i}", "side": "BUY"} for i in range(6)])
    b = trades_df(spark, [{"trade_id": f"T{i}", "side": "SELL"} for i in range(6)], "source_b")
    return led, reconcile(a, b, run_id="r").breaks()


def test_breaks_inserted_once(spark):
    led, breaks = _ledger(spark)
    some = breaks.where("trade_id < 'T3'")
    assert led.write_breaks(some.unionAll(some), run_ids=["r"]) == 3     # repeated in the write
    assert led.write_breaks(breaks, run_ids=["r"]) == 3                  # partly stored
    assert led.write_breaks(breaks, run_ids=["r"]) == 0                  # all stored
    assert led.read_breaks().count() == led.read_breaks().select("break_id").distinct().count() == 6


def test_keys_meet(spark):
    new = spark.createDataFrame([("a",), ("b",)], "break_id string")
    assert not L.keys_meet(new, spark.createDataFrame([("c",)], "break_id string"))
    assert L.keys_meet(new, spark.createDataFrame([("b",)], "break_id string"))
    assert L.keys_meet(new.unionAll(new), spark.createDataFrame([], "break_id string"))


def test_break_files_hold_ids_shorter_than_their_text(spark):
    led, breaks = _ledger(spark)
    many = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("break_id"), F.lit("SIDE_BREAK").alias("break_type"),
                                     F.lit("CRITICAL").alias("severity"), F.lit("r").alias("run_id"))
    led.write_breaks(many, run_ids=["r"])
    p, fs = led._fs_path(led._p("breaks"))
    assert fs.getContentSummary(p).getLength() < 20000 * 50
