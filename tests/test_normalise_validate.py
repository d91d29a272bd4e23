"""Normalisation (P1-P11, S8) and validation (V1-V15) on single rows."""

import pytest
from pyspark.sql import functions as F

from tradetally.operators import normalise as N
from tradetally.operators import validate as V

RAW_COLS = ["trade_id", "trade_date", "settlement_date", "ticker", "isin", "side", "quantity",
            "price", "consideration", "counterparty", "broker", "trader_id", "status"]
GOOD = ["T001", "2024-01-15", "2024-01-17", "AAPL", "US0378331005", "BUY", "1000", "185.50",
        "185500.00", "CITI", "INSTINET", "TDR1", "CONFIRMED"]


def raw(spark, *changes, cols=RAW_COLS):
    rows = []
    for ch in changes:
        r = dict(zip(cols, GOOD))
        r.update(ch)
        rows.append(tuple(r[c] for c in cols))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def codes(spark, change, **kw):
    df = V.validate(N.normalise(raw(spark, change), "s", "%Y-%m-%d"), **kw)
    return df.first()["errors"]


def test_header_aliases_and_collision(spark):
    df = spark.createDataFrame([("1", "2", "3")], "`Trade Ref` string, ` QTY ` string, `Exec Price` string")
    assert N.normalise_columns(df).columns == ["trade_id", "quantity", "price"]
    bad = spark.createDataFrame([("1", "2")], "id string, trade_id string")
    with pytest.raises(ValueError, match="both map to 'trade_id'"):
        N.normalise_columns(bad)


def test_required_columns_reported_in_order(spark):
    df = spark.createDataFrame([("1",)], "trade_id string")
    assert N.check_required_columns(df)[:3] == ["trade_date", "settlement_date", "ticker"]


@pytest.mark.parametrize("raw_side,expected", [
    (" buy ", "BUY"), ("b", "BUY"), ("1", "BUY"), ("S", "SELL"), ("-1", "SELL"), ("hold", "HOLD")])
def test_side_map(spark, raw_side, expected):
    n = N.normalise(raw(spark, {"side": raw_side}), "s", "%Y-%m-%d")
    assert n.first()["side"] == expected


@pytest.mark.parametrize("text,value", [
    ("1000", 1000.0), (" 12.5 ", 12.5), ("1e3", 1000.0), ("12d", None), ("1,234", None),
    ("NaN", None), ("nan", None), ("abc", None)])
def test_numeric_parse(spark, text, value):
    assert N.normalise(raw(spark, {"quantity": text}), "s").first()["quantity"] == value


def test_na_tokens_and_trim(spark):
    n = N.normalise(raw(spark, {"broker": "N/A", "counterparty": "", "ticker": " aapl "}), "s").first()
    assert n["broker"] is None and n["counterparty"] is None and n["ticker"] == "aapl"


def test_all_empty_rows_dropped(spark):
    blank = {c: "" for c in RAW_COLS}
    assert N.normalise(raw(spark, {}, blank), "s").count() == 1


def test_dates_strict_and_inferred(spark):
    n = N.normalise(raw(spark, {"trade_date": "2024/01/15"}), "s", "%Y-%m-%d", keep_raw_dates=True)
    assert n.select(N.date_failures(n).alias("bad")).first()["bad"] is True
    inferred = N.normalise(raw(spark, {"trade_date": "2024/01/15"}), "s").first()
    assert str(inferred["trade_date"]) == "2024-01-15"


def test_valid_row_passes(spark):
    v = V.validate(N.normalise(raw(spark, {}), "s", "%Y-%m-%d")).first()
    assert v["valid"] and v["errors"] == [] and v["error_codes"] == ""


@pytest.mark.parametrize("change,code", [
    ({"side": "HOLD"}, "side:enum"), ({"status": "DONE"}, "status:enum"),
    ({"quantity": "-5"}, "quantity:not_positive"), ({"price": "0"}, "price:not_positive"),
    ({"isin": "US037"}, "isin:format"), ({"isin": "120378331005"}, "isin:format"),
    ({"broker": "N/A"}, "broker:required"), ({"trade_id": "  "}, "trade_id:empty"),
    ({"settlement_date": "2024-01-14"}, "settlement_date:before_trade_date"),
    ({"consideration": "371000"}, "consideration:mismatch")])
def test_rule_codes(spark, change, code):
    assert code in codes(spark, change)


def test_cross_rules_only_after_field_rules(spark):
    # a field error hides both cross-field rules; V8 hides V9
    assert codes(spark, {"side": "HOLD", "settlement_date": "2024-01-14"}) == ["side:enum"]
    assert codes(spark, {"settlement_date": "2024-01-14", "consideration": "1"}) == \
        ["settlement_date:before_trade_date"]


def test_consideration_within_one_percent(spark):
    assert codes(spark, {"consideration": "187000"}) == []      # 0.8 % off


def test_strict_isin_option(spark):
    assert codes(spark, {"isin": "US037833100*"}) == []
    assert codes(spark, {"isin": "US037833100*"}, strict_isin=True) == ["isin:strict"]


def test_isin_ticker_upper_trim_output(spark):
    v = V.validate(N.normalise(raw(spark, {"isin": " us0378331005 ", "ticker": " aapl "}), "s")).first()
    assert v["valid"] and v["isin"] == "US0378331005" and v["ticker"] == "AAPL"


def test_counts_and_first_errors(spark):
    df = raw(spark, {}, {"trade_id": "T2", "side": "X"}, {"trade_id": "T3", "price": "0"})
    df = df.withColumn("ingest_seq", F.monotonically_increasing_id())
    v = V.validate(N.normalise(df, "source_a"))
    c = V.counts(v).first()
    assert (c["record_count"], c["valid_count"], c["invalid_count"]) == (3, 1, 2)
    msgs = [r["message"] for r in V.first_errors(v).collect()]
    assert msgs == ["source_a[T2]: side:enum", "source_a[T3]: price:not_positive"]


def test_to_contract_projection(spark):
    n = N.normalise(raw(spark, {}), "s")
    out = N.to_contract(n.withColumn("extra", F.lit(1)))
    assert "extra" not in out.columns and out.columns[:3] == ["trade_id", "trade_date", "settlement_date"]
