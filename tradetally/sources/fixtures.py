"""Feeds A and B (and a dirty raw feed) derived from ``lineitem``.

Integer arithmetic on the key only (no random, no hash), so Spark and a SQL
oracle derive the same rows. ``h = l_orderkey * 7 + l_linenumber``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.sources.tables import table

# Survivor order for keep-first on the derived feeds (identical on both sides).
FEED_ORDER = ["isin", "l_suppkey", "quantity", "price", "trade_date", "side"]

def _h() -> Column:
    return F.col("l_orderkey") * 7 + F.col("l_linenumber")


# The feeds are written as SQL expressions: one parse per column on the JVM
# instead of one call per function from Python (planning time, not run time).
_ID_TAIL = "concat(lpad(CAST(l_orderkey AS STRING), greatest(8, length(CAST(l_orderkey AS STRING))), '0'), '-', CAST(l_linenumber AS STRING))"
_BASE = [
    f"concat('TRD', {_ID_TAIL}) AS trade_id",
    "to_date(l_shipdate) AS trade_date",
    "date_add(to_date(l_shipdate), 2) AS settlement_date",
    "concat('P', CAST(l_partkey % 100 AS STRING)) AS ticker",
    "concat('US', lpad(CAST(l_partkey % 10000000000 AS STRING), 10, '0')) AS isin",
    "CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side",
    "l_quantity AS quantity",
    "try_divide(l_extendedprice, l_quantity) AS price",
    "l_extendedprice AS consideration",
    "concat('CP', CAST(l_suppkey AS STRING)) AS counterparty",
    "concat('BR', l_linestatus) AS broker",
    "CAST(NULL AS STRING) AS trader_id",
    "CASE WHEN l_linestatus = 'O' THEN 'CONFIRMED' ELSE 'PENDING' END AS status",
    "l_suppkey",
    "l_orderkey * 7 + l_linenumber AS h",
]

FEED_COLUMNS = ["trade_id", "trade_date", "settlement_date", "ticker", "isin", "side", "quantity",
                "price", "consideration", "counterparty", "broker", "trader_id", "status", "l_suppkey"]

# Feed B's changes by h mod 25 (1 side, 2 quantity, 3 price, 4 settlement).
_B_CHANGED = {
    "settlement_date": "CASE WHEN h % 25 = 4 THEN date_add(settlement_date, 1) ELSE settlement_date END",
    "side": "CASE WHEN h % 25 = 1 THEN CASE WHEN side = 'BUY' THEN 'SELL' ELSE 'BUY' END ELSE side END",
    "quantity": "CASE WHEN h % 25 = 2 THEN quantity + 50 ELSE quantity END",
    "price": "CASE WHEN h % 25 = 3 THEN price + 0.05D ELSE price END",
}


_RAW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "to_date(l_shipdate) AS l_shipdate", "l_returnflag", "l_linestatus"]
_OF_RAW = {name: expr for expr, _, name in (e.rpartition(" AS ") for e in _BASE) if expr}


def _raw(expr: str) -> str:
    """An expression over base columns as one over ``lineitem``'s."""
    return re.sub(rf"\b({'|'.join(_OF_RAW)})\b", lambda m: f"({_OF_RAW[m[1]]})", expr)


def ordered_feed(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Feed A or B sorted by (trade_id, survivor order). The columns of
    ``lineitem`` are sorted, which take half the feed's bytes in the shuffle; the
    feed's columns are then derived in that order. Behind the shuffle each row has
    its id as a column, as a sort works an expression out for every two rows it
    compares; without the letters that all ids begin with, the first eight
    characters, which are compared as one number, tell most ids apart."""
    changed = _B_CHANGED if side == "b" else {}
    by = [F.expr(_raw(changed.get(c, c))) for c in ("trade_id", *FEED_ORDER)]
    ranges = table(spark, sf_dir, "lineitem").selectExpr(*_RAW).repartitionByRange(*by)
    rows = ranges.selectExpr("*", f"{_ID_TAIL} AS id_tail").sortWithinPartitions("id_tail", *by[1:])
    return (_feed_b if side == "b" else _feed_a)(rows)


def _base(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(*_BASE)


def feed_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_a(table(spark, sf_dir, "lineitem"))


def _feed_a(lineitem: DataFrame) -> DataFrame:
    base = _base(lineitem)
    return base.where("h % 50 <> 5").selectExpr(*FEED_COLUMNS, "'source_a' AS source")


def feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_b(table(spark, sf_dir, "lineitem"))


def _feed_b(lineitem: DataFrame) -> DataFrame:
    base = _base(lineitem).where("h % 25 <> 0")
    # rows with h mod 50 = 6 are delivered twice: a narrow generator on one
    # scan instead of a union that would read lineitem a second time. Only a
    # copy counter is generated, so unused columns are still pruned below it.
    return (base.selectExpr(*[f"{_B_CHANGED.get(c, c)} AS {c}" for c in FEED_COLUMNS],
                            "explode(array_repeat(1, CASE WHEN h % 50 = 6 THEN 2 ELSE 1 END)) AS _copy",
                            "'source_b' AS source")
            .drop("_copy"))


RAW_COLUMNS = ["trade_id", "trade_date", "settlement_date", "ticker", "isin", "side", "quantity",
               "price", "consideration", "counterparty", "broker", "trader_id", "status"]


def _dirt(clean: str, *cases: tuple[int, str]) -> str:
    """CASE over k = h mod 40: 18 blanks every column, listed ks get their dirt."""
    whens = " ".join(f"WHEN k = {kk} THEN {v}" for kk, v in cases)
    return f"CASE WHEN k = 18 THEN '' {whens} ELSE {clean} END"


_DIRTY_PREP = [
    "(l_orderkey * 7 + l_linenumber) % 40 AS k", "to_date(l_shipdate) AS d",
    "CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'B' END AS raw_side",
    "concat('TRD', lpad(CAST(l_orderkey AS STRING), greatest(8, length(CAST(l_orderkey AS STRING))), '0'), '-', CAST(l_linenumber AS STRING)) AS tid",
    "CAST(CAST(l_quantity AS BIGINT) AS STRING) AS qty", "CAST(l_quantity AS BIGINT) AS q",
    "CAST(l_extendedprice AS DECIMAL(12,2)) AS px",
    "concat('P', CAST(l_partkey % 100 AS STRING)) AS tk",
    "concat('US', lpad(CAST(l_partkey % 10000000000 AS STRING), 10, '0')) AS isn",
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
]

_DIRTY = {
    "trade_id": _dirt("tid", (17, "'   '"),
                      (24, "concat(chr(9), tid, chr(13))"), (25, "concat(chr(10), chr(160), chr(9))")),
    "trade_date": _dirt("date_format(d, 'yyyy-MM-dd')", (16, "date_format(d, 'yyyy/MM/dd')")),
    "settlement_date": _dirt("date_format(date_add(d, 2), 'yyyy-MM-dd')",
                             (11, "date_format(date_sub(d, 1), 'yyyy-MM-dd')")),
    "ticker": _dirt("tk", (19, "concat(' ', lower(tk), ' ')"), (21, "concat(chr(160), tk, chr(9))")),
    "isin": _dirt("isn", (8, "substring(isn, 1, 5)"), (9, "concat('12', substring(isn, 3, 10))"),
                  (10, "concat(substring(isn, 1, 11), '*')"), (19, "concat(' ', lower(isn), ' ')"),
                  (22, "concat(chr(9), isn, chr(13))")),
    "side": _dirt("raw_side", (0, "CASE WHEN raw_side = 'B' THEN ' Buy ' ELSE ' sElL ' END"),
                  (1, "CASE WHEN raw_side = 'B' THEN '1' ELSE '-1' END"), (2, "'HOLD'"),
                  (20, "concat(raw_side, chr(9))")),
    "quantity": _dirt("qty", (3, "'1,234'"), (4, "concat(qty, 'd')"), (7, "concat('-', qty)"),
                      (23, "concat(qty, chr(160))")),
    "price": _dirt("CAST(px AS STRING)", (5, "'NaN'"), (6, "'0'")),
    "consideration": _dirt("CAST(px * q AS STRING)", (12, "CAST(px * q * 2 AS STRING)")),
    "counterparty": _dirt("concat('CP', CAST(l_suppkey AS STRING))", (14, "''")),
    "broker": _dirt("concat('BR', l_linestatus)", (15, "'N/A'")),
    "trader_id": _dirt("concat('TDR', CAST(l_suppkey AS STRING))"),
    "status": _dirt("CASE WHEN l_linestatus = 'O' THEN 'CONFIRMED' ELSE 'PENDING' END", (13, "'DONE'")),
}


def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string raw feed with one kind of dirt per ``h mod 40`` (0..25);
    the other rows are clean text. ``ingest_seq`` is the lineitem key."""
    li = table(spark, sf_dir, "lineitem").selectExpr(*_DIRTY_PREP)
    return li.selectExpr(*[f"{v} AS {n}" for n, v in _DIRTY.items()],
                         "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ingest_seq")
