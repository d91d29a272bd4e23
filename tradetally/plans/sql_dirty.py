"""SQL (DuckDB) twin of the dirty raw feed and of its normalisation."""

from __future__ import annotations

from tradetally.schemas import NA_TOKENS

_NA = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
COLS = ["trade_id", "trade_date", "settlement_date", "ticker", "isin", "side", "quantity",
        "price", "consideration", "counterparty", "broker", "trader_id", "status"]


def _d(clean: str, *cases: tuple[int, str]) -> str:
    w = " ".join(f"WHEN k = {kk} THEN {v}" for kk, v in cases)
    return f"CASE WHEN k = 18 THEN '' {w} ELSE {clean} END"


RAW = f"""
li AS (
  SELECT *, (l_orderkey * 7 + l_linenumber) % 40 AS k, CAST(l_shipdate AS DATE) AS d,
         CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'B' END AS raw_side,
         'TRD' || lpad(CAST(l_orderkey AS VARCHAR), CAST(greatest(8, length(CAST(l_orderkey AS VARCHAR))) AS INTEGER), '0') || '-' || CAST(l_linenumber AS VARCHAR) AS tid,
         CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS px,
         'P' || CAST(l_partkey % 100 AS VARCHAR) AS tk,
         'US' || lpad(CAST(l_partkey % 10000000000 AS VARCHAR), 10, '0') AS isn
  FROM lineitem
),
raw AS (
  SELECT
    {_d("tid", (17, "'   '"), (24, "chr(9) || tid || chr(13)"), (25, "chr(10) || chr(160) || chr(9)"))} AS trade_id,
    {_d("strftime(d, '%Y-%m-%d')", (16, "strftime(d, '%Y/%m/%d')"))} AS trade_date,
    {_d("strftime(d + 2, '%Y-%m-%d')", (11, "strftime(d - 1, '%Y-%m-%d')"))} AS settlement_date,
    {_d("tk", (19, "' ' || lower(tk) || ' '"), (21, "chr(160) || tk || chr(9)"))} AS ticker,
    {_d("isn", (8, "substring(isn, 1, 5)"), (9, "'12' || substring(isn, 3, 10)"),
        (10, "substring(isn, 1, 11) || '*'"), (19, "' ' || lower(isn) || ' '"), (22, "chr(9) || isn || chr(13)"))} AS isin,
    {_d("raw_side", (0, "CASE WHEN raw_side = 'B' THEN ' Buy ' ELSE ' sElL ' END"),
        (1, "CASE WHEN raw_side = 'B' THEN '1' ELSE '-1' END"), (2, "'HOLD'"), (20, "raw_side || chr(9)"))} AS side,
    {_d("qty", (3, "'1,234'"), (4, "qty || 'd'"), (7, "'-' || qty"), (23, "qty || chr(160)"))} AS quantity,
    {_d("CAST(px AS VARCHAR)", (5, "'NaN'"), (6, "'0'"))} AS price,
    {_d("CAST(px * CAST(l_quantity AS BIGINT) AS VARCHAR)",
        (12, "CAST(px * CAST(l_quantity AS BIGINT) * 2 AS VARCHAR)"))} AS consideration,
    {_d("'CP' || CAST(l_suppkey AS VARCHAR)", (14, "''"))} AS counterparty,
    {_d("'BR' || l_linestatus", (15, "'N/A'"))} AS broker,
    {_d("'TDR' || CAST(l_suppkey AS VARCHAR)")} AS trader_id,
    {_d("CASE WHEN l_linestatus = 'O' THEN 'CONFIRMED' ELSE 'PENDING' END", (13, "'DONE'"))} AS status,
    l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM li
)"""

_FOLD = ",\n    ".join(f"CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END AS {c}" for c in COLS)


def _num(c: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({c}), '{NUM}') AND NOT isnan(TRY_CAST(trim({c}) AS DOUBLE)) "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END")


def _side(c: str) -> str:
    u = f"upper(trim({c}))"
    return (f"CASE WHEN {u} = 'B' THEN 'BUY' WHEN {u} = 'S' THEN 'SELL' WHEN {u} = '1' THEN 'BUY' "
            f"WHEN {u} = '-1' THEN 'SELL' ELSE {u} END")


def _date(c: str, fmt: str = "%Y-%m-%d") -> str:
    return f"CAST(try_strptime(trim({c}), '{fmt}') AS DATE)"


NORM = RAW + f""",
folded AS (
  SELECT {_FOLD}, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM raw
),
norm AS (
  SELECT trim(trade_id) AS trade_id,
         {_date("trade_date")} AS trade_date, {_date("settlement_date")} AS settlement_date,
         trade_date AS trade_date_raw, settlement_date AS settlement_date_raw,
         trim(ticker) AS ticker, trim(isin) AS isin, {_side("side")} AS side,
         {_num("quantity")} AS quantity, {_num("price")} AS price, {_num("consideration")} AS consideration,
         trim(counterparty) AS counterparty, trim(broker) AS broker, trim(trader_id) AS trader_id,
         trim(status) AS status, 'source_a' AS source,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM folded
  WHERE NOT ({" AND ".join(f"{c} IS NULL" for c in COLS)})
)"""


def _code(cond: str, code: str) -> str:
    return f"CASE WHEN {cond} THEN '{code}' END"


def field_codes(strict_isin: bool = False, date_range: tuple[str, str] | None = None) -> list[str]:
    out = []
    for f in ["trade_id", "trade_date", "settlement_date", "ticker", "isin", "side", "quantity",
              "price", "consideration", "counterparty", "broker", "status"]:
        out.append(_code(f"{f} IS NULL", f"{f}:required"))
        if f in ("trade_id", "ticker", "counterparty", "broker"):
            out.append(_code(f"length(trim({f})) = 0", f"{f}:empty"))
        if f == "isin":
            out.append(_code("length(upper(trim(isin))) <> 12 OR NOT regexp_matches(upper(trim(isin)), '^[A-Z]{2}')",
                             "isin:format"))
            if strict_isin:
                out.append(_code("NOT regexp_matches(upper(trim(isin)), '^[A-Z]{2}[A-Z0-9]{10}$')", "isin:strict"))
        if f == "side":
            out.append(_code("side NOT IN ('BUY', 'SELL')", "side:enum"))
        if f == "status":
            out.append(_code("status NOT IN ('CONFIRMED', 'PENDING', 'CANCELLED', 'FAILED')", "status:enum"))
        if f in ("quantity", "price", "consideration"):
            out.append(_code(f"{f} <= 0", f"{f}:not_positive"))
    if date_range:
        out.append(_code(f"NOT (trade_date BETWEEN DATE '{date_range[0]}' AND DATE '{date_range[1]}')",
                         "trade_date:out_of_range"))
    return out


def validated(strict_isin: bool = False, date_range: tuple[str, str] | None = None) -> str:
    codes = ", ".join(field_codes(strict_isin, date_range))
    return NORM + f""",
fe AS (SELECT *, concat_ws('; ', {codes}) AS field_errors FROM norm),
validated AS (
  SELECT trim(trade_id) AS v_trade_id, *,
    CASE WHEN field_errors <> '' THEN field_errors
         WHEN settlement_date < trade_date THEN 'settlement_date:before_trade_date'
         WHEN abs(consideration - quantity * price) > greatest(quantity * price * 0.01, 0.01)
           THEN 'consideration:mismatch'
         ELSE '' END AS error_codes
  FROM fe
)"""
