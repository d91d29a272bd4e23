"""SQL (DuckDB dialect) for the derived feeds, shared by the oracles."""

from __future__ import annotations

import re

from tradetally.schemas import WHITE_SPACE

BASE = """
base AS (
  SELECT
    'TRD' || lpad(CAST(l_orderkey AS VARCHAR), CAST(greatest(8, length(CAST(l_orderkey AS VARCHAR))) AS INTEGER), '0') || '-' || CAST(l_linenumber AS VARCHAR) AS trade_id,
    CAST(l_shipdate AS DATE) AS trade_date,
    CAST(l_shipdate AS DATE) + 2 AS settlement_date,
    'P' || CAST(l_partkey % 100 AS VARCHAR) AS ticker,
    'US' || lpad(CAST(l_partkey % 10000000000 AS VARCHAR), 10, '0') AS isin,
    CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
    l_quantity AS quantity,
    l_extendedprice / l_quantity AS price,
    l_extendedprice AS consideration,
    'CP' || CAST(l_suppkey AS VARCHAR) AS counterparty,
    'BR' || l_linestatus AS broker,
    CAST(NULL AS VARCHAR) AS trader_id,
    CASE WHEN l_linestatus = 'O' THEN 'CONFIRMED' ELSE 'PENDING' END AS status,
    l_suppkey,
    l_orderkey * 7 + l_linenumber AS h
  FROM lineitem
)"""

FEEDS = BASE + """,
feed_a AS (
  SELECT trade_id, trade_date, settlement_date, ticker, isin, side, quantity, price,
         consideration, counterparty, broker, trader_id, status, l_suppkey, 'source_a' AS source
  FROM base WHERE h % 50 <> 5
),
b0 AS (
  SELECT trade_id, trade_date,
    CASE WHEN h % 25 = 4 THEN settlement_date + 1 ELSE settlement_date END AS settlement_date,
    ticker, isin,
    CASE WHEN h % 25 = 1 THEN CASE WHEN side = 'BUY' THEN 'SELL' ELSE 'BUY' END ELSE side END AS side,
    CASE WHEN h % 25 = 2 THEN quantity + 50 ELSE quantity END AS quantity,
    CASE WHEN h % 25 = 3 THEN price + 0.05::DOUBLE ELSE price END AS price,
    consideration, counterparty, broker, trader_id, status, l_suppkey, 'source_b' AS source, h
  FROM base WHERE h % 25 <> 0
),
feed_b AS (
  SELECT * EXCLUDE (h) FROM b0
  UNION ALL
  SELECT * EXCLUDE (h) FROM b0 WHERE h % 50 = 6
)"""

ORDER = "isin, l_suppkey, quantity, price, trade_date, side"

# one row per id per side: count + first copy
SIDES = FEEDS + f""",
ra AS (SELECT *, count(*) OVER (PARTITION BY trade_id) AS n,
              row_number() OVER (PARTITION BY trade_id ORDER BY {ORDER}) AS rn
       FROM feed_a WHERE trade_id IS NOT NULL AND trim(trade_id) <> ''),
rb AS (SELECT *, count(*) OVER (PARTITION BY trade_id) AS n,
              row_number() OVER (PARTITION BY trade_id ORDER BY {ORDER}) AS rn
       FROM feed_b WHERE trade_id IS NOT NULL AND trim(trade_id) <> ''),
fa AS (SELECT * FROM ra WHERE rn = 1),
fb AS (SELECT * FROM rb WHERE rn = 1),
pairs AS (
  SELECT coalesce(fa.trade_id, fb.trade_id) AS trade_id,
         fa.n AS n_a, fb.n AS n_b,
         fa.side AS side_a, fb.side AS side_b,
         fa.quantity AS quantity_a, fb.quantity AS quantity_b,
         fa.price AS price_a, fb.price AS price_b,
         fa.settlement_date AS settlement_date_a, fb.settlement_date AS settlement_date_b,
         fa.ticker AS ticker_a, fb.ticker AS ticker_b,
         fa.consideration AS consideration_a, fb.consideration AS consideration_b
  FROM fa FULL OUTER JOIN fb ON fa.trade_id = fb.trade_id
)"""


def flags(qty_tol: str = "0::DOUBLE", price_tol: str = "0.01::DOUBLE", settle_tol: str = "0") -> str:
    """Per-pair flag columns (SQL twin of operators.reconcile.flags)."""
    both = "(n_a IS NOT NULL AND n_b IS NOT NULL)"
    side = (f"({both} AND coalesce(upper(trim(side_a)), '?') <> '' AND coalesce(upper(trim(side_b)), '?') <> '' "
            "AND upper(trim(side_a)) IS DISTINCT FROM upper(trim(side_b)))")
    qty = f"({both} AND coalesce(abs(quantity_a - quantity_b) > {qty_tol}, false))"
    price = f"({both} AND coalesce(abs(price_a - price_b) > {price_tol}, false))"
    settle = f"({both} AND coalesce(abs(settlement_date_a - settlement_date_b) > {settle_tol}, false))"
    return f"""
    coalesce(n_a > 1, false) AS dup_a, coalesce(n_b > 1, false) AS dup_b,
    (n_a IS NOT NULL AND n_b IS NULL) AS missing_in_b,
    (n_a IS NULL AND n_b IS NOT NULL) AS missing_in_a,
    {side} AS side_break, {qty} AS qty_break, {price} AS price_break, {settle} AS settle_break,
    ({both} AND NOT ({side} OR {qty} OR {price} OR {settle})) AS clean"""


FLAGGED = SIDES + f""",
flagged AS (SELECT *, {flags()} FROM pairs)"""

BREAKS = FLAGGED + """,
breaks AS (
  SELECT 1 AS step, trade_id, 'DUPLICATE' AS break_type, 'HIGH' AS severity, 'source_a' AS source,
         n_a AS occurrences, NULL::VARCHAR AS ticker, NULL::DOUBLE AS unit_price,
         NULL::VARCHAR AS a_str, NULL::VARCHAR AS b_str, NULL::DOUBLE AS a_num, NULL::DOUBLE AS b_num,
         NULL::DOUBLE AS diff_num, NULL::DATE AS a_date, NULL::DATE AS b_date, NULL::INTEGER AS diff_days
  FROM flagged WHERE dup_a
  UNION ALL
  SELECT 2, trade_id, 'DUPLICATE', 'HIGH', 'source_b', n_b, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM flagged WHERE dup_b
  UNION ALL
  SELECT 3, trade_id, 'MISSING', 'HIGH', 'source_a', NULL, ticker_a, price_a, side_a, NULL, quantity_a, NULL, NULL, NULL, NULL, NULL
  FROM flagged WHERE missing_in_b
  UNION ALL
  SELECT 4, trade_id, 'MISSING', 'HIGH', 'source_b', NULL, ticker_b, price_b, NULL, side_b, NULL, quantity_b, NULL, NULL, NULL, NULL
  FROM flagged WHERE missing_in_a
  UNION ALL
  SELECT 5, trade_id, 'SIDE_BREAK', 'CRITICAL', NULL, NULL, NULL, NULL, upper(trim(side_a)), upper(trim(side_b)), NULL, NULL, NULL, NULL, NULL, NULL
  FROM flagged WHERE side_break
  UNION ALL
  SELECT 5, trade_id, 'QTY_BREAK', 'HIGH', NULL, NULL, NULL, NULL, NULL, NULL, quantity_a, quantity_b, quantity_a - quantity_b, NULL, NULL, NULL
  FROM flagged WHERE qty_break
  UNION ALL
  SELECT 5, trade_id, 'PRICE_BREAK', 'MEDIUM', NULL, NULL, NULL, NULL, NULL, NULL, price_a, price_b, price_a - price_b, NULL, NULL, NULL
  FROM flagged WHERE price_break
  UNION ALL
  SELECT 5, trade_id, 'SETTLE_BREAK', 'MEDIUM', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         settlement_date_a, settlement_date_b, CAST(abs(settlement_date_a - settlement_date_b) AS INTEGER)
  FROM flagged WHERE settle_break
)"""


def with_ctes(ctes: str, select: str) -> str:
    """The statement; every ``trim(x)`` strips all white space."""
    return re.sub(r"\btrim\(([^(),]+)\)", lambda m: f"trim({m[1]}, '{WHITE_SPACE}')", "WITH " + ctes.strip() + "\n" + select)
