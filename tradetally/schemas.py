"""Canonical trade contract, break contract and the fixed values that must
equal the reconciled system's behaviour."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reconciled system exactly)
# ---------------------------------------------------------------------------

# Required canonical columns, in reporting order.
REQUIRED_COLUMNS = [
    "trade_id", "trade_date", "settlement_date", "ticker",
    "isin", "side", "quantity", "price", "consideration",
    "counterparty", "broker", "status",
]
OPTIONAL_COLUMNS = ["trader_id", "source"]
DATE_COLUMNS = ["trade_date", "settlement_date"]
NUMERIC_COLUMNS = ["quantity", "price", "consideration"]

# Source header aliases -> canonical name (header is first stripped,
# lower-cased and has spaces replaced by underscores).
# The alias "trade date" is left out: it can never match after the space fold.
COLUMN_ALIASES = {
    "tradeid": "trade_id", "trade_ref": "trade_id", "reference": "trade_id",
    "ref": "trade_id", "id": "trade_id",
    "tradedate": "trade_date", "execution_date": "trade_date", "exec_date": "trade_date",
    "settlementdate": "settlement_date", "settle_date": "settlement_date",
    "settledate": "settlement_date", "value_date": "settlement_date",
    "direction": "side", "buysell": "side", "buy_sell": "side", "action": "side",
    "qty": "quantity", "shares": "quantity", "units": "quantity",
    "nominal": "quantity", "face_value": "quantity",
    "exec_price": "price", "execution_price": "price", "unit_price": "price",
    "clean_price": "price",
    "gross_amount": "consideration", "net_amount": "consideration",
    "amount": "consideration", "value": "consideration", "notional": "consideration",
    "cpty": "counterparty", "counter_party": "counterparty", "cp": "counterparty",
    "executing_broker": "broker", "exec_broker": "broker", "agent": "broker",
}

# The characters that count as white space when text is stripped.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Side value map applied after trim + upper.
SIDE_MAP = {"B": "BUY", "S": "SELL", "1": "BUY", "-1": "SELL"}

# Strings a pandas CSV reader folds to missing by default (public pandas docs).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

SIDES = ["BUY", "SELL"]
TRADE_STATUSES = ["CONFIRMED", "PENDING", "CANCELLED", "FAILED"]
BREAK_TYPES = ["MISSING", "DUPLICATE", "QTY_BREAK", "PRICE_BREAK", "SETTLE_BREAK", "SIDE_BREAK"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
RUN_STATUSES = ["RUNNING", "COMPLETED", "FAILED", "PARTIAL"]
AUDIT_STATUSES = ["SUCCESS", "FAILURE", "WARNING", "INFO"]

# Severity per break type.
SEVERITY_BY_TYPE = {
    "SIDE_BREAK": "CRITICAL",
    "MISSING": "HIGH",
    "DUPLICATE": "HIGH",
    "QTY_BREAK": "HIGH",
    "PRICE_BREAK": "MEDIUM",
    "SETTLE_BREAK": "MEDIUM",
}

# Default tolerances.
DEFAULT_TOLERANCES = {
    "quantity_tolerance": 0.0,
    "price_tolerance": 0.01,
    "consideration_tolerance": 1.00,
    "settlement_date_tolerance_days": 0,
    "side_tolerance": 0,
}

# Per-asset-class overrides as configured.
ASSET_CLASS_TOLERANCES = {
    "equities": {"quantity_tolerance": 0.0, "price_tolerance": 0.01,
                 "consideration_tolerance": 1.00, "settlement_date_tolerance_days": 0},
    "etf": {"quantity_tolerance": 0.0, "price_tolerance": 0.01,
            "consideration_tolerance": 1.00, "settlement_date_tolerance_days": 0},
}

# Escalation thresholds.
ESCALATION = {
    "break_count_threshold": 10,
    "consideration_threshold": 100000.00,
    "always_escalate_critical": True,
}

MIN_FILE_SIZE_BYTES = 10
ERROR_TEXT_LIMIT = 200
ERROR_LIST_LIMIT = 10

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------

TRADE_SCHEMA = T.StructType([
    T.StructField("trade_id", T.StringType()),
    T.StructField("trade_date", T.DateType()),
    T.StructField("settlement_date", T.DateType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("isin", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("consideration", T.DoubleType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("broker", T.StringType()),
    T.StructField("trader_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("source", T.StringType()),
])
TRADE_COLUMNS = [f.name for f in TRADE_SCHEMA.fields]

# Breaks keep typed values; the reference's text columns are a rendering
# (tradetally.functions.render).
BREAK_SCHEMA = T.StructType([
    T.StructField("break_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("trade_id", T.StringType()),
    T.StructField("break_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("occurrences", T.LongType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("a_str", T.StringType()),
    T.StructField("b_str", T.StringType()),
    T.StructField("a_num", T.DoubleType()),
    T.StructField("b_num", T.DoubleType()),
    T.StructField("diff_num", T.DoubleType()),
    T.StructField("a_date", T.DateType()),
    T.StructField("b_date", T.DateType()),
    T.StructField("diff_days", T.IntegerType()),
])
BREAK_COLUMNS = [f.name for f in BREAK_SCHEMA.fields]

RUN_EVENT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_date", T.DateType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_breaks", T.LongType()),
    T.StructField("critical_breaks", T.LongType()),
    T.StructField("high_breaks", T.LongType()),
    T.StructField("medium_breaks", T.LongType()),
    T.StructField("source_a_count", T.LongType()),
    T.StructField("source_b_count", T.LongType()),
    T.StructField("matched_count", T.LongType()),
    T.StructField("report_path", T.StringType()),
    T.StructField("email_sent", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("event", T.StringType()),
    # with updated_at the event's logical time: place among events of one instant, and who wrote it
    T.StructField("event_seq", T.LongType()),
    T.StructField("writer", T.StringType()),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("audit_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("agent_name", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("input_hash", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
