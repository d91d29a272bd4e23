"""Catalogue: sources (S1-S7, F11). File fixtures are written by the job from
feed A into the shared checkpoint folder, then read back through the loaders."""

from __future__ import annotations

import os
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.functions.ids import sha256_hex
from tradetally.plans import sql_feeds as S
from tradetally.plans.registry import query
from tradetally.schemas import TRADE_COLUMNS
from tradetally.session import scratch_path
from tradetally.sources import files, readers
from tradetally.sources.fixtures import feed_a, ordered_feed
from tradetally.sources.tables import table

CANON = [c for c in TRADE_COLUMNS]
CANON_SQL = ", ".join(CANON)

# Fixed-width layout of the written feed: (name, start, end), 0-based half-open.
_WIDTHS = {"trade_id": 24, "trade_date": 10, "settlement_date": 10, "ticker": 8, "isin": 12, "side": 4,
           "quantity": 24, "price": 24, "consideration": 24, "counterparty": 24, "broker": 8, "status": 10}
_ENDS = list(accumulate(_WIDTHS.values()))
FIXED_WIDTH = [(n, e - w, e) for (n, w), e in zip(_WIDTHS.items(), _ENDS)]


def _fixture_dir(spark: SparkSession, kind: str) -> str:
    return scratch_path(spark, f"fixtures/{kind}")


def write_feed_csv(spark: SparkSession, sf_dir: str, side: str = "a") -> str:
    """Feed A or B as compressed CSV part files, globally sorted by (trade_id, survivor
    order): file order then yields the same surviving copies as FEED_ORDER."""
    path = _fixture_dir(spark, f"feed_{side}_csv")
    (ordered_feed(spark, sf_dir, side).select(*[c for c in CANON if c != "source"])
     .write.mode("overwrite").option("header", True).option("compression", "gzip")
     .option("zlib.compress.level", "FOUR").csv(path))
    return path


def write_feed_a_csv(spark: SparkSession, sf_dir: str) -> str:
    return write_feed_csv(spark, sf_dir, "a")


def write_feed_a_fixed(spark: SparkSession, sf_dir: str) -> str:
    path = _fixture_dir(spark, "feed_a_fixed")
    a = feed_a(spark, sf_dir)

    def slot(name: str, width: int):
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        wide = F.raise_error(F.concat(F.lit(f"{name} is wider than its {width} characters: "), value)).cast("string")
        return F.when(F.length(value) > width, wide).otherwise(F.rpad(value, width, " "))

    line = F.concat(*[slot(n, e - s) for n, s, e in FIXED_WIDTH])
    a.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


_FEED_A_CANON = S.with_ctes(S.FEEDS, f"SELECT {CANON_SQL} FROM feed_a")


@query("csv_load", _FEED_A_CANON)
def csv_load(spark, sf_dir):
    """All-string CSV read, normalised, strict dates."""
    path = write_feed_a_csv(spark, sf_dir)
    return readers.load_csv(spark, path, "source_a", date_format="%Y-%m-%d").select(*CANON)


# every seventh counterparty has an address of several lines, with a quote and a comma
_ADDRESS = "counterparty || chr(10) || 'Floor \"2\", ' || broker || chr(10) || chr(10) || 'x'"


@query("csv_multiline", S.with_ctes(S.FEEDS, f"""SELECT {CANON_SQL.replace("counterparty", f"""
    CASE WHEN CAST(substr(isin, 3) AS BIGINT) % 7 = 0 THEN {_ADDRESS} ELSE counterparty END AS counterparty""")} FROM feed_a"""))
def csv_multiline(spark, sf_dir):
    """S1 with line breaks in quoted fields: split by quote parity."""
    path = _fixture_dir(spark, "feed_a_multiline")
    long = F.concat("counterparty", F.lit('\nFloor "2", '), "broker", F.lit("\n\nx"))
    odd = F.substring("isin", 3, 10).cast("long") % 7 == 0
    feed = feed_a(spark, sf_dir).withColumn("counterparty", F.when(odd, long).otherwise(F.col("counterparty")))
    feed.select(*[c for c in CANON if c != "source"]).write.option("header", True).option("escape", '"').csv(path)
    return readers.load_csv(spark, path, "source_a", date_format="%Y-%m-%d", multiline=True).select(*CANON)


@query("fixed_width_load", _FEED_A_CANON)
def fixed_width_load(spark, sf_dir):
    """Fixed-width slices of a header-less text file."""
    path = write_feed_a_fixed(spark, sf_dir)
    df = readers.load_fixed_width(spark, path, "source_a",
                                  colspecs=[(s, e) for _, s, e in FIXED_WIDTH],
                                  col_names=[n for n, _, _ in FIXED_WIDTH],
                                  date_format="%Y-%m-%d")
    return _canon(df)


def _canon(df: DataFrame) -> DataFrame:
    return df.select(*[c if c in df.columns else F.lit(None).cast("string").alias(c)
                       for c in CANON])


# The query renames columns the way another system might (header aliases, P1/P2).
SOURCE_QUERY = """
SELECT concat('TRD', lpad(CAST(l_orderkey AS STRING), greatest(8, length(CAST(l_orderkey AS STRING))), '0'), '-', CAST(l_linenumber AS STRING)) AS `Trade Ref`,
       CAST(l_shipdate AS DATE) AS `Exec Date`,
       date_add(CAST(l_shipdate AS DATE), 2) AS `Settle Date`,
       concat('P', CAST(l_partkey % 100 AS STRING)) AS ticker,
       concat('US', lpad(CAST(l_partkey % 10000000000 AS STRING), 10, '0')) AS isin,
       CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'B' END AS Direction,
       l_quantity AS ` QTY `,
       try_divide(l_extendedprice, l_quantity) AS `Exec Price`,
       l_extendedprice AS Notional,
       concat('CP', CAST(l_suppkey AS STRING)) AS CPTY,
       concat('BR', l_linestatus) AS `Executing Broker`,
       CASE WHEN l_linestatus = 'O' THEN 'CONFIRMED' ELSE 'PENDING' END AS status
FROM lineitem
WHERE (l_orderkey * 7 + l_linenumber) % 50 <> 5
"""


@query("query_load", _FEED_A_CANON)
def query_load(spark, sf_dir):
    """S3: a SQL source over a registered view, with aliased headers."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    df = readers.load_query(spark, SOURCE_QUERY, "source_a", date_format="%Y-%m-%d",
                            order_by=["isin", "CPTY", " QTY ", "Exec Price", "Exec Date", "Direction"])
    return _canon(df)


@query("file_fingerprint", """
SELECT regexp_extract(filename, '[^/]+$') AS name, size AS length, sha256(content) AS sha256
FROM read_blob('/root/testdata/sf0.01/*.parquet')""")
def file_fingerprint(spark, sf_dir):
    """SHA-256 of every driver table file (one task per file)."""
    fp = files.file_fingerprint(spark, os.path.join(sf_dir, "*.parquet"))
    return fp.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "sha256")


#: Bytes of a chunk and children of a node in the query below.
_CHUNK, _FANOUT = 4096, 16
_HEX = 2 * _CHUNK


def _level(source: str) -> str:
    return f"""SELECT name, length, chunks, place // {_FANOUT} AS place,
      CASE WHEN count(*) = 1 AND place // {_FANOUT} = 0 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
      FROM {source} GROUP BY name, length, chunks, place // {_FANOUT}"""


@query("file_merkle_roots", f"""
WITH f AS (SELECT regexp_extract(filename, '[^/]+$') AS name, size AS length, hex(content) AS h,
    greatest(1, CAST(ceil(size / {_CHUNK}) AS BIGINT)) AS chunks FROM read_blob('/root/testdata/sf0.01/*.parquet')),
l0 AS (SELECT name, length, chunks, place, sha256(unhex(substr(h, place * {_HEX} + 1, {_HEX}))) AS digest
    FROM (SELECT *, unnest(range(chunks)) AS place FROM f)),
l1 AS ({_level("l0")}), l2 AS ({_level("l1")}), l3 AS ({_level("l2")})
SELECT name, length, chunks, digest AS merkle_root FROM l3""")
def file_merkle_roots(spark, sf_dir):
    """A hash tree over every file's chunks, hashed in many tasks."""
    roots = files.merkle_roots(spark, os.path.join(sf_dir, "*.parquet"), chunk_bytes=_CHUNK, fanout=_FANOUT)
    return roots.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "chunks", "merkle_root")


@query("source_profile", """
SELECT regexp_extract(filename, '[^/]+$') AS name, size AS length, size < 10 AS too_small, true AS found
FROM read_blob('/root/testdata/sf0.01/*.parquet')
UNION ALL SELECT 'trades_b.csv', NULL, NULL, false""")
def source_profile(spark, sf_dir):
    """size/presence profile without reading file bytes."""
    prof = files.source_profile(spark, os.path.join(sf_dir, "*.parquet"),
                                expected=["lineitem.parquet", "orders.parquet", "trades_b.csv"])
    return prof.select("name", "length", "too_small", "found")


@query("content_sha256", "SELECT doc_id, sha256(text) AS sha256, n_chars FROM documents")
def content_sha256(spark, sf_dir):
    """SHA-256 of every document's full text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", sha256_hex(F.col("text")).alias("sha256"), "n_chars")


@query("daily_run", S.with_ctes(S.FLAGGED, """
SELECT 'run-0001' AS run_id, 'COMPLETED' AS status,
  count(*) FILTER (WHERE dup_a) + count(*) FILTER (WHERE dup_b) + count(*) FILTER (WHERE missing_in_a OR missing_in_b)
  + count(*) FILTER (WHERE side_break) + count(*) FILTER (WHERE qty_break) + count(*) FILTER (WHERE price_break)
  + count(*) FILTER (WHERE settle_break) AS total_breaks,
  count(*) FILTER (WHERE side_break) AS critical_breaks,
  count(*) FILTER (WHERE dup_a) + count(*) FILTER (WHERE dup_b) + count(*) FILTER (WHERE missing_in_a OR missing_in_b)
  + count(*) FILTER (WHERE qty_break) AS high_breaks,
  count(*) FILTER (WHERE price_break) + count(*) FILTER (WHERE settle_break) AS medium_breaks,
  (SELECT count(*) FROM feed_a WHERE abs(consideration - quantity * price) <= greatest(quantity * price * 0.01, 0.01))
    AS source_a_count,
  (SELECT count(*) FROM feed_b WHERE abs(consideration - quantity * price) <= greatest(quantity * price * 0.01, 0.01))
    AS source_b_count,
  count(*) FILTER (WHERE clean) AS matched_count
FROM flagged"""))
def daily_run(spark, sf_dir):
    """A whole day end to end (guardrail S6, ingestion S1/S5/V/A5/V12, C10,
    K1-K4, A6/A7): both feeds as CSV files, the run row read back from the ledger."""
    import datetime as dt
    from tradetally.runner import SourceSpec, run_day
    pa, pb = write_feed_csv(spark, sf_dir, "a"), write_feed_csv(spark, sf_dir, "b")
    root = _fixture_dir(spark, "daily-ledger")
    row = run_day(spark, root, "run-0001", dt.date(2026, 3, 1),
                  SourceSpec(pa, "source_a", date_format="%Y-%m-%d"),
                  SourceSpec(pb, "source_b", date_format="%Y-%m-%d"))
    return row.select("run_id", "status", "total_breaks", "critical_breaks", "high_breaks",
                      "medium_breaks", "source_a_count", "source_b_count", "matched_count")
