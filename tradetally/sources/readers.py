"""Source loaders (S1-S4, S7): every source is read as all-string columns,
tagged with its ingest order, then normalised (P9) and checked (P10).

Nothing is collected: the only jobs a loader runs are the ones it must run
to fail fast (empty source, and strict date parsing when asked).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradetally.functions.text import strip, upper_trim
from tradetally.operators.elect import DateFormatError, elect
from tradetally.operators.normalise import (MALFORMED, canonical_name, check_required_columns, computed_once,
                                            date_failures, normalise, normalise_columns)
from tradetally.schemas import DATE_COLUMNS
from tradetally.sources import quoted
from tradetally.sources.files import file_fingerprint


class SourceError(ValueError):
    pass


def with_ingest_seq(df: DataFrame) -> DataFrame:
    """File order as a sortable struct, taken in the scan projection:
    (file path, split start offset, row id within the split). Ordering by the
    row id alone is wrong: Spark packs larger splits first."""
    seq = F.struct(F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row"))
    return df.select("*", seq.alias("ingest_seq"))


def _finish(df: DataFrame, source_name: str, date_format: str | None, dates: str,
            what: str, fold_na: bool = True, stripped: bool = False,
            narrow: Callable[[Sequence[str]], DataFrame] | None = None) -> DataFrame:
    """Normalise, check required columns (plan time), then the S7 empty check
    and the P4 date policy. Without ``date_format`` one format is elected for each
    date column first (``operators.elect``). ``strict`` checks every date in one aggregate job
    now; ``strict_lazy`` folds the check into the parse, so the first job
    that uses the dates fails instead (no extra pass over the source);
    ``quarantine`` flags rows with ``date_parse_failed`` and keeps the text of
    malformed rows in ``MALFORMED``, which the strict policies reject. ``narrow``
    yields the source with some columns only, where ``df`` cannot be pruned."""
    if date_format is None:
        try:
            date_format = elect(normalise_columns(df), DATE_COLUMNS, fold_na=fold_na, whole=dates != "quarantine")
        except DateFormatError as e:
            raise SourceError(f"Failed to parse date columns of '{source_name}': {e}") from e
    norm = normalise(df, source_name, date_format, fold_na=fold_na, keep_raw_dates=True, stripped=stripped)
    missing = check_required_columns(norm)
    if missing:
        raise SourceError(f"Source '{source_name}' missing required columns after "
                          f"normalisation: {missing}")
    malformed = F.col(MALFORMED).isNotNull() if MALFORMED in norm.columns else F.lit(False)
    if dates == "strict":
        # a row that is malformed or has a bad date is not an empty one, so the check
        # reads no other column
        dated = [c for c in df.columns if canonical_name(c) in (*DATE_COLUMNS, MALFORMED)]
        few = narrow(dated) if narrow else df.select(*[F.col(f"`{c}`") for c in dated])
        checked = normalise(few, source_name, date_format, fold_na=fold_na,
                            keep_raw_dates=True, drop_empty=False, stripped=stripped)
        row = checked.agg(F.count_if(malformed).alias("malformed"),
                          F.count_if(date_failures(checked)).alias("bad")).first()
        if not (row["malformed"] or row["bad"]) and norm.isEmpty():
            raise SourceError(f"{what} is empty")
        if row["malformed"]:
            raise SourceError(f"{what}: {row['malformed']} malformed row(s)")
        if row["bad"]:
            raise SourceError(f"Failed to parse date columns of '{source_name}': "
                              f"{row['bad']} row(s) do not match {date_format or 'any known format'}")
    elif dates in ("quarantine", "strict_lazy"):
        if norm.isEmpty():
            raise SourceError(f"{what} is empty")
    else:
        raise ValueError(f"dates must be 'strict', 'strict_lazy' or 'quarantine', not {dates!r}")
    raw_cols = [c for c in norm.columns if c.endswith("_raw")]
    if dates == "quarantine":
        return norm.withColumn("date_parse_failed", date_failures(norm)).drop(*raw_cols)
    if MALFORMED in norm.columns:
        if dates == "strict_lazy":
            fail = F.raise_error(F.concat(F.lit(f"{what}: malformed row "), F.col(MALFORMED))).cast("string")
            norm = norm.withColumn("trade_id", F.when(malformed, fail).otherwise(F.col("trade_id")))
        norm = norm.drop(MALFORMED)
    if dates == "strict_lazy":
        # no separate pass: the first job that reads a date fails on a bad one
        msg = (f"Failed to parse date columns of '{source_name}': a value does not match "
               f"{date_format or 'any known format'}")
        for c in [r[:-4] for r in raw_cols]:
            bad = F.col(c + "_raw").isNotNull() & F.col(c).isNull()
            norm = norm.withColumn(c, F.when(bad, F.raise_error(F.lit(msg)).cast("date"))
                                   .otherwise(F.col(c)))
    return norm.drop(*raw_cols)


def _exists(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.globStatus(p):
        raise FileNotFoundError(f"Source not found: {path}")


def read_csv_raw(spark: SparkSession, path: str, encoding: str = "utf-8",
                 multiline: bool = False) -> DataFrame:
    """All-string CSV read (no schema inference); quoted fields may hold commas.
    ``multiline=True`` allows line breaks inside quoted fields, at the price of
    one task per file; ``load_csv`` reads such files in many tasks
    (``sources.quoted``). A row with more or fewer
    fields than the header has its whole text in the column ``MALFORMED``."""
    reader = (spark.read.option("header", True).option("inferSchema", False)
              .option("escape", '"').option("encoding", encoding)
              .option("multiLine", multiline).option("columnPruning", False)
              .option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False)
              .option("ignoreTrailingWhiteSpace", False))
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED]])
    return reader.option("columnNameOfCorruptRecord", MALFORMED).schema(schema).csv(path)


def load_csv(spark: SparkSession, path: str, source_name: str, encoding: str = "utf-8",
             date_format: str | None = None, dates: str = "strict",
             multiline: bool = False) -> DataFrame:
    """S1. ``multiline=True`` allows line breaks inside quoted fields; its files
    are split like others, except in an encoding of wide characters."""
    _exists(spark, path)
    if multiline and quoted.splittable(encoding):
        names = read_csv_raw(spark, path, encoding, multiline).columns[:-1]
        try:
            raw = quoted.read_quoted_csv(spark, path, names, MALFORMED, encoding)
        except quoted.UnclosedQuote as e:
            raise SourceError(f"CSV file {path}: {e}") from e
    else:
        raw = with_ingest_seq(read_csv_raw(spark, path, encoding, multiline))
    return _finish(raw, source_name, date_format, dates, f"CSV file {path}")


def load_fixed_width(spark: SparkSession, path: str, source_name: str,
                     colspecs: Sequence[tuple[int, int]], col_names: Sequence[str],
                     encoding: str = "utf-8", date_format: str | None = None,
                     dates: str = "strict") -> DataFrame:
    """0-based half-open ``(start, end)`` slices of each line, no header;
    fields trimmed, blank fields NULL. Lines are read by the CSV source with a
    separator that no text holds, since it decodes any ``encoding`` and splits."""
    if len(colspecs) != len(col_names):
        raise ValueError("colspecs and col_names differ in length")
    _exists(spark, path)
    lines = (spark.read.schema("value string").option("encoding", encoding).option("sep", "\uffff")
             .option("quote", "").option("escape", "").option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False).csv(path))
    lines = with_ingest_seq(lines).where(F.length(strip(F.col("value"))) > 0)

    def fields(names: Sequence[str]) -> DataFrame:
        # each slice is cut once: a projection would be repeated wherever a slice is named
        own = {f"_{i}": (n, s, e) for i, ((s, e), n) in enumerate(zip(colspecs, col_names)) if n in names}
        if not own:
            return lines.select("ingest_seq")
        cut = lines.select("ingest_seq", F.inline(F.array(F.struct(*[_slice("value", s, e).alias(i)
                                                                     for i, (_, s, e) in own.items()]))))
        cut = computed_once(cut, ["ingest_seq"], {i: strip(F.col(i)) for i in own})
        return cut.select(*[F.nullif(F.col(i), F.lit("")).alias(n) for i, (n, _, _) in own.items()], "ingest_seq")

    return _finish(fields(col_names), source_name, date_format, dates, f"Fixed-width file {path}", stripped=True,
                   narrow=fields)


def _slice(name: str, start: int, end: int) -> F.Column:
    """Characters ``start`` to ``end``. Where every character is one byte the
    bytes are cut, as looking for a character walks the line from its start."""
    c = F.col(name)
    at, n = F.lit(start + 1), F.lit(end - start)
    return F.when(F.octet_length(c) == F.length(c), c.cast("binary").substr(at, n).cast("string")).otherwise(c.substr(at, n))


def load_query(spark: SparkSession, sql: str, source_name: str, date_format: str | None = None,
               dates: str = "strict", *, order_by: Sequence[str]) -> DataFrame:
    """S3: a SELECT over registered views / catalog tables (or any JDBC frame
    via ``load_frame``); results become strings, then the usual pipeline.
    ``order_by`` names result columns that fix which copy of an id is first.
    Texts such as ``NA`` are values here: only a file's reader folds them."""
    return load_frame(spark.sql(sql), source_name, date_format, dates, "query result", order_by, fold_na=False)


def load_frame(df: DataFrame, source_name: str, date_format: str | None = None,
               dates: str = "strict", what: str = "frame",
               order_by: Sequence[str] | None = None, fold_na: bool = True) -> DataFrame:
    """Any DataFrame as a source: every column cast to string. The ingest order
    is ``order_by`` when given, else the frame's partition order (only stable
    for a deterministic scan). ``fold_na`` makes missing-value tokens NULL."""
    cols = [F.col(c).cast("string").alias(c) for c in df.columns]
    seq = (F.struct(*[F.col(c) for c in order_by]) if order_by
           else F.monotonically_increasing_id())
    return _finish(df.select(*cols, seq.alias("ingest_seq")), source_name, date_format, dates,
                   what, fold_na)


LOADERS: dict[str, Callable[..., DataFrame]] = {
    "csv": load_csv,
    "fixed_width": load_fixed_width,
}


def load_source(spark: SparkSession, path: str, source_name: str, file_type: str = "csv",
                encoding: str = "utf-8", date_format: str | None = None,
                **kw) -> tuple[DataFrame, DataFrame]:
    """(normalised frame, fingerprint frame). The fingerprint is a lazy
    one-row-per-file frame (path, length, sha256); nothing is hashed until it
    is used. ``file_type='query'`` takes ``sql=`` instead of a path."""
    ft = file_type.lower()
    if ft == "query":
        return load_query(spark, kw.pop("sql"), source_name, date_format, **kw), None
    loader = LOADERS.get(ft)
    if loader is None:
        raise ValueError(f"Unsupported file type '{file_type}'. Supported types: "
                         f"{sorted(LOADERS) + ['query']}")
    df = loader(spark, path, source_name, encoding=encoding, date_format=date_format, **kw)
    return df, file_fingerprint(spark, path)


__all__ = ["load_csv", "load_fixed_width", "load_query", "load_frame", "load_source",
           "with_ingest_seq", "read_csv_raw", "SourceError", "load_reference_csv"]


def load_reference_csv(spark: SparkSession, path: str, key: str = "ticker",
                       encoding: str = "utf-8", malformed: str = "fail") -> DataFrame:
    """Security master CSV (ticker, isin, name, asset_class, currency),
    all strings, keys trimmed and upper-cased. Rows that do not fit the header
    fail the load; ``malformed="quarantine"`` keeps every row, with the text of
    such rows in the column ``MALFORMED`` and their fields NULL."""
    if malformed not in ("fail", "quarantine"):
        raise ValueError(f"malformed must be 'fail' or 'quarantine', not {malformed!r}")
    _exists(spark, path)
    df = read_csv_raw(spark, path, encoding)
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    bad = F.col(MALFORMED).isNotNull()
    if malformed == "quarantine":
        df = df.select(*[F.when(~bad, F.col(c)).alias(c) for c in df.columns if c != MALFORMED], MALFORMED)
    else:
        # the reader refuses to read the column of malformed rows alone
        n = df.agg(F.count_if(bad).alias("n"), F.count(F.col(df.columns[0]))).first()["n"]
        if n:
            raise SourceError(f"Security master {path}: {n} malformed row(s)")
        df = df.drop(MALFORMED)
    return df.select(*[(upper_trim(F.col(c)) if c in (key, "isin") else F.col(c) if c == MALFORMED
                        else strip(F.col(c))).alias(c) for c in df.columns])
