"""Normalisation of a raw all-string source to the canonical trade schema.

All steps are column expressions over one projection: Catalyst collapses
them into a single Project inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradetally.functions.dates import parse_date
from tradetally.functions.numeric import parse_number
from tradetally.functions.text import fold_na as fold_na_value
from tradetally.functions.text import fold_strip, normalise_side, strip
from tradetally.schemas import (COLUMN_ALIASES, DATE_COLUMNS, NA_TOKENS, NUMERIC_COLUMNS,
                                REQUIRED_COLUMNS, TRADE_COLUMNS)

# the whole text of a row that did not fit its file's header
MALFORMED = "malformed_row"
# columns that are never source columns
META_COLUMNS = ("ingest_seq", "source", MALFORMED)


def canonical_name(raw: str, aliases: dict[str, str] = COLUMN_ALIASES) -> str:
    n = raw.strip().lower().replace(" ", "_")
    return aliases.get(n, n)


def normalise_columns(df: DataFrame, aliases: dict[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Strip, lower, space -> '_', alias rename. Metadata only.

    Two source columns folding to one name raise (the reference would carry
    duplicate labels and fail later)."""
    names = [canonical_name(c, aliases) if c not in META_COLUMNS else c for c in df.columns]
    seen: dict[str, str] = {}
    for raw, n in zip(df.columns, names):
        if n in seen:
            raise ValueError(f"columns {seen[n]!r} and {raw!r} both map to {n!r}")
        seen[n] = raw
    return df.toDF(*names)


def fold_na_tokens(df: DataFrame) -> DataFrame:
    """Reader NA tokens -> NULL on every string source column."""
    return df.select(*[fold_na_value(F.col(c)).alias(c) if t == "string" and c not in META_COLUMNS
                       else F.col(c) for c, t in df.dtypes])


def normalise_side_column(df: DataFrame) -> DataFrame:
    """P3 (no-op without a side column)."""
    if "side" not in df.columns:
        return df
    return df.withColumn("side", normalise_side(F.col("side")))


def normalise_dates(df: DataFrame, date_format: str | None = None,
                    keep_raw: bool = False) -> DataFrame:
    """Parse date columns; ``keep_raw`` keeps ``<col>_raw`` for the strict check."""
    out = df
    for c in DATE_COLUMNS:
        if c in df.columns:
            if keep_raw:
                out = out.withColumn(c + "_raw", F.col(c))
            out = out.withColumn(c, parse_date(F.col(c), date_format))
    return out


def date_failures(df: DataFrame) -> F.Column:
    """Rows whose raw date text did not parse (needs ``keep_raw``)."""
    cond = F.lit(False)
    for c in DATE_COLUMNS:
        if c + "_raw" in df.columns:
            cond = cond | (F.col(c + "_raw").isNotNull() & F.col(c).isNull())
    return cond


def normalise_numerics(df: DataFrame) -> DataFrame:
    """P5."""
    out = df
    for c in NUMERIC_COLUMNS:
        if c in df.columns:
            out = out.withColumn(c, parse_number(F.col(c)))
    return out


def add_source(df: DataFrame, source_name: str) -> DataFrame:
    """P6."""
    return df.withColumn("source", F.lit(source_name))


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return df.select(*[strip(F.col(c)).alias(c) if t == "string" and c != "source"
                       else F.col(c) for c, t in df.dtypes])


def drop_empty_rows(df: DataFrame, source_columns: list[str] | None = None) -> DataFrame:
    """Drop rows whose source columns are all NULL (the label column and
    ingest order do not count)."""
    cols = source_columns or [c for c in df.columns if c not in META_COLUMNS
                              and not c.endswith("_raw")]
    return df.na.drop(how="all", subset=cols)


def check_required_columns(df: DataFrame) -> list[str]:
    """P10: required canonical columns absent from the frame (plan time, no job)."""
    have = set(df.columns)
    return [c for c in REQUIRED_COLUMNS if c not in have]


#: Columns that one generated method computes; with more it is too long to be compiled.
STEP_COLUMNS = 6


def computed_once(df: DataFrame, keep: list, columns: dict[str, F.Column]) -> DataFrame:
    """``keep`` and ``columns`` (each of them from the column of its own name), a few
    columns a step. What follows reads their values: they come out of one-row
    generators, as projections are repeated in each filter and projection above."""
    names = list(columns)
    for at in range(0, len(names), STEP_COLUMNS):
        step, rest = names[at:at + STEP_COLUMNS], [*names[:at], *names[at + STEP_COLUMNS:]]
        df = df.select(*keep, *rest, F.inline(F.array(F.struct(*[columns[n].alias(n) for n in step]))))
        keep = df.columns[:len(keep)]
    return df if names else df.select(*keep)


def normalise(df: DataFrame, source_name: str, date_format: str | dict[str, str] | None = None,
              aliases: dict[str, str] = COLUMN_ALIASES, fold_na: bool = True,
              keep_raw_dates: bool = False, drop_empty: bool = True, stripped: bool = False) -> DataFrame:
    """P1, S8, P3, P4, P5, P6, P7 in one projection, then P8 (or, with
    ``drop_empty=False``, an ``empty_row`` flag instead of the drop).

    The steps compose per column, so each raw column feeds exactly one output
    expression (the step-by-step helpers above stay available on their own).
    Texts are folded and stripped by a step of their own, and parsed by the next:
    one method for both is too long for the JVM to compile. ``stripped`` says that
    texts are stripped already.
    ``date_format`` may name a format for each date column."""
    out = normalise_columns(df, aliases)
    source_cols = [c for c in out.columns if c not in META_COLUMNS]
    # P8 on the NA-folded source text: a cheap predicate next to the scan
    # (a drop after parsing would be pushed down with every parse inlined)
    empty = F.col(MALFORMED).isNull() if MALFORMED in out.columns else F.lit(True)
    types = dict(out.dtypes)
    for c in source_cols:
        if fold_na and types[c] == "string":
            # NULL or an NA token ('' is one): references the column once
            empty = empty & F.coalesce(F.col(c), F.lit("")).isin(*NA_TOKENS)
        else:
            empty = empty & F.col(c).isNull()
    if drop_empty:
        out = out.where(~empty)
    texts = [c for c in source_cols if types[c] == "string" and c != "source"]
    keep_text = [c for c in DATE_COLUMNS if keep_raw_dates and c in texts and not stripped]
    clean = {c: fold_na_value(F.col(c)) if stripped else fold_strip(F.col(c)) if fold_na else strip(F.col(c))
             for c in texts}
    if stripped and not fold_na:
        clean = {c: F.col(c) for c in texts}
    others = [c for c in out.columns if c not in texts and (c in META_COLUMNS or c in source_cols) and c != "source"]
    order = [c for c in out.columns if c != "source"]
    head = [] if drop_empty else [empty.alias("empty_row")]
    raw_texts = [(fold_na_value(F.col(c)) if fold_na else F.col(c)).alias(c + "_raw") for c in keep_text]
    out = computed_once(out, [*head, *others, *raw_texts], clean)
    cols = [] if drop_empty else [F.col("empty_row")]
    for c in order:
        if c in META_COLUMNS:
            cols.append(F.col(c))
            continue
        x = F.col(c)
        typed = c == "side" or c in DATE_COLUMNS or c in NUMERIC_COLUMNS
        if c not in texts and typed:  # another type is its own text, as before
            x = strip(x.cast("string"))
        if c == "side":
            x = normalise_side(x, stripped=True)
        elif c in DATE_COLUMNS:
            if keep_raw_dates:
                cols.append(F.col(c + "_raw" if c in keep_text else c).alias(c + "_raw"))
            x = parse_date(x, date_format.get(c) if isinstance(date_format, dict) else date_format, stripped=True)
        elif c in NUMERIC_COLUMNS:
            x = parse_number(x, stripped=True)
        cols.append(x.alias(c))
    cols.append(F.lit(source_name).alias("source"))
    return out.select(*cols)


def to_contract(df: DataFrame) -> DataFrame:
    """The contract fields (missing optional fields as NULL), extras dropped."""
    from tradetally.schemas import TRADE_SCHEMA
    cols = []
    for f in TRADE_SCHEMA.fields:
        cols.append(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in ("ingest_seq",) if c in df.columns]
    return df.select(*cols, *extra)


__all__ = ["canonical_name", "normalise_columns", "fold_na_tokens", "normalise_side_column",
           "normalise_dates", "date_failures", "normalise_numerics", "add_source",
           "trim_strings", "drop_empty_rows", "check_required_columns", "normalise",
           "to_contract", "TRADE_COLUMNS"]
