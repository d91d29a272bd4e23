"""One date format a source (P4 without a given format).

A column is read in one format, never value by value: ``03/04`` beside
``13/04`` is a day first in both. One aggregate over the distinct date texts
counts what each known pattern reads and where two patterns of one shape read
the same text as different days; a pattern is elected from these counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradetally.functions.dates import INFER_PATTERNS, parse_date
from tradetally.functions.text import fold_na as fold_na_value
from tradetally.functions.text import strip

CANDIDATES = [*INFER_PATTERNS, "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "dd.MM.yyyy"]


class DateFormatError(ValueError):
    pass


def _shape(pattern: str) -> str:
    return re.sub("[A-Za-z]", "0", pattern)


def clashing(patterns: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of patterns that can read one text as two days."""
    return [(i, j) for i, j in combinations(range(len(patterns)), 2) if _shape(patterns[i]) == _shape(patterns[j])]


def date_counts(df: DataFrame, columns: Sequence[str], patterns: Sequence[str] = CANDIDATES,
                fold_na: bool = True) -> DataFrame:
    """A row a column: ``n`` values, ``fits_<i>`` values that pattern i reads,
    ``differs_<i>_<j>`` values that patterns i and j read as different days.
    Equal texts are counted first, so each is parsed once, after the shuffle."""
    def value(c: str) -> Column:
        return strip(fold_na_value(F.col(c)) if fold_na else F.col(c))

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("text")) for c in columns])
    texts = df.select(F.explode(pairs).alias("p")).select("p.*").where("text <> ''")
    texts = texts.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))
    days = texts.select("column", "n", *[parse_date(F.col("text"), p).alias(f"d{i}") for i, p in enumerate(patterns)])

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return days.groupBy("column").agg(
        F.sum("n").alias("n"), *[total(F.col(f"d{i}").isNotNull()).alias(f"fits_{i}") for i in range(len(patterns))],
        *[total(F.col(f"d{i}") != F.col(f"d{j}")).alias(f"differs_{i}_{j}") for i, j in clashing(patterns)])


def elect(df: DataFrame, columns: Sequence[str], patterns: Sequence[str] = CANDIDATES, fold_na: bool = True,
          whole: bool = True) -> dict[str, str]:
    """The pattern of each date column that has values.

    A column's candidates are the patterns that read all its values (with
    ``whole=False``: the most). Candidates that read every value alike are one.
    Where two differ, a column of the source that is sure decides; if none is,
    the column is ambiguous. No candidate, or an ambiguous column: ``DateFormatError``.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return {}
    rows = {r["column"]: r for r in date_counts(df, columns, patterns, fold_na).collect()}
    open_: dict[str, list[int]] = {}
    for c, r in rows.items():
        fits = [r[f"fits_{i}"] for i in range(len(patterns))]
        most = max(fits)
        if most == 0 or (whole and most < r["n"]):
            raise DateFormatError(f"date column {c!r}: no known format fits all {r['n']} values; "
                                  f"{patterns[fits.index(most)]} fits {most}")
        found = [i for i, n in enumerate(fits) if n == most]
        differ = {p for p in clashing(patterns) if r[f"differs_{p[0]}_{p[1]}"]}
        kept: list[int] = []
        for i in found:  # one of each set that reads all values alike
            if not any((k, i) not in differ and _shape(patterns[k]) == _shape(patterns[i]) for k in kept):
                kept.append(i)
        open_[c] = kept
    sure = {p for kept in open_.values() if len(kept) == 1 for p in kept}
    out = {}
    for c, kept in open_.items():
        left = [i for i in kept if i in sure] if len(kept) > 1 else kept
        if len(left) != 1:
            names = " or ".join(patterns[i] for i in kept)
            raise DateFormatError(f"date column {c!r} is ambiguous: {names}; name the format")
        out[c] = patterns[left[0]]
    return out
