"""Numeric parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradetally.functions.text import strip

# plain decimal / scientific notation, as a pandas numeric coercion accepts;
# Spark's cast alone would also take '12d' or '1f', so the text is checked first
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c: Column, stripped: bool = False) -> Column:
    """P5: text -> double; unparseable text and NaN become NULL. The text is
    named once: what the pattern does not take comes out empty."""
    t = c if stripped else strip(c)
    return nan_to_null(F.regexp_extract(t, NUMBER_PATTERN, 0).try_cast("double"))


def nan_to_null(c: Column) -> Column:
    """F14 (``nanvl`` evaluates its input once)."""
    return F.nanvl(c, F.lit(None).cast("double"))


def derived_consideration(quantity: Column, price: Column, scale: int = 2) -> Column:
    """consideration = round(quantity * price, 2) (HALF_UP; Python rounds
    the binary value half-even, so exact ties may differ)."""
    return F.round(quantity * price, scale)
