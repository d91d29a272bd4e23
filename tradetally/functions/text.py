"""String column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradetally.schemas import NA_TOKENS, SIDE_MAP, WHITE_SPACE


def fold_na(c: Column, tokens: list[str] = NA_TOKENS) -> Column:
    """The reader's missing-value tokens become NULL (exact match, before trim)."""
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def _bare(c: Column) -> Column:
    """Cheap proof that there is nothing to strip: the first and the last byte
    are printable ASCII (strings compare byte by byte). The last one is taken from
    the bytes, as a string's characters are counted to find it."""
    last = F.substring(c.cast("binary"), -1, 1)
    return (c >= "!") & (c < "\x7f") & (last >= F.lit(b"!")) & (last < F.lit(b"\x7f"))


def strip(c: Column) -> Column:
    """Strip white space of any kind from both ends. ``c`` is named several
    times, so it should be a column, not a long expression."""
    return F.when(_bare(c), c).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def fold_strip(c: Column, tokens: list[str] = NA_TOKENS) -> Column:
    """S8 and P7 of a raw column at once: NULL for a missing-value token, else stripped."""
    return F.when(~c.isin(*tokens), strip(c))


def upper_trim(c: Column) -> Column:
    """Trimmed upper-case form (ticker, isin, side)."""
    return F.upper(strip(c))


def normalise_side(c: Column, stripped: bool = False) -> Column:
    """Trim + upper, then B/1 -> BUY and S/-1 -> SELL; other values stay.

    One map lookup, so the input expression is referenced twice, not once per code."""
    u = F.upper(c) if stripped else upper_trim(c)
    m = F.create_map(*[F.lit(x) for kv in SIDE_MAP.items() for x in kv])
    return F.coalesce(F.try_element_at(m, u), u)
