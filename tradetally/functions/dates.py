"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradetally.functions.text import strip

# strptime directive -> Spark datetime pattern letters
_STRPTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%%": "%",
}

# patterns tried in turn when no format is given (month-first, as the
# reference's default inference)
INFER_PATTERNS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd",
                  "MM/dd/yyyy", "yyyyMMdd", "dd-MMM-yyyy"]


def to_spark_pattern(fmt: str) -> str:
    """Accepts a strptime format (``%Y-%m-%d``) or a Spark pattern as is."""
    if "%" not in fmt:
        return fmt
    out, i = [], 0
    while i < len(fmt):
        two = fmt[i:i + 2]
        if two in _STRPTIME:
            out.append(_STRPTIME[two])
            i += 2
            continue
        ch = fmt[i]
        out.append(f"'{ch}'" if ch.isalpha() else ch)
        i += 1
    return "".join(out)


#: Texts of the layout yyyy-MM-dd that a cast reads as the formatter does (which knows no year 0).
_PLAIN = r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}\z"


def parse_date(c: Column, fmt: str | None = None, stripped: bool = False) -> Column:
    """text -> date by the given format, or the first inference pattern that fits.
    Texts of the plain layout are cast, at a fraction of what a formatter costs; the
    text is then named three times, so only ``stripped`` ones, which are columns, are."""
    t = c if stripped else strip(c)
    if fmt:
        pattern = to_spark_pattern(fmt)
        parsed = F.try_to_date(t, pattern)
        if stripped and pattern == "yyyy-MM-dd":
            return F.when(t.rlike(_PLAIN), t.try_cast("date")).otherwise(parsed)
        return parsed
    return F.coalesce(*[F.try_to_date(t, p) for p in INFER_PATTERNS])


def add_business_days(d: Column, n: int | Column) -> Column:
    """date plus ``n`` weekdays (weekends only, no holiday calendar).

    Closed form: a weekend start moves back to its Friday, then every full
    or partial week crossed adds two weekend days. ``n = 0`` keeps the date.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    w = (F.dayofweek(d) + 5) % 7                 # Monday = 0 ... Sunday = 6
    back = F.when(w == 5, 1).when(w == 6, 2).otherwise(0)
    start = F.date_sub(d, back)
    ws = F.least(w, F.lit(4))
    moved = F.date_add(start, (n + F.floor((ws + n) / 5) * 2).cast("int"))
    return F.when(n == 0, d).otherwise(moved)
