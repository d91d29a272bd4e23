"""Per-pair field comparison (C1-C4, C7, C11) and the fields of a break.

Every condition is a plain Column over a joined pair frame with ``_a``/``_b``
suffixed columns; null-safe so that a missing value never fails a job and
never raises a break on its own except for the side check (see ``side_differs``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradetally.functions.text import upper_trim
from tradetally.schemas import DEFAULT_TOLERANCES, SEVERITY_BY_TYPE

Num = float | int | Column


def _lit(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@dataclass
class Tolerances:
    """Tolerances; any field may be a per-row Column (asset-class overrides)."""
    quantity: Num = 0.0
    price: Num = 0.01
    consideration: Num = 1.00
    settlement_days: Num = 0

    @classmethod
    def from_config(cls, cfg: dict | None) -> "Tolerances":
        """C11: missing keys fall back to the defaults."""
        d = dict(DEFAULT_TOLERANCES)
        d.update((cfg or {}).get("defaults", cfg or {}))
        return cls(quantity=float(d["quantity_tolerance"]),
                   price=float(d["price_tolerance"]),
                   consideration=float(d["consideration_tolerance"]),
                   settlement_days=int(d["settlement_date_tolerance_days"]))


@dataclass
class Checks:
    """Which comparisons run; absent columns switch a check off at plan time."""
    side: bool = True
    quantity: bool = True
    price: bool = True
    settlement: bool = True
    consideration: bool = False   # D3: declared in config, off by default
    severity: dict = field(default_factory=lambda: dict(SEVERITY_BY_TYPE))


def norm_side(c: Column) -> Column:
    return upper_trim(c)


def side_differs(sa: Column, sb: Column) -> Column:
    """Both non-empty after trim+upper, and different. A value on one side
    only is a break (the reference compares its text form); two nulls are not."""
    a, b = norm_side(sa), norm_side(sb)
    return (F.coalesce(a, F.lit("?")) != "") & (F.coalesce(b, F.lit("?")) != "") & ~a.eqNullSafe(b)


def num_differs(a: Column, b: Column, tol: Num) -> Column:
    """|a - b| > tol on doubles; a null on either side is no break."""
    return F.coalesce(F.abs(a - b) > _lit(tol), F.lit(False))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def dates_differ(a: Column, b: Column, tol: Num) -> Column:
    """C4: absolute calendar days > tol; a null on either side is no break."""
    return F.coalesce(days_apart(a, b) > _lit(tol), F.lit(False))


#: The typed slots of a break, null where a kind does not fill them.
BREAK_FIELDS = {
    "step": "int", "break_type": "string", "severity": "string",
    "source": "string", "occurrences": "bigint", "ticker": "string", "unit_price": "double",
    "a_str": "string", "b_str": "string", "a_num": "double", "b_num": "double",
    "diff_num": "double", "a_date": "date", "b_date": "date", "diff_days": "int",
}
