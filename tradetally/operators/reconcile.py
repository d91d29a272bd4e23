"""Full reconciliation (C10) as one plan.

Per side one aggregate by ``trade_id`` both counts copies (DUPLICATE) and keeps
the first copy (keep-first). Partial aggregation runs before the exchange, so a
hot id costs one row per map task; so do rows without a usable id, which stay in
the pair frame only to be counted as excluded.
The two aggregates meet in a single full outer sort-merge join that reuses
both hash partitionings; only pairs with a break are spread into one row each break.

Exchanges in the plan: one per side (plus one single-row exchange for a
global summary).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tradetally.operators.compare import (BREAK_FIELDS, Checks, Tolerances, dates_differ, days_apart,
                                          norm_side, num_differs, side_differs)
from tradetally.operators.dedupe import KEY, collapse, usable_key

_CMP = ["side", "quantity", "price", "settlement_date"]


def payload_for(checks: "Checks", detail: bool) -> list[str]:
    """Columns carried through the per-side aggregate: only what the enabled
    checks compare, plus the MISSING detail (ticker) when breaks are built."""
    cols = list(_CMP)
    if checks.consideration:
        cols.append("consideration")
    if detail:
        cols.append("ticker")
    return cols


def _side(df: DataFrame, order_by: Sequence[str], suffix: str, payload: Sequence[str]) -> DataFrame:
    payload = [c for c in payload if c in df.columns]
    c = collapse(df, order_by, KEY, payload=payload, count_col="n")
    return c.select(KEY, *[F.col(x).alias(x + suffix) for x in ["n"] + payload])


def pair_frame(a: DataFrame, b: DataFrame, order_by: Sequence[str] = ("ingest_seq",),
               order_by_b: Sequence[str] | None = None,
               payload: Sequence[str] = tuple(_CMP) + ("ticker",)) -> DataFrame:
    """Deduplicated sides joined full-outer on ``trade_id``: one row per id.
    Rows of unusable (null or blank) ids are groups of their own."""
    sa = _side(a, order_by, "_a", payload)
    sb = _side(b, order_by_b or order_by, "_b", payload)
    return sa.join(sb, KEY, "full_outer")


@dataclass
class Flags:
    usable: Column
    present_a: Column
    present_b: Column
    dup_a: Column
    dup_b: Column
    missing_in_b: Column
    missing_in_a: Column
    side: Column
    qty: Column
    price: Column
    settle: Column
    consideration: Column
    field_break: Column
    clean: Column
    #: By name of kind, for pairs whose id is known to be usable.
    of_usable: dict[str, Column]


def flags(cols: Sequence[str], tol: Tolerances, checks: Checks) -> Flags:
    has = set(cols)
    off = F.lit(False)
    usable = usable_key()
    in_a, in_b = F.col("n_a").isNotNull(), F.col("n_b").isNotNull()

    def on(name: str, enabled: bool, cond) -> Column:
        return (in_a & in_b & cond()) if enabled and {name + "_a", name + "_b"} <= has else off

    of = {"duplicate_a": F.coalesce(F.col("n_a") > 1, off), "duplicate_b": F.coalesce(F.col("n_b") > 1, off),
          "missing_in_b": in_a & ~in_b, "missing_in_a": ~in_a & in_b,
          "side_break": on("side", checks.side, lambda: side_differs(F.col("side_a"), F.col("side_b"))),
          "qty_break": on("quantity", checks.quantity,
                          lambda: num_differs(F.col("quantity_a"), F.col("quantity_b"), tol.quantity)),
          "price_break": on("price", checks.price,
                            lambda: num_differs(F.col("price_a"), F.col("price_b"), tol.price)),
          "settle_break": on("settlement_date", checks.settlement,
                             lambda: dates_differ(F.col("settlement_date_a"), F.col("settlement_date_b"),
                                                  tol.settlement_days)),
          "consideration_break": on("consideration", checks.consideration,
                                    lambda: num_differs(F.col("consideration_a"), F.col("consideration_b"),
                                                        tol.consideration))}
    known = {n: usable & c for n, c in of.items()}
    pa, pb = usable & in_a, usable & in_b
    fb = reduce(or_, (known[n] for n in ("side_break", "qty_break", "price_break", "settle_break", "consideration_break")))
    return Flags(usable, pa, pb, *known.values(), fb, pa & pb & ~fb, of)


def _opt(cols: set, name: str) -> Column | None:
    return F.col(name) if name in cols else None


#: The kinds of breaks in emission order: (name of the flag and of its count, break type).
KINDS = (("duplicate_a", "DUPLICATE"), ("duplicate_b", "DUPLICATE"), ("missing_in_b", "MISSING"),
         ("missing_in_a", "MISSING"), ("side_break", "SIDE_BREAK"), ("qty_break", "QTY_BREAK"),
         ("price_break", "PRICE_BREAK"), ("settle_break", "SETTLE_BREAK"),
         ("consideration_break", "CONSIDERATION_BREAK"))


def kinds_of(checks: Checks) -> list[tuple[str, str]]:
    """The kinds that a configuration reports: consideration only if checked."""
    return [k for k in KINDS if checks.consideration or k[1] != "CONSIDERATION_BREAK"]


def by_type(checks: Checks) -> dict[str, list[str]]:
    """Count names of each break type."""
    out: dict[str, list[str]] = {}
    for name, kind in kinds_of(checks):
        out.setdefault(kind, []).append(name)
    return out


def flag_of(fl: Flags) -> dict[str, Column]:
    return {"duplicate_a": fl.dup_a, "duplicate_b": fl.dup_b, "missing_in_b": fl.missing_in_b,
            "missing_in_a": fl.missing_in_a, "side_break": fl.side, "qty_break": fl.qty, "price_break": fl.price,
            "settle_break": fl.settle, "consideration_break": fl.consideration}


def break_values(cols: Sequence[str], checks: Checks) -> list[dict]:
    """The fields that a break of each kind fills, in emission order."""
    has = set(cols)
    sev = checks.severity
    g = lambda n: _opt(has, n)
    both = lambda x, y: x in has and y in has
    values = [
        dict(step=1, severity=sev["DUPLICATE"], source=F.lit("source_a"), occurrences=F.col("n_a")),
        dict(step=2, severity=sev["DUPLICATE"], source=F.lit("source_b"), occurrences=F.col("n_b")),
        dict(step=3, severity=sev["MISSING"], source=F.lit("source_a"), ticker=g("ticker_a"),
             a_str=g("side_a"), a_num=g("quantity_a"), unit_price=g("price_a")),
        dict(step=4, severity=sev["MISSING"], source=F.lit("source_b"), ticker=g("ticker_b"),
             b_str=g("side_b"), b_num=g("quantity_b"), unit_price=g("price_b")),
        dict(step=5, severity=sev["SIDE_BREAK"],
             a_str=norm_side(F.col("side_a")) if "side_a" in has else None,
             b_str=norm_side(F.col("side_b")) if "side_b" in has else None),
        dict(step=5, severity=sev["QTY_BREAK"], a_num=g("quantity_a"), b_num=g("quantity_b"),
             diff_num=(F.col("quantity_a") - F.col("quantity_b"))
             if both("quantity_a", "quantity_b") else None),
        dict(step=5, severity=sev["PRICE_BREAK"], a_num=g("price_a"), b_num=g("price_b"),
             diff_num=(F.col("price_a") - F.col("price_b")) if both("price_a", "price_b") else None),
        dict(step=5, severity=sev["SETTLE_BREAK"], a_date=g("settlement_date_a"), b_date=g("settlement_date_b"),
             diff_days=days_apart(F.col("settlement_date_a"), F.col("settlement_date_b"))
             if both("settlement_date_a", "settlement_date_b") else None),
    ]
    if checks.consideration:
        values.append(dict(step=5, severity=sev.get("CONSIDERATION_BREAK", "MEDIUM"),
                           a_num=F.col("consideration_a"), b_num=F.col("consideration_b"),
                           diff_num=F.col("consideration_a") - F.col("consideration_b")))
    return values


def break_rows(pairs: DataFrame, fl: Flags, checks: Checks, kinds: Sequence[str] | None = None) -> DataFrame:
    """A row for every break of a pair (of the given types only), in emission
    order: a pair yields the numbers of its kinds, and each column is then filled by
    kind. With a struct of all columns for each kind the generated method is too
    long for the JVM to compile, and a whole run's pairs go through its interpreter."""
    on = [(i, fl.of_usable[n], t) for i, (n, t) in enumerate(kinds_of(checks)) if kinds is None or t in kinds]
    kind = F.col("_kind")
    if kinds is not None:
        flag = flag_of(fl)
        pairs = pairs.where(reduce(or_, (flag[n] for n, t in kinds_of(checks) if t in kinds)))
    found = (pairs.where(fl.usable)
             .select("*", F.explode(F.array(*[F.when(c, F.lit(i)) for i, c, _ in on])).alias("_kind"))
             .where(kind.isNotNull()))
    values = {i: dict(v, break_type=t) for i, (v, (_, t)) in
              enumerate(zip(break_values(pairs.columns, checks), kinds_of(checks), strict=True))}

    def column(name: str, typ: str) -> Column:
        out = None
        for i, _, _ in on:
            v = values[i].get(name)
            if v is not None:
                v = v if isinstance(v, Column) else F.lit(v)
                out = F.when(kind == i, v) if out is None else out.when(kind == i, v)
        return (F.lit(None) if out is None else out).cast(typ).alias(name)

    return found.select(KEY, *[column(n, t) for n, t in BREAK_FIELDS.items()])


def break_id(run_id: Column) -> Column:
    """deterministic id, stable across task retries and re-runs."""
    return F.sha2(F.concat_ws("|", run_id, F.col("step").cast("string"), F.col("source"),
                              F.col("break_type"), F.col(KEY)), 256)


@dataclass
class Reconciliation:
    pairs: DataFrame
    flags: Flags
    checks: Checks
    run_id: str

    def breaks(self, ordered: bool = False, kinds: Sequence[str] | None = None) -> DataFrame:
        """One row per break (typed columns, see ``BREAK_SCHEMA``). ``kinds``
        builds breaks of these types only, from the pairs that have any. ``ordered``
        returns them in emission order (O7): duplicates of A, of B, missing in
        B, missing in A, then field breaks; ids ascending within a step and the
        field breaks of one pair in side, quantity, price, settlement order."""
        exploded = break_rows(self.pairs, self.flags, self.checks, kinds)
        rid = F.lit(self.run_id)
        out = exploded.select(break_id(rid).alias("break_id"), rid.alias("run_id"), "step", KEY,
                              "break_type", "severity", "source", "occurrences", "ticker",
                              "unit_price", "a_str", "b_str", "a_num", "b_num", "diff_num",
                              "a_date", "b_date", "diff_days")
        if not ordered:
            return out
        kind_rank = F.array_position(F.array(*[F.lit(t) for t in by_type(self.checks)]), F.col("break_type"))
        return out.orderBy("step", KEY, kind_rank)

    def count_columns(self) -> list[Column]:
        fl = self.flags
        ci = lambda c: F.count_if(c).cast("bigint")
        flag = flag_of(fl)

        def rows(n: str, which: Column) -> Column:
            return F.coalesce(F.sum(F.when(which, F.col(n))), F.lit(0)).cast("bigint")

        return [ci(fl.clean).alias("clean"), *[ci(flag[n]).alias(n) for n, _ in kinds_of(self.checks)],
                ci(fl.present_a & fl.present_b).alias("matched_ids"),
                rows("n_a", fl.usable).alias("source_a_rows"), rows("n_b", fl.usable).alias("source_b_rows"),
                rows("n_a", ~fl.usable).alias("excluded_a_rows"), rows("n_b", ~fl.usable).alias("excluded_b_rows")]

    def counts(self) -> DataFrame:
        """One row of counts (single partial + final aggregate)."""
        return self.pairs.agg(*self.count_columns())

    def summary(self) -> DataFrame:
        """A3 + A4: (break_type, n) rows, CLEAN included (pairs without field breaks)."""
        kinds = {"CLEAN": ["clean"]} | by_type(self.checks)
        rows = ", ".join(f"'{t}', {' + '.join(names)}" for t, names in kinds.items())
        return self.counts().select(F.expr(f"stack({len(kinds)}, {rows}) AS (break_type, n)"))

    def type_counts(self) -> DataFrame:
        """(break_type, n) of the types that occur, from the counts."""
        return self.summary().where("break_type <> 'CLEAN' AND n > 0")

    def severity_counts(self) -> DataFrame:
        """A2: (severity, n) of the severities that occur, from the counts."""
        sev = self.checks.severity
        level = F.create_map(*[F.lit(x) for t in by_type(self.checks) for x in (t, sev.get(t, "MEDIUM"))])
        return (self.type_counts().groupBy(F.element_at(level, F.col("break_type")).alias("severity"))
                .agg(F.sum("n").cast("bigint").alias("n")))

    def totals(self, level: str | None = None) -> str:
        """SQL of the number of breaks (of a severity) from the count columns."""
        sev = self.checks.severity
        names = [n for t, ns in by_type(self.checks).items() if level is None or sev.get(t, "MEDIUM") == level for n in ns]
        return f"CAST({' + '.join(names) or '0'} AS BIGINT)"

    def run_row(self) -> DataFrame:
        """A6 from one pass over the pairs: totals per severity derived from the
        per-type counts through the severity map, plus source and match counts."""
        return self.counts().select(
            F.lit(self.run_id).alias("run_id"), F.expr(self.totals()).alias("total_breaks"),
            *[F.expr(self.totals(s)).alias(f"{s.lower()}_breaks") for s in ("CRITICAL", "HIGH", "MEDIUM")],
            F.col("source_a_rows").alias("source_a_count"), F.col("source_b_rows").alias("source_b_count"),
            F.col("clean").alias("matched_count"), "excluded_a_rows", "excluded_b_rows")

    def escalation(self, break_count_threshold: int = 10, consideration_threshold: float = 100000.0,
                   always_escalate_critical: bool = True) -> DataFrame:
        """D4 in one aggregate over the pairs: a pair with any break is one
        broken trade; its consideration at risk is A's, or B's when A lacks the
        trade (exact to six decimals). Needs ``consideration`` in the pair payload."""
        fl = self.flags
        any_break = fl.dup_a | fl.dup_b | fl.missing_in_b | fl.missing_in_a | fl.field_break
        cons = F.coalesce(F.col("consideration_a"), F.col("consideration_b")).cast("decimal(28,6)")
        c = self.pairs.agg(*self.count_columns(),
                           F.coalesce(F.sum(F.when(any_break, cons)), F.lit(0)).cast("double")
                           .alias("consideration_at_risk"))
        r = c.select(F.lit(self.run_id).alias("run_id"), F.expr(self.totals()).alias("total_breaks"),
                     F.expr(self.totals("CRITICAL")).alias("critical_breaks"), "consideration_at_risk")
        count_hit = F.col("total_breaks") > break_count_threshold
        risk_hit = F.col("consideration_at_risk") > consideration_threshold
        crit_hit = (F.col("critical_breaks") > 0) & F.lit(always_escalate_critical)
        reasons = F.concat_ws(", ", F.when(count_hit, F.lit("break_count")),
                              F.when(risk_hit, F.lit("consideration")),
                              F.when(crit_hit, F.lit("critical")))
        return r.select("*", (count_hit | risk_hit | crit_hit).alias("escalate"), reasons.alias("reasons"))

    def observed_breaks(self, name: str = "recon") -> tuple[DataFrame, Observation]:
        """Breaks frame that also gathers the counts while it is written: one
        job yields both (result-stage metrics are applied once per partition)."""
        obs = Observation(name)
        observed = Reconciliation(self.pairs.observe(obs, *self.count_columns()),
                                  self.flags, self.checks, self.run_id)
        return observed.breaks(), obs


def reconcile(a: DataFrame, b: DataFrame, order_by: Sequence[str] = ("ingest_seq",),
              run_id: str = "run", tolerances: Tolerances | dict | None = None,
              checks: Checks | None = None, order_by_b: Sequence[str] | None = None,
              pairs: DataFrame | None = None, detail: bool = True) -> Reconciliation:
    """C10. ``order_by`` fixes the surviving copy of a duplicated id (file order
    by default). ``pairs`` may be a pre-built pair frame (e.g. enriched with
    per-row tolerance columns). ``detail=False`` drops the MISSING detail
    columns when only counts are wanted."""
    tol = tolerances if isinstance(tolerances, Tolerances) else Tolerances.from_config(tolerances)
    checks = checks or Checks()
    p = pairs if pairs is not None else pair_frame(a, b, order_by, order_by_b,
                                                   payload_for(checks, detail))
    return Reconciliation(p, flags(p.columns, tol, checks), checks, run_id)
