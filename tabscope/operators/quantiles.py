"""Exact discrete quartiles (SQL ``percentile_disc``) by narrowing brackets.

A fine quantile sketch (KLL) of the first pass gives each quartile an open bracket
of two values.  One scan counts, for all brackets, the rows below, on and inside
their ends; that settles quartiles which are an end, and shows how many rows are
strictly inside.  Brackets of many rows are narrowed by another sketch over the rows
inside (a factor of thousands each time); of the others the inside rows are
grouped by value and ranked.  If a sketch missed, the counts show it and the bracket starts
again from the column's extremes, so the result is exact in any case.  NaN is no value here.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import sql_double
from ..functions.families import ColumnSpec
from ..functions.patterns_fixed import IQR_FENCE
from .scan import SKETCH, FusedScan, at_once, in_groups, reads_columns_apart

ACCURACY = 10_000
#: Rows inside a bracket that are ranked rather than narrowed.
RANK_ROWS = 1 << 20
#: Half-width, in rank, of the brackets that a sketch gives: twice what it promises.
_HALF = 2.0 / ACCURACY
#: Size of the first pass's sketch, whose error in rank is below 0.0002 in 99 of 100 cases, and half-width of its brackets.
KLL_K, _KLL_HALF = 1 << 14, 4e-4
#: Brackets of a scan, where columns can be read apart: to count, and to rank or narrow.
COUNTED, RANKED = 22, 16
QUARTILES = (0.25, 0.75)


def add_bracket_aggs(scan: FusedScan, spec: ColumnSpec) -> None:
    v = spec.sql_number
    ps = ", ".join(sql_double(p + d) for p in QUARTILES for d in (-_KLL_HALF, _KLL_HALF))
    scan.add(spec, "qn", f"count({v})")
    sketch = f"kll_sketch_agg_double({v}, {KLL_K})"
    scan.add(spec, "qb", f"CASE WHEN count({v}) > 0 THEN kll_sketch_get_quantile_double({sketch}, array({ps})) END", SKETCH)


@dataclass
class _Bracket:
    spec: ColumnSpec
    which: int
    rank: int  # of the quartile among the column's values, from 1
    lo: float
    hi: float
    below: int = 0
    inside: int = 0

    @property
    def test(self) -> str:
        v = self.spec.sql_number
        return f"({v} > {sql_double(self.lo)} AND {v} < {sql_double(self.hi)})"


def exact_quartiles(df: DataFrame, specs: list[ColumnSpec], scan: FusedScan) -> dict[int, tuple[float, float]]:
    """{ordinal: (q1, q3)} of the columns that have a value; ``scan`` holds :func:`add_bracket_aggs`."""
    found: dict[tuple[int, int], float] = {}
    open_: list[_Bracket] = []
    apart = reads_columns_apart(df)
    for s in specs:
        n, b = scan.get(s, "qn"), scan.get(s, "qb")
        if n:
            open_ += [_Bracket(s, k, max(1, math.ceil(p * n)), b[2 * k], b[2 * k + 1]) for k, p in enumerate(QUARTILES)]
    while open_:
        counts = _counts(df, open_, apart)
        rank, narrow, again = [], [], []
        for i, b in enumerate(open_):
            below, on_lo, inside, on_hi = counts[i]
            on_hi = on_hi if b.hi > b.lo else 0
            key = (b.spec.ordinal, b.which)
            if not below < b.rank <= below + on_lo + inside + on_hi:
                again.append(b)
            elif b.rank <= below + on_lo:
                found[key] = b.lo
            elif b.rank > below + on_lo + inside:
                found[key] = b.hi
            else:
                b.below, b.inside = below + on_lo, inside
                (rank if inside <= RANK_ROWS else narrow).append(b)
        if again:
            _widen(df, again, apart)
        if rank:
            found.update(_ranked(df, rank, apart))
        if narrow:
            _narrow(df, narrow, apart)
        open_ = again + narrow
    return {o: (found[o, 0], found[o, 1]) for o, which in found if not which}


def _groups(brackets: list[_Bracket], apart: bool, most: int) -> list[list[tuple[int, _Bracket]]]:
    """Numbered brackets, those of a scan together."""
    numbered = list(enumerate(brackets))
    return in_groups(numbered, most) if apart else [numbered]


def _counts(df: DataFrame, brackets: list[_Bracket], apart: bool) -> dict[int, tuple[int, int, int, int]]:
    """By bracket: the rows below its lower end, on it, inside and on the upper end."""
    def run(group: list[tuple[int, _Bracket]]) -> dict[int, tuple[int, int, int, int]]:
        row = df.selectExpr(*[e for i, b in group for e in (
            f"count_if({b.spec.sql_number} < {sql_double(b.lo)}) AS b{i}", f"count_if({b.spec.sql_number} = {sql_double(b.lo)}) AS l{i}",
            f"count_if({b.test}) AS i{i}", f"count_if({b.spec.sql_number} = {sql_double(b.hi)}) AS h{i}")]).first()
        return {i: (row[f"b{i}"], row[f"l{i}"], row[f"i{i}"], row[f"h{i}"]) for i, _ in group}

    return {i: n for part in at_once(run, _groups(brackets, apart, COUNTED)) for i, n in part.items()}


def _widen(df: DataFrame, brackets: list[_Bracket], apart: bool) -> None:
    """Sets the ends of brackets that a sketch missed to the column's extremes."""
    def run(group: list[tuple[int, _Bracket]]) -> None:
        row = df.selectExpr(*[f"{f}({b.spec.sql_number}) AS {f}{i}" for i, b in group for f in ("min", "max")]).first()
        for i, b in group:
            b.lo, b.hi = row[f"min{i}"], row[f"max{i}"]

    at_once(run, _groups(brackets, apart, COUNTED))


def _narrow(df: DataFrame, brackets: list[_Bracket], apart: bool) -> None:
    """Sets the brackets' ends by sketches of the rows inside."""
    def run(group: list[tuple[int, _Bracket]]) -> None:
        row = df.selectExpr(*[
            f"percentile_approx(CASE WHEN {b.test} THEN {b.spec.sql_number} END, array("
            + ", ".join(sql_double(min(1.0, max(0.0, (b.rank - b.below) / b.inside + d))) for d in (-_HALF, _HALF)) + f"), {ACCURACY}) AS q{i}"
            for i, b in group]).first()
        for i, b in group:
            b.lo, b.hi = row[f"q{i}"]

    at_once(run, _groups(brackets, apart, RANKED))


def _ranked(df: DataFrame, brackets: list[_Bracket], apart: bool) -> dict[tuple[int, int], float]:
    """The quartiles of brackets with few rows inside, by grouping and ranking those.
    Rows inside no bracket, nearly all of them, are left out before there is a row for each bracket."""
    def run(group: list[tuple[int, _Bracket]]) -> list:
        rows = ", ".join(f"named_struct('k', {i}, 'v', CASE WHEN {b.test} THEN {b.spec.sql_number} END, 'want', {b.rank - b.below}L)" for i, b in group)
        near = df.where(" OR ".join(b.test for _, b in group))
        values = near.selectExpr(f"inline(array({rows}))").where("v IS NOT NULL").groupBy("k", "want", "v").agg(F.count("*").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        return values.withColumn("upto", so_far).where("upto >= want AND upto - n < want").select("k", "v").collect()

    hits = [r for part in at_once(run, _groups(brackets, apart, RANKED)) for r in part]
    return {(brackets[r.k].spec.ordinal, brackets[r.k].which): r.v for r in hits}


def fence(q1: float, q3: float) -> tuple[float, float]:
    """IQR fence from quartiles."""
    iqr = q3 - q1
    return q1 - IQR_FENCE * iqr, q3 + IQR_FENCE * iqr
