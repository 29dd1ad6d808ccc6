"""Exact quantiles without one reducer.

The value of a rank is found by narrowing a bracket of values that holds it. A
pass over the rows takes two pivots near the rank in the bracket from a sketch;
the next counts the values below, at, between and above them, which tells
exactly where the rank lies, whatever the sketch's error. Every pass leaves out
a pivot at least, and about one value in five thousand of a bracket stays. When
a bracket holds few values they are counted by value and fetched. All columns
and shares narrow in the same passes; what a task holds is a sketch and some
counters for each.

NULL and NaN don't count. A quantile between two values is interpolated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 20_000  # values of a bracket that are fetched
ACCURACY = 10_000  # of the sketch


@dataclass
class Bracket:
    """Values from ``least`` to ``most``, among which the value of ``rank`` (from 0) is; ``before`` values are smaller."""

    column: str
    rank: int
    least: float
    most: float
    before: int
    inside: int

    def holds(self, x: Column) -> Column:
        return (x >= self.least) & (x <= self.most)


def _value(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _narrowed(df: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """The brackets after one step."""
    wide = 3 / ACCURACY
    sketches = []
    for n, b in enumerate(brackets):
        share = (b.rank - b.before) / b.inside
        pivots = F.array(F.lit(max(0.0, share - wide)), F.lit(min(1.0, share + wide)))
        sketches.append(F.percentile_approx(F.when(b.holds(_value(b.column)), _value(b.column)), pivots, ACCURACY).alias(f"s{n}"))
    pivots = df.agg(*sketches).first()
    counts = []
    for n, (b, (low, high)) in enumerate(zip(brackets, pivots)):
        x = _value(b.column)
        between = (x > low) & (x < high)
        counts += [
            F.count_if(x < low).alias(f"below{n}"), F.count_if(x == low).alias(f"low{n}"), F.count_if(between).alias(f"between{n}"), F.count_if(x == high).alias(f"high{n}"),
            F.max(F.when(b.holds(x) & (x < low), x)).alias(f"last{n}"), F.min(F.when(between, x)).alias(f"first{n}"),
            F.max(F.when(between, x)).alias(f"end{n}"), F.min(F.when(b.holds(x) & (x > high), x)).alias(f"next{n}"),
        ]
    row, out = df.agg(*counts).first().asDict(), []
    for n, (b, (low, high)) in enumerate(zip(brackets, pivots)):
        told = lambda name: row[f"{name}{n}"]  # noqa: B023, E731
        at = told("below")
        parts = [(b.least, told("last"), b.before, at - b.before), (low, low, at, told("low"))]
        if high > low:
            parts += [(told("first"), told("end"), at + told("low"), told("between")), (high, high, at + told("low") + told("between"), told("high"))]
        above = parts[-1][2] + parts[-1][3]
        parts.append((told("next"), b.most, above, b.before + b.inside - above))
        least, most, before, inside = next(p for p in parts if p[2] <= b.rank < p[2] + p[3])
        out.append(Bracket(b.column, b.rank, least, most, before, inside))
    return out


def ranked_values(df: DataFrame, ranks: list[tuple[str, int]], few: int = FEW) -> dict[tuple[str, int], float | None]:
    """The value at each (column, rank), ranks from 0; None where a column has fewer values."""
    columns = list(dict.fromkeys(c for c, _ in ranks))
    extremes = df.agg(*(f(_value(c)).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns) for f in (F.count, F.min, F.max))).first()
    of = {c: extremes[3 * i : 3 * i + 3] for i, c in enumerate(columns)}
    out: dict[tuple[str, int], float | None] = {(c, r): None for c, r in ranks}
    todo = [Bracket(c, r, of[c][1], of[c][2], 0, of[c][0]) for c, r in dict.fromkeys(ranks) if 0 <= r < of[c][0]]
    fetch: list[Bracket] = []
    while todo:
        for b in todo:
            if b.least == b.most:
                out[b.column, b.rank] = b.least
        fetch += [b for b in todo if b.least < b.most and b.inside <= few]
        todo = [b for b in todo if b.least < b.most and b.inside > few]
        todo = _narrowed(df, todo) if todo else []
    if fetch:
        met = F.array(*(F.when(b.holds(_value(b.column)), F.struct(F.lit(n).alias("n"), _value(b.column).alias("x"))) for n, b in enumerate(fetch)))
        values = df.select(F.explode(F.filter(met, lambda m: m.isNotNull())).alias("m")).groupBy("m.n", "m.x").count().collect()
        for n, b in enumerate(fetch):
            at = b.before
            for x, times in sorted((r.x, r["count"]) for r in values if r.n == n):
                at += times
                if b.rank < at:
                    out[b.column, b.rank] = x
                    break
    return out


def quantiles(df: DataFrame, columns: list[str], shares: list[float], few: int = FEW) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column; None for a column without values."""
    counts = df.agg(*(F.count(_value(c)) for c in columns)).first() if columns else []
    places = {c: [(n - 1) * s for s in shares] if n else [] for c, n in zip(columns, counts)}
    ranks = [(c, r) for c, at in places.items() for p in at for r in (math.floor(p), math.ceil(p))]
    found = ranked_values(df, ranks, few) if ranks else {}

    def between(c: str, p: float) -> float:
        low, high = math.floor(p), math.ceil(p)
        return found[c, low] if low == high else (high - p) * found[c, low] + (p - low) * found[c, high]

    return {c: [between(c, p) for p in places[c]] or [None] * len(shares) for c in columns}
