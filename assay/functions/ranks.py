"""Exact quantiles of large columns.

Spark's exact percentile keeps every different value of a column in one task. Here a quantile's neighbours are found by
rank, in rounds: a sketch of the values that are left proposes two pivots around each rank, an aggregation counts what is
below, at and between pivots, and the rank's own interval is all that the next round looks at. Pivots only steer; what an
interval holds is counted. An interval of few values is collected with their counts. So no task and no window ever gets the
values of a column, the intervals shrink a thousandfold a round, and ties end a search at once.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of an interval that are collected.
FEW = 4096


def exact_quantiles(df: DataFrame, values: list[Column], shares: list[float], margin: float = 0.0005, accuracy: int = 10_000, few: int = FEW) -> list[list[float | None]]:
    """For each value, its quantiles at shares, linear between neighbours; None without values. Nulls don't count, so NaN
    must be null. What the driver gets follows the number of values and shares alone."""
    if not values:
        return []
    own = df.select(*(v.cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    ends = [x for s in shares for x in (max(0.0, s - margin), min(1.0, s + margin))]
    seen = own.agg(*(F.count(f"v{i}").alias(f"n{i}") for i in range(len(values))), *(F.percentile_approx(f"v{i}", ends, accuracy).alias(f"e{i}") for i in range(len(values)))).first()
    sizes = [seen[f"n{i}"] for i in range(len(values))]
    places = [[s * (n - 1) for s in shares] for n in sizes]
    ranks = [sorted({r for at in own_places for r in (math.floor(at), min(n - 1, math.floor(at) + 1))}) if n else [] for own_places, n in zip(places, sizes, strict=True)]
    found = ranked_values(own, ranks, [sorted(set(seen[f"e{i}"] or [])) for i in range(len(values))], margin, accuracy, few)
    out: list[list[float | None]] = []
    for i, n in enumerate(sizes):
        each: list[float | None] = []
        for at in places[i] if n else []:
            one, two = found[i, math.floor(at)], found[i, min(n - 1, math.floor(at) + 1)]
            each.append(one if one == two else (math.floor(at) + 1 - at) * one + (at - math.floor(at)) * two)
        out.append(each if n else [None] * len(shares))
    return out


def ranked_values(own: DataFrame, ranks: list[list[int]], pivots: list[list[float]], margin: float, accuracy: int, few: int) -> dict[tuple[int, int], float]:
    """The values at ranks (from 0) of each column v0, v1, ..."""
    found: dict[tuple[int, int], float] = {}
    # What is looked at: (column, low, high, values at or below low), ends exclusive; and the ranks and pivots within.
    open_: list[tuple[tuple[int, float, float, int], list[int], list[float]]] = [((i, -math.inf, math.inf, 0), r, p) for i, (r, p) in enumerate(zip(ranks, pivots, strict=True)) if r]
    while open_:
        counts: dict[tuple[int, int], int] = {}
        for r in placed(own, [(span, p) for span, _, p in open_]).groupBy("k", "code").agg(F.count("*").alias("n")).collect():  # at most two for each pivot, and one
            counts[r.k, r.code] = r.n
        small, large = [], []
        for k, ((i, low, high, below), wanted, own_pivots) in enumerate(open_):
            before, total = [], below
            for code in range(2 * len(own_pivots) + 1):
                before.append(total)
                total += counts.get((k, code), 0)
            inner: dict[int, list[int]] = {}
            for rank in wanted:
                code = bisect_right(before, rank) - 1
                while not counts.get((k, code)):  # of codes without values the one before counts
                    code -= 1
                if code % 2:
                    found[i, rank] = own_pivots[code // 2]
                else:
                    inner.setdefault(code, []).append(rank)
            for code, some in inner.items():
                left = own_pivots[code // 2 - 1] if code else low
                right = own_pivots[code // 2] if code // 2 < len(own_pivots) else high
                (small if counts[k, code] <= few else large).append(((i, left, right, before[code]), some, counts[k, code]))
        if small:
            held: dict[int, list[tuple[float, int]]] = {}
            for r in placed(own, [(span, []) for span, _, _ in small]).groupBy("k", "x").agg(F.count("*").alias("n")).collect():  # at most few for each
                held.setdefault(r.k, []).append((r.x, r.n))
            for k, ((i, _, _, below), some, _) in enumerate(small):
                total = below
                for x, n in sorted(held[k]):
                    found.update({(i, rank): x for rank in some if total <= rank < total + n})
                    total += n
        if not large:
            break
        asked = [sorted({e for rank in some for e in (max(0.0, (rank - span[3]) / n - margin), min(1.0, (rank + 1 - span[3]) / n + margin))}) for span, some, n in large]
        picked = {}
        for r in placed(own, [(span, []) for span, _, _ in large]).groupBy("k").agg(F.percentile_approx("x", [q / 1000 for q in range(1001)], accuracy).alias("grid")).collect():
            grid = r.grid
            picked[r.k] = sorted({x for e in asked[r.k] for x in (grid[math.floor(e * 1000)], grid[math.ceil(e * 1000)])})
        open_ = [(span, some, picked[k]) for k, (span, some, _) in enumerate(large)]
    return found


def placed(own: DataFrame, spans: list[tuple[tuple[int, float, float, int], list[float]]]) -> DataFrame:
    """(k, code, x) of the values within each span k: code 0 below the first pivot, 1 at it, 2 between it and the next, ...
    A column is read by itself, and its rows are not multiplied: spans of a column don't overlap."""
    by_column: dict[int, list] = {}
    for k, ((i, low, high, _), pivots) in enumerate(spans):
        x = F.col(f"v{i}")
        within = x.isNotNull()
        if low > -math.inf:
            within &= x > low
        if high < math.inf:
            within &= x < high
        code = sum(((x >= p).cast("int") + (x > p).cast("int") for p in pivots), F.lit(0))
        by_column.setdefault(i, []).append((within, F.lit(k), code))
    rows = []
    for i, some in by_column.items():
        k, code = (reduce(lambda case, s, n=n: case.when(s[0], s[n]), some[1:], F.when(some[0][0], some[0][n])) for n in (1, 2))
        rows.append(own.select(k.alias("k"), code.alias("code"), F.col(f"v{i}").alias("x")).where("k is not null"))
    return reduce(DataFrame.union, rows)


def literals(found: list[float | None]) -> Column:
    """Quantiles as an array of doubles."""
    return F.array(*(F.lit(x).cast("double") for x in found))
