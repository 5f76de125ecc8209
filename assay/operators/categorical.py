"""Rare categories and dependence between categorical columns."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import as_rows, col, comparable
from assay.functions.storage import saved
from assay.operators.profile import frequencies, high_null, row_numbers

LEAST_SHARE, FLOOR, FEW, HIGH_RATIO, NULL_WARNING, EXAMPLES = 0.01, 0.001, 5, 0.8, 0.5, 5


def shares(df: DataFrame, names: list[str], adaptive: bool = True, least: float = LEAST_SHARE, most_ratio: float = HIGH_RATIO) -> DataFrame:
    """(column, value, n, n_present, share, threshold, rare) of columns few enough of whose values differ."""
    own = frequencies(df, names)
    totals = own.groupBy("column").agg(F.sum("n").alias("n_present"), F.count("*").alias("n_unique"))
    own = own.join(F.broadcast(totals.where(F.col("n_unique") <= most_ratio * F.col("n_present"))), "column")  # a row for each column
    limit = F.least(F.lit(least), F.greatest(F.lit(FLOOR), FEW / F.col("n_present"))) if adaptive else F.lit(least)
    own = own.withColumn("share", F.col("n") / F.col("n_present")).withColumn("threshold", limit)
    return own.select("column", "value", "n", "n_present", "share", "threshold", (F.col("share") < F.col("threshold")).alias("rare"))


def rare_values(df: DataFrame, names: list[str], **options) -> DataFrame:
    return shares(df, names, **options).where("rare").select("column", "value", "n", F.round("share", 9).alias("share"))


def outlier_ratio(df: DataFrame, names: list[str], **options) -> DataFrame:
    """(n_columns, outlier_ratio): mean over the columns used of the share of all rows whose value is rare; 5 decimals."""
    n = df.agg(F.count("*").alias("rows"))
    each = shares(df, names, **options).groupBy("column").agg(F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("rare_rows"))
    return each.crossJoin(n).agg(F.count("*").alias("n_columns"), F.coalesce(F.round(F.avg(F.col("rare_rows") / F.col("rows")), 5), F.lit(0.0)).alias("outlier_ratio"))


def skipped(df: DataFrame, names: list[str], most_ratio: float = HIGH_RATIO) -> DataFrame:
    own = frequencies(df, names).groupBy("column").agg(F.sum("n").alias("n_present"), F.count("*").alias("n_unique"))
    return own.where(F.col("n_unique") > most_ratio * F.col("n_present")).select("column", "n_unique", F.round(F.col("n_unique") / F.col("n_present"), 4).alias("unique_ratio"))


def rare_examples(df: DataFrame, names: list[str], key: str, most: int = EXAMPLES, **options) -> DataFrame:
    """(column, row, value, share): the rows with the rarest values of each column; ties by key. Rare values are joined
    before rows are ranked, so what is ranked is small."""
    rare = rare_values(df, names, **options)
    rows = df.select(F.inline(as_rows(df, names, lambda n, i: F.struct(F.lit(n).alias("column"), comparable(df, n).cast("string").alias("value"), col(key).alias("row")))))
    own = rows.join(rare, ["column", "value"])
    return own.withColumn("k", row_numbers(own, ["column"], [F.col("share"), F.col("row")])).where(F.col("k") <= most).select("column", "row", "value", "share")


def warnings(df: DataFrame, names: list[str], above: float = NULL_WARNING) -> DataFrame:
    return high_null(df, names, above)


def chi_square(df: DataFrame, names: list[str], correct: bool = True) -> DataFrame:
    """(a, b, chi_square, dof) of each pair of columns, from the counts of present pairs; Yates's correction at one degree
    of freedom."""
    pairs = list(combinations(names, 2))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), comparable(df, a).cast("string").alias("x"), comparable(df, b).cast("string").alias("y")) for a, b in pairs))
    cells = df.select(F.inline(rows)).where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    by = ["a", "b"]
    cells = saved(cells, "cells")  # read for its margins too
    xs, ys = cells.groupBy(*by, "x").agg(F.sum("n").alias("nx")), cells.groupBy(*by, "y").agg(F.sum("n").alias("ny"))
    sizes = xs.groupBy(*by).agg(F.count("*").alias("kx"), F.sum("nx").alias("total")).join(ys.groupBy(*by).agg(F.count("*").alias("ky")), by)
    sizes = sizes.select(*by, "total", ((F.col("kx") - 1) * (F.col("ky") - 1)).alias("dof")).where("dof > 0")
    sizes = F.broadcast(saved(sizes, "sizes"))  # a row for each pair of columns
    expected = F.col("nx") * F.col("ny") / F.col("total")
    gap = F.abs(F.coalesce("n", F.lit(0)) - expected)
    # A cell without rows adds its expected count, and all expected counts make the total: only cells with rows are needed.
    seen = cells.join(xs, [*by, "x"]).join(ys, [*by, "y"]).join(sizes, by)
    wide = seen.where("dof > 1") if correct else seen
    out = wide.groupBy(*by).agg((F.first("total") + F.sum(gap * gap / expected - expected)).alias("chi_square"), F.first("dof").alias("dof"))
    if not correct:
        return out
    grid = xs.join(sizes.where("dof = 1"), by).join(ys, by).join(cells, [*by, "x", "y"], "left")  # four cells a pair
    narrow = gap - F.least(F.lit(0.5), gap)
    return out.union(grid.groupBy(*by).agg(F.sum(narrow * narrow / expected).alias("chi_square"), F.first("dof").alias("dof")))


def chi_square_tail(x: float, dof: int) -> float:
    """P(chi-square with dof degrees of freedom > x): the regularised upper incomplete gamma function."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * scale


def dependent_pairs(df: DataFrame, names: list[str], below: float = 0.05) -> list[dict]:
    found = [r.asDict() for r in chi_square(df, names).collect()]  # a row for each pair of columns
    return [r | {"p_value": p} for r in found if (p := chi_square_tail(r["chi_square"], r["dof"])) < below]


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """n_classes, imbalance (largest over smallest), and the classes' entropy over its greatest possible."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count("*").alias("n"))
    spread = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    return counts.agg(F.count("*").alias("n_classes"), (F.max("n") / (F.min("n") + 1e-10)).alias("imbalance"), (spread / F.log(F.count("*") + 1e-10)).alias("class_entropy"))


