"""Statistics and outliers of numeric columns."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import col, columns_of, number
from assay.functions.ranks import exact_quantiles
from assay.functions.storage import saved
from assay.operators.profile import high_cardinality

REACH, CORRELATED, HIGH_RATIO, HIGH_UNIQUE = 1.5, 0.9, 0.85, 50


def usable_columns(df: DataFrame, most_ratio: float = HIGH_RATIO, least_unique: int = HIGH_UNIQUE) -> tuple[list[str], list[dict]]:
    """Numeric columns with values, without those that are nearly all different; and the latter."""
    names = columns_of(df, "numeric")
    if not names:
        return [], []
    gone = [r.asDict() for r in high_cardinality(df, names, most_ratio, least_unique).collect()]
    held = df.agg(*(F.count(number(df, n)).alias(str(i)) for i, n in enumerate(names))).first()
    drop = {r["column"] for r in gone}
    return [n for i, n in enumerate(names) if held[i] and n not in drop], gone


def complete_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """The numeric columns of rows in which none is missing, as doubles."""
    return df.select(*(number(df, n).alias(n) for n in names)).na.drop()


def by_column(df: DataFrame, names: list[str], measures) -> DataFrame:
    """A row for each column: measures(value) gives named aggregates; all in one aggregation."""
    own = df.agg(*(F.struct(F.lit(n).alias("column"), *measures(col(n))).alias(f"c{i}") for i, n in enumerate(names)))
    return own.select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(names))))))


def standardised(df: DataFrame, names: list[str], impute: str = "mean", keep: list[str] | None = None, sample: bool = False) -> DataFrame:
    """Missing values by mean or (exact) median, then (x - mean) / deviation; population deviation unless sample; a
    deviation of 0 counts as 1."""
    if impute == "mean":
        own = df.crossJoin(F.broadcast(df.agg(*(F.avg(number(df, n)).alias(f"m{i}") for i, n in enumerate(names)))))
        middle = [F.col(f"m{i}") for i in range(len(names))]
    else:
        own, middle = df, [F.lit(q[0]).cast("double") for q in exact_quantiles(df, [number(df, n) for n in names], [0.5])]
    filled = own.select(*map(col, keep or []), *(F.coalesce(number(df, n), m).alias(f"x{i}") for i, (n, m) in enumerate(zip(names, middle, strict=True))))
    deviation = F.stddev_samp if sample else F.stddev_pop
    moments = filled.agg(*(F.avg(f"x{i}").alias(f"a{i}") for i in range(len(names))), *(deviation(F.col(f"x{i}")).alias(f"s{i}") for i in range(len(names))))
    scaled = filled.crossJoin(F.broadcast(moments))
    return scaled.select(*map(col, keep or []), *(((F.col(f"x{i}") - F.col(f"a{i}")) / F.when(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) > 0, F.col(f"s{i}")).otherwise(1.0)).alias(n) for i, n in enumerate(names)))


def iqr_outliers(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, q1, q3, n, n_outliers, outlier_ratio): values strictly beyond 1.5 interquartile ranges."""
    names = names or columns_of(df, "numeric")
    own = df.select(*(number(df, n).alias(n) for n in names))
    fences = exact_quantiles(own, [col(n) for n in names], [0.25, 0.75])

    def measures(i: int, n: str) -> Column:
        low, high = (F.lit(x).cast("double") for x in fences[i])
        out = (col(n) < low - REACH * (high - low)) | (col(n) > high + REACH * (high - low))
        return F.struct(F.lit(n).alias("column"), F.first(low).alias("q1"), F.first(high).alias("q3"), F.count(col(n)).alias("n"), F.count_if(out).alias("n_outliers")).alias(f"c{i}")

    rows = own.agg(*(measures(i, n) for i, n in enumerate(names))).select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(names))))))
    return rows.withColumn("outlier_ratio", F.coalesce(F.try_divide(F.col("n_outliers"), F.col("n")), F.lit(0.0)))


def skew_kurtosis(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, skewness, kurtosis): bias-corrected, kurtosis in excess; NULL below 3 and 4 values or for constants."""
    names = names or columns_of(df, "numeric")
    own = df.select(*(number(df, n).alias(n) for n in names))
    rows = by_column(own, names, lambda x: (F.count(x).alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), F.var_pop(x).alias("v")))
    n = F.col("n").cast("double")
    real = F.col("v") > 0
    return rows.select(
        "column",
        F.when(real & (n > 2), F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(real & (n > 3), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
    )


def variance_variation(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Sample deviation of the columns' variances over their mean."""
    names = names or columns_of(df, "numeric")
    rows = by_column(complete_rows(df, names), names, lambda x: (F.var_samp(x).alias("v"),))
    return rows.agg((F.coalesce(F.stddev_samp("v"), F.lit(0.0)) / (F.avg("v") + 1e-10)).alias("variance_cv"))


def histogram_entropy(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, bins, entropy): natural-log entropy of max(2, min(10, n // 10)) equal bins from minimum to maximum."""
    names = names or columns_of(df, "numeric")
    own = complete_rows(df, names)
    ends = by_column(own, names, lambda x: (F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")))
    ends = ends.withColumn("bins", F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.col("n") / 10))).cast("int"))
    values = own.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), col(n).alias("x")) for n in names))))
    placed = values.join(F.broadcast(ends), "column")  # a row for each column of the table
    place = F.when(F.col("high") == F.col("low"), F.lit(1)).otherwise(F.least(F.floor(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")) * F.col("bins")) + 1, F.col("bins")))
    counts = placed.groupBy("column", "bins", place.alias("bin")).agg(F.count("*").alias("k"))
    return counts.groupBy("column", "bins").agg(F.abs(F.log(F.sum("k")) - F.sum(F.col("k") * F.log("k")) / F.sum("k")).alias("entropy"))


def correlations(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(a, b, r) for each pair of numeric columns, over complete rows; NULL for constants. One aggregation."""
    names = names or columns_of(df, "numeric")
    own = complete_rows(df, names)
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    sums = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.try_divide(F.covar_pop(col(names[i]), col(names[j])), F.stddev_pop(col(names[i])) * F.stddev_pop(col(names[j]))).alias("r")).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]
    return own.agg(*sums).select(F.inline(F.array(*(F.col(f"c{k}") for k in range(len(pairs))))))


def redundancy(df: DataFrame, names: list[str] | None = None, above: float = CORRELATED) -> DataFrame:
    """Share of pairs with |r| above the limit, mean and population deviation of |r|."""
    r = F.abs(F.coalesce("r", F.lit(0.0)))
    one = correlations(df, names).agg(F.avg(F.when(r > above, 1.0).otherwise(0.0)).alias("redundancy_ratio"), F.avg(r).alias("mean_abs_r"), F.stddev_pop(r).alias("std_abs_r"))
    return one.select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in one.columns))


def intrinsic_dimension(df: DataFrame, names: list[str] | None = None, share: float = 0.95) -> dict:
    """From the eigenvalues of the correlation matrix: the share of components that explain ``share`` of the variance, and
    what is left beyond the first six. (1, 0) for fewer than 2 columns or 10 complete rows."""
    names = names or columns_of(df, "numeric")
    if len(names) < 2 or complete_rows(df, names).count() < 10:
        return {"dimension_ratio": 1.0, "noise_ratio": 0.0}
    matrix = np.eye(len(names))
    constant = set()
    for r in by_column(complete_rows(df, names), names, lambda x: (F.stddev_pop(x).alias("s"),)).collect():
        if not r.s:
            constant.add(r["column"])
    place = {n: i for i, n in enumerate(names)}
    for r in correlations(df, names).collect():  # pairs of columns
        matrix[place[r.a], place[r.b]] = matrix[place[r.b], place[r.a]] = r.r or 0.0
    for n in constant:
        matrix[place[n], place[n]] = 0.0
    values = np.sort(np.linalg.eigvalsh(matrix))[::-1].clip(0)
    if not values.sum():
        return {"dimension_ratio": 1.0, "noise_ratio": 0.0}
    run = np.cumsum(values) / values.sum()
    k = int(np.argmax(run >= share - 1e-12)) + 1
    return {"dimension_ratio": k / len(names), "noise_ratio": float(1 - run[min(5, len(names) - 1)])}


def near_duplicate_share(df: DataFrame, names: list[str] | None = None, rows: int = 300) -> DataFrame:
    """Of a sample of ``rows`` rows by hash (the feature is defined on a sample): the share of pairs of standardised rows
    nearer than a tenth of the distances' first percentile."""
    names = names or columns_of(df, "numeric")
    own = complete_rows(df, names).withColumn("h", F.xxhash64(*map(col, names))).orderBy("h", *map(col, names)).limit(rows)
    moments = own.agg(*(F.avg(col(n)).alias(f"a{i}") for i, n in enumerate(names)), *((F.coalesce(F.stddev_samp(col(n)), F.lit(0.0)) + 1e-10).alias(f"s{i}") for i, n in enumerate(names)))
    z = own.crossJoin(F.broadcast(moments)).select(F.row_number().over(Window.orderBy("h", *map(col, names))).alias("i"), F.array(*((col(n) - F.col(f"a{k}")) / F.col(f"s{k}") for k, n in enumerate(names))).alias("z"))
    z = z.sparkSession.createDataFrame(z.collect(), z.schema)  # at most ``rows`` rows
    one, two = z.alias("one"), z.alias("two")
    far = one.join(two, F.col("one.i") < F.col("two.i")).select(F.sqrt(F.aggregate(F.zip_with("one.z", "two.z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("d"))
    edge = far.agg((F.percentile("d", F.lit(0.01)) * 0.1).alias("edge"))
    return far.crossJoin(F.broadcast(edge)).agg(F.coalesce(F.avg(F.when(F.col("d") < F.col("edge"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("near_ratio"))


def deviations(df: DataFrame, keys: list[str], names: list[str], most: int = 5) -> DataFrame:
    """The keys, score (the largest |z|) and the ``most`` features with the largest |z|, 4 decimals, by feature on ties."""
    scaled = standardised(df, names, keep=keys)
    pairs = F.array(*(F.struct((-F.round(F.abs(col(n)), 4)).alias("order"), F.lit(n).alias("feature")) for n in names))
    top = F.slice(F.array_sort(pairs), 1, most)
    return scaled.select(*map(col, keys), F.greatest(*(F.abs(col(n)) for n in names), F.lit(0.0)).alias("score"), F.transform(top, lambda p: F.struct(p["feature"].alias("feature"), (-p["order"]).alias("deviation"))).alias("features"))


def sampled(df: DataFrame, rows: int, key: str, by: str | None = None) -> DataFrame:
    """About ``rows`` rows, the same ones each time; with ``by``, as many in proportion to each of its values, of which null
    is one. A value's rows are those with the least hashes of the key: only rows below a bound that lets some more than
    enough through are ranked. The bound is raised where it let too few through."""
    if by is None:
        return df.orderBy(F.xxhash64(col(key)), col(key)).limit(rows)
    from assay.operators.profile import row_numbers

    place = F.xxhash64(col(key)) / F.lit(2.0**64) + 0.5
    own = df.select(F.struct("*").alias("row"), col(key).alias("key"), col(by).alias("by"), place.alias("place"))
    counts = own.groupBy("by").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if total <= rows:
        return df
    quota = F.greatest(F.lit(1), F.round(F.col("n") * (rows / total)))
    counts = saved(counts.select(F.col("by").alias("stratum"), "n", quota.alias("quota")), "strata")
    own = own.join(counts, F.col("by").eqNullSafe(F.col("stratum")))
    slack = 1.0
    while True:
        bound = (F.col("quota") + slack * (6 * F.sqrt("quota") + 20)) / F.col("n")
        low = own.where((F.col("place") <= bound) | (bound >= 1))
        if low.groupBy("stratum").agg(F.count("*").alias("k"), F.first("quota").alias("quota")).where("k >= quota").count() == counts.count():
            break
        slack *= 30
    ranked = low.withColumn("rank", row_numbers(low, ["stratum"], [F.xxhash64("key"), F.col("key")]))
    return ranked.where("rank <= quota").select("row.*")


def mean_abs(df: DataFrame) -> DataFrame:
    return skew_kurtosis(df).agg(F.coalesce(F.avg(F.abs("skewness")), F.lit(0.0)).alias("mean_abs_skewness"), F.coalesce(F.avg(F.abs("kurtosis")), F.lit(0.0)).alias("mean_abs_kurtosis"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)
