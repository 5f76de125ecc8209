"""Composite readiness score: dimensions, weights, bootstrap interval, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import col, columns_of, is_missing, number
from assay.functions.storage import saved
from assay.operators import categorical, duplicates, numeric, profile

WEIGHTS = {"completeness": 0.25, "consistency": 0.20, "accuracy": 0.30, "uniqueness": 0.15, "validity": 0.10}
REPLICATES, BOOTSTRAP_ROWS, LIGHT_COLUMNS = 30, 500, 5
SEVERITY = {"missing": (0.05, 0.2), "outlier": 0.1, "duplicate": 0.01, "redundancy": 0.1, "noise": (0.05, 0.15), "imbalance": 10}


def meta_features(df: DataFrame, target: str | None = None, noise_ratio: float = 0.0, correlation: float = numeric.CORRELATED) -> DataFrame:
    """One row with all that the score is made of."""
    names = columns_of(df, "numeric")
    one = profile.shape(df).withColumn("dimensionality", F.col("n_columns") / F.greatest(F.col("n_rows"), F.lit(1)))
    one = one.crossJoin(profile.completeness(df)).crossJoin(profile.pattern_entropy(df).withColumnRenamed("entropy", "pattern_entropy"))
    one = one.crossJoin(duplicates.summary(df).select(F.col("excess_ratio").alias("duplicate_ratio")))
    zero = lambda *cs: df.sparkSession.createDataFrame([(0.0,) * len(cs)], ", ".join(f"{c} double" for c in cs))
    if names:
        one = one.crossJoin(numeric.mean_abs(df)).crossJoin(numeric.iqr_outliers(df, names).agg(F.coalesce(F.avg("outlier_ratio"), F.lit(0.0)).alias("outlier_ratio")))
        one = one.crossJoin(numeric.redundancy(df, names, correlation)).crossJoin(numeric.near_duplicate_share(df, names).withColumnRenamed("near_ratio", "near_duplicate_ratio"))
        one = one.crossJoin(numeric.variance_variation(df, names)).crossJoin(numeric.histogram_entropy(df, names).agg(F.coalesce(F.avg("entropy"), F.lit(0.0)).alias("mean_entropy")))
    else:
        one = one.crossJoin(zero("mean_abs_skewness", "mean_abs_kurtosis", "outlier_ratio", "redundancy_ratio", "mean_abs_r", "std_abs_r", "near_duplicate_ratio", "variance_cv", "mean_entropy"))
    spectrum = numeric.intrinsic_dimension(df, names)
    one = one.withColumns({"dimension_ratio": F.lit(spectrum["dimension_ratio"]), "spectral_noise": F.lit(spectrum["noise_ratio"])})
    if target:
        one = one.crossJoin(categorical.class_balance(df, target))
    else:
        one = one.withColumns({"n_classes": F.lit(None).cast("long"), "imbalance": F.lit(None).cast("double"), "class_entropy": F.lit(None).cast("double")})
    return one.withColumn("noise_ratio", F.lit(float(noise_ratio)))


def dimension_scores(meta: DataFrame) -> DataFrame:
    """completeness, consistency, accuracy, uniqueness, validity; none below 0."""
    floor = lambda c: F.greatest(F.lit(0.0), c)
    return meta.select(
        floor(1 - 2 * F.col("missing_cells")).alias("completeness"),
        floor(1 - (3 * F.col("duplicate_ratio") + 2 * F.col("near_duplicate_ratio") + 2 * F.greatest(F.lit(0.0), F.col("redundancy_ratio") - 0.1))).alias("consistency"),
        floor(1 - 2 * F.col("noise_ratio") - 0.5 * F.col("outlier_ratio")).alias("accuracy"),
        floor(1 - 5 * F.col("duplicate_ratio")).alias("uniqueness"),
        floor(1 - F.least(F.col("mean_abs_skewness") / 5, F.lit(0.3)) - F.least(F.col("mean_abs_kurtosis") / 10, F.lit(0.2))).alias("validity"),
    )


def composite(weights: dict[str, float] | None = None) -> Column:
    """The weighted mean of the dimensions that have a weight, within 0 and 1."""
    used = {k: v for k, v in (weights or WEIGHTS).items() if k in WEIGHTS}
    total = sum(used.values())
    mean = sum((F.col(k) * v for k, v in used.items()), F.lit(0.0)) / total if total else F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))


def bootstrap(df: DataFrame, key: str, replicates: int = REPLICATES, rows: int = BOOTSTRAP_ROWS, weights: dict[str, float] | None = None, seed: int = 42, rows_each: int = 250_000) -> DataFrame:
    """(replicate, score): scores of resamples with replacement, from the features that a resample gives cheaply: missing
    cells, interquartile outliers of the first five numeric columns, and repeated rows. A resample of r rows is r draws of a
    place among all rows, in order of a hash and the key; draws are hash formulas. Rows are sorted into ranges of about
    ``rows_each``; a place is a range and a place in it, and the rows drawn are read from the written ranges by these two."""
    names = columns_of(df, "numeric")[:LIGHT_COLUMNS]
    own = df.select(F.conv(F.substring(F.md5(col(key).cast("string")), 1, 2), 16, 10).cast("int").alias("g"), col(key).alias("__key"), (sum((F.when(is_missing(df, c), 1.0).otherwise(0.0) for c in df.columns), F.lit(0.0)) / len(df.columns)).alias("gaps"), *(number(df, n).alias(f"x{i}") for i, n in enumerate(names)))
    n, spark = df.count(), df.sparkSession
    ranges = own.repartitionByRange(max(1, n // rows_each), "g", "__key").sortWithinPartitions("g", "__key")
    # The number that Spark gives is that of the range, shifted by 33 bits, and the place in it.
    numbered = saved(ranges.withColumn("at", F.monotonically_increasing_id()).drop("g", "__key"), "ranges")
    sizes = sorted(tuple(r) for r in numbered.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).collect())  # a row for each range
    starts, at = [], 0
    for own_number, size in sizes:
        starts.append((at, own_number))
        at += size
    held = F.array(*(F.struct(F.lit(a).cast("long").alias("start"), F.lit(r).cast("long").alias("range")) for a, r in starts)) if starts else F.array().cast("array<struct<start:bigint,range:bigint>>")
    size = min(rows, n)
    draws = spark.range(replicates).select(F.col("id").cast("int").alias("replicate")).crossJoin(spark.range(size).select(F.col("id").alias("draw")))
    draws = draws.withColumn("at", F.conv(F.substring(F.md5(F.concat_ws("|", F.col("replicate").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("long") % F.lit(max(1, n)))
    own_range = F.element_at(F.filter(held, lambda s: s["start"] <= F.col("at")), -1)
    draws = draws.withColumn("own", own_range).withColumn("at", F.shiftleft(F.col("own.range"), 33) + F.col("at") - F.col("own.start")).drop("own")
    drawn = saved(numbered.join(F.broadcast(draws), "at"), "drawn")  # replicates * rows draws
    fences = [F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.75))).alias(f"q{i}") for i in range(len(names))]
    one = drawn.groupBy("replicate").agg(F.count("*").alias("n"), F.count_distinct("at").alias("different"), F.avg("gaps").alias("missing_cells"), *fences)
    both = drawn.join(F.broadcast(one), "replicate")  # a row for each replicate
    marks = []
    for i in range(len(names)):
        low, high = F.get(f"q{i}", F.lit(0)), F.get(f"q{i}", F.lit(1))
        wide = high - low
        marks.append(F.avg(F.when(wide > 0, F.when((F.col(f"x{i}") < low - numeric.REACH * wide) | (F.col(f"x{i}") > high + numeric.REACH * wide), 1.0).otherwise(0.0))).alias(f"o{i}"))
    each = F.array_compact(F.array(*(F.col(f"o{i}") for i in range(len(names))))) if names else F.array().cast("array<double>")
    told = both.groupBy("replicate").agg(F.first("n").alias("n"), F.first("different").alias("different"), F.first("missing_cells").alias("missing_cells"), *marks)
    told = told.withColumn("outlier_ratio", F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each)).otherwise(0.0))
    told = told.withColumns({"duplicate_ratio": 1 - F.col("different") / F.col("n"), **{c: F.lit(0.0) for c in ("near_duplicate_ratio", "redundancy_ratio", "noise_ratio", "mean_abs_skewness", "mean_abs_kurtosis")}})
    floor = lambda c: F.greatest(F.lit(0.0), c)
    told = told.select("replicate", floor(1 - 2 * F.col("missing_cells")).alias("completeness"), floor(1 - 3 * F.col("duplicate_ratio")).alias("consistency"), floor(1 - 0.5 * F.col("outlier_ratio")).alias("accuracy"), floor(1 - 5 * F.col("duplicate_ratio")).alias("uniqueness"), F.lit(1.0).alias("validity"))
    return told.select("replicate", composite(weights).alias("score"))


def interval(scores: DataFrame, least: int = 10) -> DataFrame:
    """low, high: 2.5 and 97.5 percent of the scores; 0 and 1 for fewer than ten."""
    one = scores.agg(F.count("*").alias("n"), F.percentile("score", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    enough = F.col("n") >= least
    return one.select(F.when(enough, F.get("p", F.lit(0))).otherwise(0.0).alias("low"), F.when(enough, F.get("p", F.lit(1))).otherwise(1.0).alias("high"))


def issues(meta: dict, severity: dict | None = None) -> list[dict]:
    """(dimension, severity, what, value), the high ones first."""
    s = SEVERITY | (severity or {})
    out = []

    def add(dimension: str, level: str, what: str, value: float) -> None:
        out.append({"dimension": dimension, "severity": level, "what": what, "value": round(float(value), 4)})

    if meta["missing_cells"] > s["missing"][0]:
        add("completeness", "high" if meta["missing_cells"] > s["missing"][1] else "medium", "missing cells", meta["missing_cells"])
    if meta["outlier_ratio"] > s["outlier"]:
        add("accuracy", "medium", "outlying values", meta["outlier_ratio"])
    if meta["duplicate_ratio"] > s["duplicate"]:
        add("uniqueness", "medium", "repeated rows", meta["duplicate_ratio"])
    if meta["redundancy_ratio"] > s["redundancy"]:
        add("consistency", "low", "columns that nearly repeat others", meta["redundancy_ratio"])
    if (meta.get("noise_ratio") or 0) > s["noise"][0]:
        add("accuracy", "high" if meta["noise_ratio"] > s["noise"][1] else "medium", "doubtful labels", meta["noise_ratio"])
    if (meta.get("imbalance") or 0) > s["imbalance"]:
        add("validity", "medium", "unbalanced classes", meta["imbalance"])
    rank = {"high": 0, "medium": 1, "low": 2}
    return sorted(out, key=lambda x: rank[x["severity"]])


ADVICE = {
    "completeness": "Fill or drop what is missing, beginning with the worst columns.",
    "accuracy": "Check outlying values and doubtful labels against their source.",
    "uniqueness": "Remove repeated rows.",
    "consistency": "Drop columns that nearly repeat others.",
    "validity": "Transform skewed columns and weigh or resample rare classes.",
}


def recommendations(meta: dict, severity: dict | None = None) -> list[str]:
    out = [ADVICE[x["dimension"]] for x in issues(meta, severity)]
    if meta["dimensionality"] > 0.5:
        out.append("Collect more rows or use fewer columns: there are nearly as many columns as rows.")
    if meta.get("pattern_entropy", 0) > 2:
        out.append("Values go missing in many different combinations; look for more than one cause.")
    return list(dict.fromkeys(out))


def why_skipped(n_rows: int) -> str | None:
    return "the table is empty" if not n_rows else "fewer than five rows" if n_rows < 5 else None

