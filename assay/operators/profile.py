"""Shape, types, cardinality, description, missing values: one aggregation over the table for each question."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.columns import as_rows, col, columns_of, comparable, is_missing, number
from assay.functions.ranks import exact_quantiles, literals

IDENTIFIER_RATIO, IDENTIFIER_UNIQUE, LOW_UNIQUE = 0.98, 50, 20
PERCENTS = (0.01, 0.05, 0.5, 0.95, 0.99)
DISTINCT_AT_ONCE = 8
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def dtypes(df: DataFrame) -> DataFrame:
    """(dtype, n_columns), from the schema alone."""
    return df.sparkSession.createDataFrame(sorted(Counter(t for _, t in df.dtypes).items()), "dtype string, n_columns long")


def memory(df: DataFrame) -> DataFrame:
    """(column, bytes): the width of fixed types and the bytes of texts, an estimate of what the values take."""
    widths = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    sums = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.coalesce(F.octet_length(col(f.name)), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = F.coalesce(F.octet_length(F.to_json(F.struct(col(f.name)))), F.lit(0))
        else:
            size = F.lit(widths.get(type(f.dataType), 8))
        sums.append(F.sum(size).alias(f.name))
    one = df.agg(*sums)
    rows = as_rows(df, df.columns, lambda n, i: F.struct(F.lit(n).alias("column"), F.coalesce(col(n), F.lit(0)).cast("long").alias("bytes")))
    return one.select(F.inline(rows))


def cardinality(df: DataFrame, names: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, n_rows, n_present, n_unique, uniqueness_ratio, potential_identifier, low_cardinality). Columns of a type are
    counted ``DISTINCT_AT_ONCE`` at a time: each value becomes a narrow row (position, value), and equal ones are put together
    before they are dealt. Approximate counts are sketches of all columns in one pass."""
    names = names or df.columns
    if approximate:
        from assay.operators.sketches import approximate_cardinality

        return judged(approximate_cardinality(df, names))
    own = df.select(*(comparable(df, n).alias(str(i)) for i, n in enumerate(names)))
    own = own.select(*(F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, WHOLE) else f.name for f in own.schema.fields))
    kinds: dict[str, list[str]] = {}
    for f in own.schema.fields:
        kinds.setdefault(f.dataType.json(), []).append(f.name)
    listed = F.array(*map(F.lit, names))
    parts = [df.sparkSession.range(0, len(names), 1, 1).select(F.col("id").cast("string").alias("position"), *(F.lit(0).cast("long").alias(n) for n in ("n_rows", "n_present", "n_unique")))]  # tables without rows, too
    for some in kinds.values():
        for at in range(0, len(some), DISTINCT_AT_ONCE):
            values = own.unpivot([], some[at : at + DISTINCT_AT_ONCE], "position", "value").groupBy("position", "value").agg(F.count("*").alias("n"))
            parts.append(values.select("position", F.col("n").alias("n_rows"), F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0).alias("n_present"), F.col("value").isNotNull().cast("long").alias("n_unique")).groupBy("position").agg(*(F.sum(n).alias(n) for n in ("n_rows", "n_present", "n_unique"))))
    every = reduce(DataFrame.union, parts).groupBy(F.col("position").cast("int").alias("position")).agg(*(F.sum(n).alias(n) for n in ("n_rows", "n_present", "n_unique")))
    return judged(every.coalesce(1).sortWithinPartitions("position").withColumn("column", F.get(listed, F.col("position"))))


def judged(every: DataFrame) -> DataFrame:
    ratio = F.coalesce(F.round(F.try_divide(F.col("n_unique"), F.col("n_rows")), 5), F.lit(0.0))
    exact = F.coalesce(F.try_divide(F.col("n_unique"), F.col("n_rows")), F.lit(0.0))
    return every.select("column", "n_rows", "n_present", "n_unique", ratio.alias("uniqueness_ratio"), ((exact > IDENTIFIER_RATIO) & (F.col("n_unique") > IDENTIFIER_UNIQUE)).alias("potential_identifier"), (F.col("n_unique") < LOW_UNIQUE).alias("low_cardinality"))


def high_cardinality(df: DataFrame, names: list[str], most_ratio: float, least_unique: int = 0) -> DataFrame:
    """(column, n_unique, unique_ratio) of columns nearly all of whose values differ; columns without values are left out."""
    known = cardinality(df, names).where("n_present > 0")
    ratio = F.col("n_unique") / F.col("n_present")
    return known.where((ratio > most_ratio) & (F.col("n_unique") >= least_unique)).select("column", "n_unique", F.round(ratio, 4).alias("unique_ratio"))


def likely_identifiers(df: DataFrame, names: list[str] | None = None, above: float = 0.9) -> list[str]:
    """Columns that say which row it is, by name (id or name in it) or as nearly all values differ; of no use to explain."""
    names = names or df.columns
    called = [n for n in names if "id" in n.lower() or "name" in n.lower()]
    rest = [n for n in names if n not in called]
    different = {r["column"] for r in cardinality(df, rest).where(F.col("n_unique") > above * F.col("n_rows")).collect()} if rest else set()
    return [n for n in names if n in called or n in different]


def describe(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, n, mean, std, min, p1, p5, p50, p95, p99, max) of numeric columns; sample deviation, linear percentiles."""
    names = columns_of(df, "numeric")
    sums = []
    exact = [] if approximate else exact_quantiles(df, [number(df, n) for n in names], list(PERCENTS))
    for i, n in enumerate(names):
        x = number(df, n)
        percents = F.percentile_approx(x, list(PERCENTS), 10_000) if approximate else literals(exact[i])
        sums += [F.struct(F.lit(n).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), percents.alias("p"), F.max(x).alias("max")).alias(f"c{i}")]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n long, mean double, std double, min double, p1 double, p5 double, p50 double, p95 double, p99 double, max double")
    rows = df.agg(*sums).select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(names))))))
    return rows.select("column", "n", "mean", "std", "min", *(F.get("p", F.lit(i)).alias(f"p{round(100 * p)}") for i, p in enumerate(PERCENTS)), "max")


def missing(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, position, n_missing, missing_ratio)."""
    names = names or df.columns
    one = df.agg(F.count("*").alias("n"), *(F.count_if(is_missing(df, n)).alias(f"c{i}") for i, n in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(i).alias("position"), F.col(f"c{i}").alias("n_missing"), F.coalesce(F.try_divide(F.col(f"c{i}"), F.col("n")), F.lit(0.0)).alias("missing_ratio")) for i, n in enumerate(names)))
    return one.select(F.inline(rows))


def worst_missing(df: DataFrame, k: int = 3) -> DataFrame:
    """The k columns with the largest share of missing values; ties in column order."""
    return missing(df).orderBy(F.desc("missing_ratio"), "position").limit(k).select("column", "n_missing", "missing_ratio")


def high_null(df: DataFrame, names: list[str] | None = None, above: float = 0.5) -> DataFrame:
    return missing(df, names).where(F.col("missing_ratio") > above).select("column", F.round("missing_ratio", 4).alias("null_ratio"))


def completeness(df: DataFrame) -> DataFrame:
    """Share of missing cells, of columns with any, of complete rows, and the worst column's share."""
    flags = [F.when(is_missing(df, n), 1).otherwise(0) for n in df.columns]
    marked = df.select(F.array(*flags).alias("m"))
    one = marked.agg(F.count("*").alias("n"), F.avg(F.when(F.array_max("m") == 0, 1.0).otherwise(0.0)).alias("complete_rows"), *(F.avg(F.get("m", F.lit(i))).alias(f"c{i}") for i in range(len(flags))))
    each = F.array(*(F.col(f"c{i}") for i in range(len(flags))))
    return one.select(
        (F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(flags)).alias("missing_cells"),
        (F.size(F.filter(each, lambda x: x > 0)) / len(flags)).alias("columns_with_missing"),
        "complete_rows",
        F.array_max(each).alias("worst_column"),
    )


def null_patterns(df: DataFrame) -> DataFrame:
    """(pattern, n): rows by which columns are missing, 1 for missing, in column order."""
    pattern = F.concat(*(F.when(is_missing(df, n), "1").otherwise("0") for n in df.columns))
    return df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


def pattern_entropy(df: DataFrame) -> DataFrame:
    """Entropy (nats) of the missing patterns; 0 if nothing is missing."""
    own = null_patterns(df)
    return own.agg(F.coalesce(F.round(F.abs(F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")), 9), F.lit(0.0)).alias("entropy"))


def frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n) of the present values of columns, as text; all columns in one shuffle, combined before it."""
    rows = as_rows(df, names, lambda n, i: F.struct(F.lit(n).alias("column"), comparable(df, n).cast("string").alias("value")))
    return df.select(F.inline(rows)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def row_numbers(df: DataFrame, by: list, order: list):
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


