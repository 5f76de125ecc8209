"""Exact duplicate rows. Rows are equal if all their values are, missing values included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import col, comparable

LOW, MEDIUM = 0.001, 0.01


def groups(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = names or df.columns
    return df.groupBy(*(comparable(df, n).alias(n) for n in names)).agg(F.count("*").alias("n"))


def risk(ratio: Column, low: float = LOW, medium: float = MEDIUM) -> Column:
    return F.when(ratio == 0, "none").when(ratio < low, "low").when(ratio < medium, "medium").otherwise("high")


def summary(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """n_rows, duplicate_rows (every member of a group of two or more), duplicate_groups, unique_rows, duplicate_ratio,
    risk_level; and excess_ratio, which counts all members of a group but one."""
    many = F.col("n") > 1
    one = groups(df, names).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.count_if(many).alias("duplicate_groups"),
        F.count("*").alias("distinct_rows"),
    )
    ratio = F.coalesce(F.try_divide(F.col("duplicate_rows"), F.col("n_rows")), F.lit(0.0))
    return one.select(
        "n_rows", "duplicate_rows", "duplicate_groups", (F.col("n_rows") - F.col("duplicate_rows")).alias("unique_rows"),
        F.round(ratio, 5).alias("duplicate_ratio"), risk(ratio).alias("risk_level"),
        F.coalesce(F.try_divide(F.col("n_rows") - F.col("distinct_rows"), F.col("n_rows")), F.lit(0.0)).alias("excess_ratio"),
    )


def duplicate_groups(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(group_hash, n, the values) of groups of two or more; the hash is the MD5 of the values joined by bars."""
    names = names or df.columns
    text = F.concat_ws("|", *(F.coalesce(col(n).cast("string"), F.lit("nan")) for n in names))
    return groups(df, names).where("n > 1").select(F.md5(text).alias("group_hash"), "n", *map(col, names))
