"""Profiles that grow with a table: sketches of each file, kept and merged.

A file's distinct values (HyperLogLog) and quantiles (KLL) are sketched once; a later profile reads new and changed files
alone and merges what is kept. Sketches follow their parameters in size, not the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from assay.functions.columns import col, columns_of, comparable, number
from assay.functions.storage import new_path

#: Bits of a register number of HyperLogLog (standard error 1.04 / 2 ** (BITS / 2)), and KLL's size (rank error about
#: 2.3 / SIZE ** 0.9).
BITS, SIZE = 14, 800
PERCENTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def distinct_sketch(df: DataFrame, name: str) -> Column:
    return F.hll_sketch_agg(F.xxhash64(comparable(df, name)), F.lit(BITS))


def approximate_cardinality(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_present, n_unique): distinct counts by sketch, all columns in one pass without multiplied rows."""
    names = names or df.columns
    sums = [F.count("*").alias("n_rows")]
    for i, n in enumerate(names):
        held = comparable(df, n)
        sums += [F.count(held).alias(f"p{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(F.when(held.isNotNull(), F.xxhash64(held)), F.lit(BITS))).alias(f"u{i}")]
    rows = F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"p{i}").alias("n_present"), F.col(f"u{i}").cast("long").alias("n_unique")) for i, n in enumerate(names)))
    return df.agg(*sums).select("n_rows", F.inline(rows)).select("column", "n_rows", "n_present", "n_unique")


def plain_path(path: Column) -> Column:
    """One spelling of a file's address."""
    return F.regexp_replace(path, r"^(\w+):/{3}", "$1:/")


class SketchStore:
    """Sketches of the files of a Parquet table, in a folder of their own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def files(self, table: str) -> DataFrame:
        """(file, modified, size) of a table as it is now, from the file system's listing."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(table)
        return listed.select(plain_path(F.col("path")).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))

    def kept(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.folder)
        except AnalysisException:
            return None

    def update(self, table: str) -> int:
        """Sketches the files that are new or have changed; how many these were."""
        now, kept = self.files(table), self.kept()
        todo = now if kept is None else now.join(kept.select("file", "modified", "size").distinct(), ["file", "modified", "size"], "left_anti")
        todo = todo.collect()  # what the listing says of new files
        if not todo:
            return 0
        df = self.spark.read.parquet(*[r["file"] for r in todo])
        found = self.sketched(df).join(F.broadcast(self.spark.createDataFrame(todo, now.schema)), "file")
        found.write.mode("append").parquet(self.folder)
        return len(todo)

    def sketched(self, df: DataFrame) -> DataFrame:
        """(file, column, n_rows, n_present, least, greatest, total, distinct, quantiles); the last four of numbers alone."""
        numeric = set(columns_of(df, "numeric"))
        sums, rows = [F.count("*").alias("n_rows")], []
        for i, n in enumerate(df.columns):
            held = comparable(df, n)
            sums += [F.count(held).alias(f"p{i}"), F.hll_sketch_agg(F.when(held.isNotNull(), F.xxhash64(held)), F.lit(BITS)).alias(f"d{i}")]
            more = [F.lit(None).cast(t) for t in ("double", "double", "double", "binary")]
            if n in numeric:
                x = number(df, n)
                sums += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}"), F.sum(x).alias(f"s{i}"), F.kll_sketch_agg_double(x, F.lit(SIZE)).alias(f"q{i}")]
                more = [F.col(f"{k}{i}") for k in "azsq"]
            rows.append(F.struct(F.lit(n).alias("column"), F.col(f"p{i}").alias("n_present"), F.col(f"d{i}").alias("distinct"), *(c.alias(k) for c, k in zip(more, ("least", "greatest", "total", "quantiles"), strict=True))))
        by_file = df.groupBy(plain_path(F.col("_metadata.file_path")).alias("file")).agg(*sums)
        return by_file.select("file", "n_rows", F.inline(F.array(*rows)))

    def profile(self, table: str) -> DataFrame:
        """(column, n_rows, n_present, n_unique, mean, least, greatest, p1, ..., p99) of the table's present files, from kept
        sketches alone; call update first. n_unique and percentiles are estimates, the others exact."""
        own = self.kept().join(F.broadcast(self.files(table)), ["file", "modified", "size"])
        one = own.groupBy("column").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_present").alias("n_present"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).cast("long").alias("n_unique"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_double("quantiles").alias("q"))
        places = [F.when(F.col("least").isNotNull(), F.kll_sketch_get_quantile_double("q", F.lit(p))).alias(f"p{round(100 * p)}") for p in PERCENTS]
        return one.select("column", "n_rows", "n_present", "n_unique", F.try_divide("total", "n_present").alias("mean"), "least", "greatest", *places)


def sketched_profile(spark: SparkSession, table: str) -> DataFrame:
    """The profile of a table by sketches that are made now."""
    store = SketchStore(spark, new_path(spark, "sketches"))
    store.update(table)
    return store.profile(table)
