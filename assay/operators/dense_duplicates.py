"""Near-duplicate rows by dense vectors: hashed n-grams, buckets of hyperplane signs, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import col, comparable, shuffled, strings_of
from assay.functions.shipping import ship
from assay.functions.storage import saved
from assay.operators.near_duplicates import row_tokens

WIDTH, TABLES, BITS, COSINE, BLOCK = 128, 24, 12, 0.9, 512


def vectors(hashes: list[np.ndarray], width: int = WIDTH) -> np.ndarray:
    """A unit vector for each set of 64-bit token hashes: each token adds its sign at its place. Without tokens, zeros."""
    out = np.zeros((len(hashes), width), np.float32)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    if sizes.sum():
        flat = np.concatenate(hashes).view(np.uint64)
        np.add.at(out, (np.repeat(np.arange(len(hashes)), sizes), (flat % np.uint64(width)).astype(int)), np.where(flat >> np.uint64(63), 1.0, -1.0).astype(np.float32))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def buckets(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """In each table the number made of the signs of ``bits`` random projections."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits)).astype(np.float32)
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def dense_pairs(df: DataFrame, key: str, names: list[str] | None = None, cosine: float = COSINE, tables: int = TABLES, bits: int = BITS, width: int = WIDTH, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(a, b, cosine): rows whose vectors' cosine is at least ``cosine`` and that share a bucket in one of the tables, which
    nineteen in twenty at a cosine of 0.9 do. names: text columns by default. Equal rows are one before buckets meet, and each
    further copy is paired with the first, as in near_duplicates. Rows without any token link with nothing. Buckets of many
    rows are compared as pairs of blocks; a pair is compared in the first table that it shares."""
    names = [n for n in names or strings_of(df) if n != key]
    ship(df.sparkSession)
    own = df.select(col(key).alias("key"), F.transform(row_tokens(df, names), lambda t: F.xxhash64(t)).alias("hashes"), F.md5(F.to_json(F.struct(*(comparable(df, c).alias(f"c{i}") for i, c in enumerate(names))))).alias("mark"))
    firsts = own.groupBy("mark").agg(F.min("key").alias("first"))
    copies = shuffled(own.select("key", "mark"), firsts, "mark").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("cosine"))
    kind = next(f.dataType.simpleString() for f in own.schema.fields if f.name == "key")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = vectors([np.asarray(h, np.int64) for h in batch["hashes"]], width)
            yield pd.DataFrame({"key": batch["key"], "x": [v.tobytes() for v in x], "places": list(buckets(x, tables, bits, seed))})

    reps = shuffled(own, firsts, (own["mark"] == firsts["mark"]) & (F.col("key") == F.col("first"))).where(F.size("hashes") > 0).select("key", "hashes")
    reps = saved(reps.mapInPandas(place, f"key {kind}, x binary, places array<long>"), "vectors")
    placed = reps.select("key", F.posexplode("places").alias("t", "bucket"))
    sizes = placed.groupBy("t", "bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = saved(sizes.select("t", "bucket", F.ceil(F.col("rows") / block).alias("blocks")), "buckets")
    meet = shuffled(placed, sizes, ["t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    meet = meet.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = shuffled(meet.select("key", "t", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")), reps, "key")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        t, low, high = (int(pdf[c].iloc[0]) for c in ("t", "low", "high"))
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), width)
        places, keys = np.stack(pdf["places"].tolist()), pdf["key"].to_numpy()
        left = np.flatnonzero(pdf["block"] == low)
        right = left if low == high else np.flatnonzero(pdf["block"] == high)
        one, two = np.nonzero(x[left] @ x[right].T >= cosine - 1e-5)
        one, two = left[one], right[two]
        keep = (one < two) if low == high else np.ones(len(one), bool)
        keep &= ~(places[one, :t] == places[two, :t]).any(axis=1)
        one, two = one[keep], two[keep]
        exact = np.einsum("ij,ij->i", x[one].astype(float), x[two].astype(float))
        return pd.DataFrame({"a": keys[one], "b": keys[two], "cosine": exact})

    found = meet.groupBy("t", "bucket", "low", "high").applyInPandas(compare, f"a {kind}, b {kind}, cosine double").where(F.col("cosine") >= cosine)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").union(copies)
