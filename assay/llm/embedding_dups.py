"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to length 1, where a cosine of c is a distance of sqrt(2 - 2c). Each of ``tables`` tables projects them on
``width`` Gaussian directions, shifts, divides by ``step`` and rounds down; the numbers, with the label, name a bucket. Two
vectors at the threshold's distance d fall in one cell of one direction with probability
p = 1 - 2 Phi(-r) - 2 / (sqrt(2 pi) r) (1 - exp(-r r / 2)), r = step / d, and in one bucket of some table with
1 - (1 - p^width)^tables: 0.99 for the defaults at 0.93, more above it. Pairs in a bucket are compared in double precision,
so none below the threshold is linked.

Equal vectors of a label are one row from the first step on, so a vector that a third of all rows repeat costs as much as
any other. Buckets of more than ``block`` vectors are compared as pairs of blocks, each a task's row group, so no bucket is
one task and none is cut short. A pair that meets in several tables counts in the first of them alone, which both
vectors' bucket numbers tell: no table of pairs is made or shuffled, only each vector's count and, for components, the
smallest id that it reaches in each block.

Vectors travel as they are given (four bytes a component for floats), with the bucket numbers of earlier tables alone.

Null labels, and vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths never link; neither do rows with a null id. Repeated rows with one id are linked as any equal vectors
are; each row is returned. An empty
table gives no rows. Columns other than the id, the vector and the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import components, id_text, saved, ship, with_id


def bucket_numbers(vectors: np.ndarray, tables: int, width: int, step: float, seed: int) -> np.ndarray:
    """(vectors, tables) of int64."""
    random = np.random.default_rng((seed, vectors.shape[1]))
    directions = random.standard_normal((vectors.shape[1], tables * width))
    shifts = random.uniform(0, step, tables * width)
    cells = np.floor((vectors @ directions + shifts) / step).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, width)
    out = np.zeros((len(vectors), tables), np.uint64)
    for k in range(width):
        out = (out ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def usable(values) -> np.ndarray | None:
    """The vector's components; None if it can't be scaled to length 1."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values] if isinstance(values, list) else values, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    return x if x.any() else None


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Stored vectors of one length, each scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def smallest_reachable(near: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id reachable) of those that near (first x second) links: labels fall to the smallest neighbour's until
    none changes, which links the same components with one pair for each vector."""
    rows, columns = near.any(axis=1), near.any(axis=0)
    near, first, second = near[rows][:, columns], first[rows], second[columns]
    if not len(first):
        return []
    most = np.iinfo(np.int64).max
    one, two = first.copy(), second.copy()
    while True:
        new_two = np.minimum(two, np.where(near, one[:, None], most).min(axis=0))
        new_one = np.minimum(one, np.where(near, new_two[None, :], most).min(axis=1))
        if (new_one == one).all() and (new_two == two).all():
            break
        one, two = new_one, new_two
    pairs = {*zip(first.tolist(), one.tolist(), strict=True), *zip(second.tolist(), two.tolist(), strict=True)}
    return [p for p in pairs if p[0] != p[1]]


def compare(table: int, one: slice, other: slice, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, keys: np.ndarray, least: float) -> tuple[list, list]:
    """One block of a bucket with itself or another: (id, links) and (id, smallest id reachable)."""
    near = vectors[one] @ vectors[other].T >= least
    if near.size * table <= 1 << 18:
        near &= ~(keys[one][:, None, :table] == keys[other][None, :, :table]).any(axis=2)  # met before
    else:
        for t in range(table):
            near &= keys[one][:, t, None] != keys[other][None, :, t]
    if one == other:
        near = np.triu(near, 1)
    if not near.any():
        return [], []
    weight = near.astype(np.float64)
    counts = [(ids[one], weight @ copies[other]), (ids[other], copies[one] @ weight)]
    links = [(i, int(n)) for who, many in counts for i, n in zip(who.tolist(), many.tolist(), strict=True) if n]
    return links, smallest_reachable(near, ids[one], ids[other])


def compare_runs(batches: Iterator[pd.DataFrame], least: float, kind: str) -> Iterator[pd.DataFrame]:
    """Over rows sorted by run (a bucket's pair of blocks). Rows (a, b, links): counts have b null; the others links 0."""
    held: list[pd.DataFrame] = []

    def done(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, same in part.groupby(part["vector"].map(len), sort=False):
            ids, copies = same["rep"].to_numpy(), same["copies"].to_numpy().astype(np.float64)
            vectors, raw_keys = unit_rows(same["vector"].tolist(), kind), same["keys"].tolist()
            run, block, low, high, table = (same[c].to_numpy() for c in ("run", "block", "low", "high", "table"))
            cuts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            counts, links = [], []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(same)], strict=True):
                if low[a] == high[a]:
                    one = other = slice(a, b)
                else:  # sorted by block
                    middle = a + int((block[a:b] == low[a]).sum())
                    one, other = slice(a, middle), slice(middle, b)
                keys = np.frombuffer(b"".join(raw_keys[a:b]), "<i8").reshape(b - a, -1)  # of earlier tables alone
                here = [slice(x.start - a, x.stop - a) for x in (one, other)]
                c, n = compare(int(table[a]), *here, ids[a:b], copies[a:b], vectors[a:b], keys, least)
                counts += c
                links += n
            rows = [(i, None, n) for i, n in counts] + [(i, j, 0) for i, j in links]
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b", "links"]).astype("Int64").groupby(["a", "b"], dropna=False, as_index=False)["links"].sum()

    for batch in batches:
        if not len(batch):
            continue
        tail = (batch["run"] == batch["run"].iloc[-1]).to_numpy()
        if tail.all():
            held.append(batch)
            continue
        yield from done(pd.concat([*held, batch[~tail]], ignore_index=True))
        held = [batch[tail]]
    if held:
        yield from done(pd.concat(held, ignore_index=True))


def link_vectors(vectors: DataFrame, least: float = 0.93, tables: int = 24, width: int = 8, step: float = 1.5, seed: int = 11, block: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Returns vec_id, n_links, component_id and kept, a row for each row of vectors."""
    ship(vectors.sparkSession)
    # As they are given, in four bytes where that is all they have.
    kind = "<f4" if vectors.schema[vector_column].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_column].dataType.containsNull) else "<f8"
    own = vectors.select(id_text(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"), F.col(label_column).cast("string").alias("label"))

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [usable(v) for v in batch["vector"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "vector": [None if x is None else x.astype(kind).tobytes() for x in found]})

    rows = saved(with_id(own.mapInPandas(scale, "vec_id string, label string, vector binary"), "vec_id"), "vectors")
    reps = rows.where("vector is not null and label is not null and vec_id is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vector"].map(len)):
                units = unit_rows(part["vector"].tolist(), kind)
                keys = bucket_numbers(units, tables, width, step, seed)
                yield pd.DataFrame({"rep": part["rep"], "copies": part["copies"], "label": part["label"], "vector": part["vector"], "keys": [k.astype("<i8").tobytes() for k in keys], "buckets": list(keys)})

    reps = saved(reps.mapInPandas(hashed, "rep long, copies long, label string, vector binary, keys binary, buckets array<long>"), "hashed")
    placed = reps.select("rep", "label", F.length("vector").alias("bytes"), F.posexplode("buckets").alias("table", "bucket"))
    sizes = placed.groupBy("label", "bytes", "table", "bucket").count().where("count > 1")
    sizes = saved(sizes.withColumn("blocks", F.ceil(F.col("count") / block)), "buckets")
    meet = placed.join(sizes.drop("count"), ["label", "bytes", "table", "bucket"])
    meet = meet.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    meet = meet.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = meet.select("rep", "label", "bytes", "table", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    meet = meet.join(reps.select("rep", "copies", "vector", "keys"), "rep").withColumn("keys", F.expr("substring(keys, 1, 8 * table)"))
    meet = meet.withColumn("run", F.xxhash64("label", "bytes", "table", "bucket", "low", "high")).drop("label", "bytes", "bucket")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = meet.repartition(tasks, "run").sortWithinPartitions("run", "block", "rep")
    found = meet.mapInPandas(lambda batches: compare_runs(batches, least, kind), "a long, b long, links long")
    found = saved(found, "found")
    counts = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "rep")

    known = reps.select("rep", "label", "vector", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(known, ["label", "vector"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
