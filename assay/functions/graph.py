"""Connected components of tables of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import shuffled
from assay.functions.shipping import ship
from assay.functions.storage import saved

#: Links of a task, and the neighbours from which a node's links stay where they are.
ROWS, MANY = 1 << 20, 1 << 17


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60, rows: int = ROWS, many: int = MANY) -> DataFrame:
    """The connected components of links: (node, component), component the smallest node. Nodes without links are absent.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each node's neighbours are tied to its
    smallest one, so that after a number of rounds that grows with the logarithm of the longest path only stars are left.
    Every round is a grouped minimum (combined before the shuffle) and an equi-join, and is cut off with written tables.
    The number of tasks follows that of links, as sizes on disk say little of what tasks then hold.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tasks = parts(pairs, pairs.count(), rows)
    pairs = saved(pairs.repartition(tasks, "u", "v").distinct(), "links")
    said = None
    for _ in range(most_rounds):
        above = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = tied(pairs.union(above), above, tasks, many)
        large = saved(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").repartition(tasks, "u", "v").distinct(), "large")
        small = tied(large, large, tasks, many)
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = saved(small.where("u <> v").repartition(tasks, "u", "v").distinct(), "links")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 1000033)).first())
        if now == said:
            break
        said, tasks = now, parts(pairs, now[0], rows)
    else:
        raise RuntimeError("the components did not settle")
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").repartition(tasks, "node").distinct())


def spanning(links: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): links of which each part of the table ties the same nodes together, but no more than it has nodes."""
    ship(links.sparkSession)
    own = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    kind = own.schema["a"].dataType.simpleString()
    return own.mapInArrow(lambda batches: forests(batches), f"a {kind}, b {kind}")


def hung_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """The same as components, for tables where most nodes hang on one other that is smaller, as copies do on the first: these
    take its component and no part in the rounds."""
    links = saved(spanning(links, a, b), "spanning")
    ends = links.union(links.select("b", "a")).toDF("node", "other")
    hung = ends.groupBy("node").agg(F.min("other").alias("other"), F.max("other").alias("top")).where((F.col("other") == F.col("top")) & (F.col("node") > F.col("other")))
    hung = saved(hung.select("node", "other"), "hung")
    rest = links.withColumn("node", F.greatest("a", "b")).join(hung.select("node").hint("merge"), "node", "left_anti")
    held = saved(components(rest, "a", "b"), "held")
    roots = hung.groupBy("other").agg(F.count("*")).select(F.col("other").alias("node"))
    roots = saved(roots.join(held.hint("merge"), "node", "full").select("node", F.coalesce("component", "node").alias("component")), "roots")
    return roots.union(shuffled(hung, roots.withColumnRenamed("node", "other"), "other").select("node", "component"))


def forests(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Over links (a, b): about ``rows`` at a time with what is left of those before, unless that is many too."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += len(batch)
        if many >= rows:
            held = forest(held)
            many = sum(map(len, held))
            if many > rows // 2:
                yield from held
                held, many = [], 0
    if held:
        yield from forest(held)


def forest(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Stars that tie together what links do."""
    links = pa.Table.from_batches(held)
    ends = pa.concat_arrays([*links.column("a").chunks, *links.column("b").chunks]).dictionary_encode()
    codes = ends.indices.to_numpy()
    u, v = codes[: len(links)], codes[len(links) :]
    label = np.arange(len(ends.dictionary))
    while (apart := label[u] != label[v]).any():
        x, y = label[u[apart]], label[v[apart]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    leaves = np.flatnonzero(label != np.arange(len(label)))
    take = lambda at: ends.dictionary.take(pa.array(at))
    return pa.table({"a": take(label[leaves]), "b": take(leaves)}).to_batches()


def parts(pairs: DataFrame, n: int, rows: int) -> int:
    return max(pairs.sparkSession.sparkContext.defaultParallelism, 1 + 2 * n // rows)


def tied(links: DataFrame, asked: DataFrame, tasks: int, many: int) -> DataFrame:
    """(u, v, m): the rows of asked with the smallest m of u and its neighbours in links. The links of nodes with very many
    are joined where they are; there are fewer such nodes than links / many."""
    least = links.repartition(tasks, "u", "v").groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    least = saved(least, "least")
    hubs, others = F.broadcast(least.where(F.col("n") > many).select("u", "m")), least.where(F.col("n") <= many).select("u", "m")
    if hubs.isEmpty():
        return shuffled(asked.repartition(tasks, "u"), others.repartition(tasks, "u"), "u")
    light = asked.join(hubs.select("u"), "u", "left_anti").repartition(tasks, "u")
    return shuffled(light, others.repartition(tasks, "u"), "u").union(asked.join(hubs, "u"))
