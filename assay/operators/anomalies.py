"""Models that Spark does not have: isolation forest, autoencoder and principal-component reconstruction.

The forest's trees are grown on 256 rows each, drawn by hash from all rows, as many as the trees need; the autoencoder is
trained on all rows, in shards that keep their rows whatever the partitions are. Models are applied to all rows in Arrow
batches; what is broadcast is the fitted model, whose size follows the parameters alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import col
from assay.functions.ranks import exact_quantiles
from assay.functions.shipping import ship
from assay.functions.storage import saved
from assay.operators.numeric import standardised

TREES, LEAF_SAMPLE, CUT = 200, 256, 0.5


def path_length(n) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, random: np.random.Generator) -> dict[str, np.ndarray]:
    """One isolation tree as arrays: feature (-1 in leaves), cut, left and right child, depth plus path of leaves, and the
    rows that came to a node."""
    deepest = math.ceil(math.log2(max(2, len(x))))
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + float(path_length(len(rows))), len(rows)])
        wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 and depth < deepest else []
        if len(wide):
            f = int(random.choice(wide))
            cut = random.uniform(rows[:, f].min(), rows[:, f].max())
            low = rows[:, f] <= cut
            if low.any() and not low.all():
                nodes[me][:2] = [f, cut]
                nodes[me][2], nodes[me][3] = add(rows[low], depth + 1), add(rows[~low], depth + 1)
        return me

    add(x, 0)
    a = np.array(nodes)
    return {"feature": a[:, 0].astype(int), "cut": a[:, 1], "left": a[:, 2].astype(int), "right": a[:, 3].astype(int), "path": a[:, 4], "rows": a[:, 5]}


def packed(trees: list[dict]) -> dict[str, np.ndarray]:
    """All trees in one set of arrays, with their roots."""
    starts = np.cumsum([0, *(len(t["cut"]) for t in trees[:-1])])
    out = {k: np.concatenate([t[k] for t in trees]) for k in ("feature", "cut", "path")}
    out |= {k: np.concatenate([t[k] + at for t, at in zip(trees, starts, strict=True)]) for k in ("left", "right")}
    leaf = out["feature"] < 0
    here = np.arange(len(leaf))
    out["left"], out["right"] = np.where(leaf, here, out["left"]), np.where(leaf, here, out["right"])  # leaves stay where they are
    return out | {"feature": np.maximum(out["feature"], 0), "roots": starts, "depth": np.array(max(math.ceil(math.log2(max(2, t["rows"][0]))) for t in trees))}


def forest_scores(held: dict[str, np.ndarray], size: int, x: np.ndarray, at_once: int = 64) -> np.ndarray:
    """2 ** (-mean path / path_length(size)): near 1 for rows that are soon alone. All rows of a part go down all trees
    together, a level at a time."""
    out = np.empty(len(x))
    feature, children = held["feature"].astype(np.int32), np.stack([held["left"], held["right"]], axis=1).astype(np.int32).ravel()
    roots, width = held["roots"].astype(np.int32), x.shape[1]
    for a in range(0, len(x), at_once):
        part = np.ascontiguousarray(x[a : a + at_once])
        values, starts = part.ravel(), (np.arange(len(part), dtype=np.int32) * width)[:, None]
        at = np.tile(roots, (len(part), 1))
        for _ in range(int(held["depth"])):
            right = values.take(starts + feature.take(at)) > held["cut"].take(at)
            at = children.take(2 * at + right)
        out[a : a + at_once] = held["path"].take(at).mean(axis=1)
    return 2.0 ** (-out / max(float(path_length(size)), 1e-12))


def boxes(tree: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
    """Each leaf as (features, low, high, shares, path): the intervals (low, high] of the features on its way, and which
    share of the rows a feature's cuts let through."""
    out = []

    def walk(node: int, held: dict[int, tuple[float, float, float]]) -> None:
        f = int(tree["feature"][node])
        if f < 0:
            names = sorted(held)
            out.append((np.array(names, int), *(np.array([held[n][k] for n in names]) for k in range(3)), float(tree["path"][node])))
            return
        low, high, share = held.get(f, (-math.inf, math.inf, 1.0))
        cut = float(tree["cut"][node])
        for child, own in ((int(tree["left"][node]), (low, min(high, cut))), (int(tree["right"][node]), (max(low, cut), high))):
            walk(child, held | {f: (*own, share * tree["rows"][child] / tree["rows"][node])})

    walk(0, {})
    return out


def shares_of(inside: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values, before the leaf's path, of the game in which a coalition's worth is the product of 1 or 0 for its
    features (inside) and of the shares (of all rows, or of each) for the others. A feature's value weighs coalitions of the
    others by size, so the polynomial whose coefficients sum them by size is enough: polynomial in the features, not all of
    their subsets."""
    many, d = inside.shape
    shares = np.broadcast_to(shares, inside.shape)
    weights = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    out = np.empty((many, d))
    for f in range(d):
        sums = np.zeros((many, d))
        sums[:, 0] = 1.0
        for done, g in enumerate(g for g in range(d) if g != f):
            grown = sums[:, : done + 2] * shares[:, g, None]
            grown[:, 1:] += sums[:, : done + 1] * inside[:, g, None]
            sums[:, : done + 2] = grown
        out[:, f] = (inside[:, f] - shares[:, f]) * (sums @ weights)
    return out


def worked_out(tree: dict[str, np.ndarray], width: int) -> dict:
    """A tree for attributions: its cuts by feature; for each interval between them and each leaf the bits of the leaf's
    features that it fulfils (the last interval is that of unknown values, which fulfil none); and for each leaf the values
    of every set of its features, from places[leaf] on."""
    leaves = [x for x in boxes(tree) if len(x[0])]
    cuts = {f: np.unique(tree["cut"][tree["feature"] == f]) for f in sorted({int(f) for f in tree["feature"] if f >= 0})}
    codes = {f: np.zeros((len(c) + 2, len(leaves)), np.int32) for f, c in cuts.items()}
    places, kinds = np.zeros(len(leaves), np.int32), {}
    at = 0
    for i, (features, low, high, _, _) in enumerate(leaves):
        for bit, f in enumerate(features.tolist()):
            first = 0 if low[bit] == -math.inf else np.searchsorted(cuts[f], low[bit]) + 1
            codes[f][first : np.searchsorted(cuts[f], high[bit]) + 1, i] = 1 << bit  # all cuts are below infinity
        places[i] = at
        at += 1 << len(features)
        kinds.setdefault(len(features), []).append(i)
    values = np.zeros((at, width))
    for k, some in kinds.items():  # leaves with equally many features at once
        sets = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
        found = shares_of(np.tile(sets, (len(some), 1)).astype(float), np.repeat([leaves[i][3] for i in some], 1 << k, axis=0))
        for j, i in enumerate(some):
            values[places[i] : places[i] + (1 << k), leaves[i][0]] = leaves[i][4] * found[j << k : (j + 1) << k]
    return {"cuts": cuts, "codes": codes, "places": places, "values": values, "cells": math.prod(len(c) + 2 for c in cuts.values())}


def cell_values(held: dict, at: list[np.ndarray], at_once: int = 1024) -> np.ndarray:
    """Sums over leaves for rows whose features are in the intervals ``at``."""
    out = np.empty((len(at[0]), held["values"].shape[1]))
    columns = np.ascontiguousarray(held["values"].T)
    for a in range(0, len(out), at_once):
        code = held["places"] + sum(c[i[a : a + at_once]] for c, i in zip(held["codes"].values(), at, strict=True))
        for f, column in enumerate(columns):
            out[a : a + at_once, f] = column.take(code).sum(axis=1)
    return out


def tree_attributions(held: dict, x: np.ndarray, few: int = 1 << 13) -> np.ndarray:
    """Rows between the same cuts have the same values: they are worked out for each different cell of rows once, or, in a
    tree of few cells, for all cells."""
    if not held["cuts"]:
        return np.zeros(x.shape)
    at = [np.where(x[:, f] > -math.inf, np.searchsorted(c, x[:, f]), len(c) + 1) for f, c in held["cuts"].items()]
    shape = [len(c) + 2 for c in held["cuts"].values()]
    if held["cells"] > 1 << 62:
        return cell_values(held, at)
    cell = np.ravel_multi_index(at, shape)
    if held["cells"] <= few:
        if "table" not in held:
            held["table"] = cell_values(held, list(np.unravel_index(np.arange(held["cells"]), shape)))
        return held["table"].take(cell, axis=0)
    _, first, which = np.unique(cell, return_index=True, return_inverse=True)
    return cell_values(held, [i[first] for i in at])[which]


def path_attributions(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """For each row and feature its part in the mean path length's difference from the path expected without any feature
    known (where cuts on unknown features are passed in proportion to the rows grown on). Trees may be worked out already."""
    out = np.zeros(x.shape)
    for tree in trees:
        out += tree_attributions(tree if "cells" in tree else worked_out(tree, x.shape[1]), x)
    return out / len(trees)


def sample_of(scaled: DataFrame, key: str, names: list[str], rows: int) -> np.ndarray:
    """At most ``rows`` rows, by hash of the key. Of larger tables a filter by hash leaves about twice as many to be sorted."""
    every = max(1, scaled.count() // (2 * rows))
    some = scaled.where(F.pmod(F.xxhash64(col(key)), F.lit(every)) == 0) if every > 1 else scaled
    held = some.orderBy(F.md5(col(key).cast("string")), col(key)).limit(rows).select(*map(col, names)).toPandas()
    return held.to_numpy(float)


def fit_forest(scaled: DataFrame, key: str, names: list[str], trees: int = TREES, rows: int | None = None, seed: int = 42) -> tuple[list[dict], int]:
    """The trees, and on how many rows each was grown. They are dealt from trees * 256 rows of the table by hash (``rows``
    sets another number), which is all that so many trees can hold."""
    sample = sample_of(scaled, key, names, rows or trees * LEAF_SAMPLE)
    random = np.random.default_rng(seed)
    size = min(LEAF_SAMPLE, len(sample))
    return [grow(sample[random.choice(len(sample), size, replace=False)], random) for _ in range(trees)] if size else [], size


def isolation_forest(df: DataFrame, key: str, names: list[str], trees: int = TREES, rows: int | None = None, seed: int = 42, percentile: float | None = None) -> DataFrame:
    """(key, score, outlier): outliers score above 0.5, or at or above a percentile of all scores."""
    ship(df.sparkSession)
    scaled = standardised(df, names, keep=[key])
    grown, size = fit_forest(scaled, key, names, trees, rows, seed)
    if not size:
        return scaled.select(col(key), F.lit(0.0).alias("score"), F.lit(False).alias("outlier"))
    sent = df.sparkSession.sparkContext.broadcast((packed(grown), size))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held, n = sent.value
        for batch in batches:
            yield pd.Series(forest_scores(held, n, np.column_stack([c.to_numpy(float) for c in batch])))

    out = scaled.select(col(key), score(*map(col, names)).alias("score"))
    if percentile is None:
        return out.withColumn("outlier", F.col("score") > CUT)
    out = saved(out, "scores")
    edge = exact_quantiles(out, [F.col("score")], [percentile / 100])[0][0]
    return out.select(col(key), "score", (F.col("score") >= F.lit(edge)).alias("outlier"))


def forest_attributions(df: DataFrame, key: str, names: list[str], keys: DataFrame | None = None, trees: int = TREES, rows: int | None = None, seed: int = 42, most: int = 5) -> DataFrame:
    """(key, difference, features): how much shorter (below 0) or longer a row's mean path through the same forest as
    isolation_forest's is than expected, and the ``most`` features (feature, attribution) that take the largest parts in it,
    4 decimals, by feature on ties. keys: a table of the keys to explain; by default all."""
    ship(df.sparkSession)
    scaled = standardised(df, names, keep=[key])
    grown, size = fit_forest(scaled, key, names, trees, rows, seed)
    sent = df.sparkSession.sparkContext.broadcast(grown)
    asked = scaled.join(keys.select(col(key)).distinct().hint("merge"), key, "left_semi") if keys is not None else scaled  # as many as there are
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(tasks, key)  # narrow rows, much work for each

    @F.pandas_udf("array<double>")
    def parts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held = [worked_out(tree, len(names)) for tree in sent.value]
        for batch in batches:
            x = np.column_stack([c.to_numpy(float) for c in batch])
            yield pd.Series(list(path_attributions(held, x) if size else np.zeros(x.shape)))

    out = asked.select(col(key), parts(*map(col, names)).alias("parts"))
    pairs = F.zip_with("parts", F.array(*map(F.lit, names)), lambda x, n: F.struct((-F.round(F.abs(x), 4)).alias("order"), n.alias("feature"), F.round(x, 4).alias("attribution")))
    told = F.transform(F.slice(F.array_sort(pairs), 1, most), lambda p: F.struct(p["feature"].alias("feature"), p["attribution"].alias("attribution")))
    return out.select(col(key), F.aggregate("parts", F.lit(0.0), lambda s, x: s + x).alias("difference"), told.alias("features"))


class Autoencoder:
    """A mirrored network with ReLU layers and a linear last one, trained with Adam on squared error; or, side by side, as many
    networks as there are rows of parameters."""

    def __init__(self, width: int, factors: tuple[float, ...] = (0.5, 0.25), seed: int = 42):
        sizes = [width, *(max(4, int(width * f)) for f in factors)]
        sizes += sizes[-2::-1]
        self.shapes = list(zip(sizes[:-1], sizes[1:], strict=True))
        self.random = np.random.default_rng(seed)
        self.load(np.concatenate([*(self.random.normal(0, math.sqrt(2 / a), a * b) for a, b in self.shapes), np.zeros(sum(sizes[1:]))]))

    def parts(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Weights and biases as views of vectors."""
        ends = np.cumsum([*(a * b for a, b in self.shapes), *(b for _, b in self.shapes)])[:-1]
        split = np.split(vectors, ends, axis=-1)
        many, lead = len(self.shapes), vectors.shape[:-1]
        return [p.reshape(*lead, *shape) for p, shape in zip(split[:many], self.shapes, strict=True)], [p.reshape(*lead, 1, -1) for p in split[many:]]

    def layers(self, x: np.ndarray, first: int | None = None) -> list[np.ndarray]:
        """What the layers give, x included; of networks side by side the ``first`` ones."""
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w[:first] + b[:first]
            out.append(np.maximum(x, 0) if i < len(self.w) - 1 else x)
        return out

    def load(self, vectors: np.ndarray) -> Autoencoder:
        self.vectors = vectors.copy()
        self.w, self.b = self.parts(self.vectors)
        return self

    def loss(self, x: np.ndarray) -> float:
        """Summed over rows."""
        return float(((self.layers(x)[-1] - x) ** 2).mean(axis=1).sum())

    def train(self, blocks: list[np.ndarray], randoms: list[np.random.Generator], moments: np.ndarray, step: int, epochs: int, batch: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Trains one network for each block of rows: parameters and Adam's moments, a row each, and step counts. Epochs go
        over a block's shuffled rows in batches. A network gets its own batches alone, but all take their step at once, as
        single steps of small networks are mostly the interpreter's time. Blocks with more batches come first, so that those
        which have one left are the first ones; a last batch is filled up with rows that weigh nothing."""
        width, many = self.shapes[0][0], len(blocks)
        steps = [-(-len(x) // batch) for x in blocks]
        turn = sorted(range(many), key=lambda i: -steps[i])
        left = [sum(s > at for s in steps) for at in range(steps[turn[0]])]
        x, sizes = np.zeros((len(left), many, batch, width)), np.full((len(left), many, batch, 1), np.inf)
        for i, own in enumerate(turn):
            n = len(blocks[own])
            counts = np.minimum(batch, n - batch * np.arange(steps[own]))
            for at, size in enumerate(counts):
                sizes[at, i, :size] = size * width
        self.load(np.tile(self.vectors, (many, 1)))
        first, second = (np.tile(m, (many, 1)) for m in moments)
        done, g = np.full((many, 1), step), np.empty_like(first)
        grads_w, grads_b = self.parts(g)
        for _ in range(epochs):
            for i, own in enumerate(turn):
                rows = np.zeros((steps[own] * batch, width))
                rows[: len(blocks[own])] = blocks[own][randoms[own].permutation(len(blocks[own]))]
                x[: steps[own], i] = rows.reshape(-1, batch, width)
            for part, size, k in zip(x, sizes, left, strict=True):
                done[:k] += 1
                outs = self.layers(part[:k], k)
                back = 2 * (outs[-1] - part[:k]) / size[:k]
                for i in range(len(self.w) - 1, -1, -1):
                    np.matmul(outs[i].swapaxes(1, 2), back, out=grads_w[i][:k])
                    np.sum(back, axis=1, keepdims=True, out=grads_b[i][:k])
                    if i:
                        back = back @ self.w[i][:k].swapaxes(1, 2) * (outs[i] > 0)
                first[:k] += 0.1 * (g[:k] - first[:k])
                second[:k] += 0.001 * (g[:k] * g[:k] - second[:k])
                self.vectors[:k] -= rate * (first[:k] / (1 - 0.9 ** done[:k])) / (np.sqrt(second[:k] / (1 - 0.999 ** done[:k])) + 1e-8)
        back_in_order = np.argsort(turn)
        return np.hstack([self.vectors, first, second])[back_in_order], done[back_in_order, 0]


def sharded(scaled: DataFrame, key: str, names: list[str], rows: int) -> DataFrame:
    """(shard, n, held): all rows in shards of about ``rows``, by hash of the key and ordered by it, so that a shard's rows
    and their order don't depend on partitions; each as one block of numbers. Written once, read every round."""
    shards = max(1, -(-scaled.count() // rows))
    columns = [f"x{i}" for i in range(len(names))]
    own = scaled.select(F.pmod(F.xxhash64(col(key)), F.lit(shards)).alias("shard"), F.md5(col(key).cast("string")).alias("place"), *(col(n).alias(c) for n, c in zip(names, columns, strict=True)))

    def block(rows: pa.Table) -> pa.Table:
        x = np.column_stack(rows.sort_by([(n, "ascending") for n in ["place", *columns]]).select(columns).columns)
        return pa.table({"shard": rows["shard"].slice(0, 1), "n": [len(x)], "held": [x.astype(float).tobytes()]})

    return saved(own.groupBy("shard").applyInArrow(block, "shard long, n long, held binary"), "shards")


def fit_autoencoder(scaled: DataFrame, key: str, names: list[str], seed: int = 42, epochs: int = 100, local: int = 5, shard_rows: int = 5_000, batch: int = 32, rate: float = 1e-3, patience: int = 2, held: float = 0.2, together: int = 128) -> Autoencoder:
    """Trained on all rows, round by round: every shard goes on from the broadcast weights and Adam's moments for ``local``
    epochs of mini-batches, and the means of what shards come to, weighted by rows, are the next round's (parallel
    optimisation by averaging, after Zinkevich et al., 2010, and McMahan et al., 2017). A fifth of each shard tells the loss;
    the weights with the least are kept, and rounds end after ``patience`` of them without a better one. With one shard this
    is training in one place. A task takes the steps of up to ``together`` shards at once, which are in one Arrow batch (bounded
    by bytes) anyway; no shard's result depends on which. The driver gets one row for each weight."""
    net = Autoencoder(len(names), seed=seed)
    shards = sharded(scaled, key, names, shard_rows)
    state = np.concatenate([net.vectors, np.zeros(2 * len(net.vectors))])
    size, step, best, kept, waited = len(net.vectors), 0, math.inf, net.vectors.copy(), 0
    width = len(names)

    def round_of(sent, round_: int, epochs_: int, step_: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(3 * size + 4)
            net = Autoencoder(width)
            for pdf in batches:
                for at in range(0, len(pdf), together):
                    some = pdf.iloc[at : at + together]
                    net.load(sent.value[:size])
                    blocks, tails = [], []
                    for shard, n, block in zip(some["shard"], some["n"], some["held"], strict=True):
                        x = np.frombuffer(block).reshape(n, width)
                        order = np.random.default_rng([seed, int(shard)]).permutation(n)
                        cut = max(1, int(n * (1 - held)))
                        check = x[order[cut:]] if cut < n else x
                        blocks.append(x[order[:cut]])
                        tails.append([n, net.loss(check), len(check)])
                    randoms = [Autoencoder(width, seed=[seed, int(shard), round_]).random for shard in some["shard"]]
                    after, done = net.train(blocks, randoms, sent.value[size:].reshape(2, size), step_, epochs_, batch, rate)
                    weights = some["n"].to_numpy(float)
                    total += np.concatenate([weights @ after, np.sum(tails, axis=0), [weights @ done]])
            yield pd.DataFrame({"place": np.arange(len(total)), "x": total})

        return run

    context = scaled.sparkSession.sparkContext
    rounds = -(-epochs // local)
    for k in range(rounds + 1):  # the last round only tells its loss
        sent = context.broadcast(state)
        found = shards.mapInPandas(round_of(sent, k, local if k < rounds else 0, step), "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros(3 * size + 4)
        total[found["place"].to_numpy(int)] = found["x"].to_numpy(float)
        rows, loss, checked, steps = total[-4:]
        if not rows:
            break
        if loss / checked < best - 1e-12:
            best, kept, waited = loss / checked, state[:size].copy(), 0
        else:
            waited += 1
            if waited > patience:
                break
        state, step = total[: 3 * size] / rows, int(round(steps / rows))
    return net.load(kept)


def errors_by(df: DataFrame, key: str, names: list[str], rebuild) -> DataFrame:
    """(key, error, features): mean squared error of a row's standardised values, and the squared errors themselves."""
    ship(df.sparkSession)
    scaled = standardised(df, names, keep=[key])

    @F.pandas_udf("array<double>")
    def squares(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(float) for c in batch])
            yield pd.Series(list((rebuild(x) - x) ** 2))

    out = scaled.select(col(key), squares(*map(col, names)).alias("squares"))
    return out.select(col(key), (F.aggregate("squares", F.lit(0.0), lambda s, x: s + x) / len(names)).alias("error"), "squares")


def autoencoder_errors(df: DataFrame, key: str, names: list[str], seed: int = 42, **options) -> DataFrame:
    """As errors_by, by an autoencoder trained on all rows; options are those of fit_autoencoder."""
    ship(df.sparkSession)
    net = fit_autoencoder(standardised(df, names, keep=[key]), key, names, seed, **options)
    return errors_by(df, key, names, lambda x: net.layers(x)[-1])


def pca_errors(df: DataFrame, key: str, names: list[str], share: float = 0.5) -> DataFrame:
    """Reconstruction from the first components of the correlation matrix, found in one aggregation over all rows."""
    scaled = standardised(df, names, keep=[key])
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = scaled.agg(*(F.avg(col(names[i]) * col(names[j])).alias(f"c{k}") for k, (i, j) in enumerate(pairs))).first()
    matrix = np.zeros((d, d))
    for k, (i, j) in enumerate(pairs):
        matrix[i, j] = matrix[j, i] = sums[f"c{k}"] or 0.0
    _, vectors = np.linalg.eigh(matrix)
    top = vectors[:, ::-1][:, : max(1, int(d * share))]
    return errors_by(df, key, names, lambda x: x @ top @ top.T)


def high_errors(errors: DataFrame, key: str, percentile: float = 95) -> DataFrame:
    """errors with threshold (a percentile of all) and high (at or above it)."""
    errors = saved(errors, "errors")  # made by a model, and read more than once
    edge = exact_quantiles(errors, [F.col("error")], [percentile / 100])[0][0]
    return errors.withColumn("threshold", F.lit(edge).cast("double")).withColumn("high", F.col("error") >= F.col("threshold"))


def error_summary(high: DataFrame) -> DataFrame:
    return high.agg(F.avg("error").alias("mean_error"), F.first("threshold").alias("threshold"), F.coalesce(F.avg(F.col("high").cast("double")), F.lit(0.0)).alias("high_error_ratio"))


def error_examples(high: DataFrame, key: str, names: list[str], rows: int = 5, most: int = 5) -> DataFrame:
    """The first rows by key with high errors, and the features that err most in each."""
    pairs = F.array_sort(F.zip_with(F.transform("squares", lambda x: -F.round(x, 4)), F.array(*map(F.lit, names)), lambda x, n: F.struct(x.alias("order"), n.alias("feature"))))
    own = high.where("high").orderBy(col(key)).limit(rows)
    return own.select(col(key), F.round("error", 4).alias("error"), F.transform(F.slice(pairs, 1, most), lambda p: F.struct(p["feature"].alias("feature"), (-p["order"]).alias("squared_error"))).alias("features"))
