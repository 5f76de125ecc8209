"""Label noise by confident learning: the algebra on out-of-fold probabilities, and an ensemble that makes them.

Probability tables have (key, label, p): label a number from 0, p an array with a probability for each label.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import col, columns_of, number
from assay.functions.ranks import exact_quantiles
from assay.functions.shipping import ship
from assay.functions.storage import saved

FLAG, LARGE, SAMPLE, PERMUTATIONS, MOST_CLASSES = 0.5, 20_000, 10_000, 20, 1000


def own_p() -> Column:
    return F.get("p", F.col("label"))


def thresholds(probs: DataFrame) -> DataFrame:
    """(label, threshold): the mean probability of a label over the rows that have it."""
    return probs.groupBy("label").agg(F.avg(own_p()).alias("threshold"))


def confident(probs: DataFrame, classes: int) -> DataFrame:
    """probs with pred: the likeliest of the labels at or above their threshold, else the likeliest of all; the first of
    equals. A label without rows has the threshold 0.5."""
    limits = thresholds(probs).agg(F.map_from_entries(F.collect_list(F.struct("label", "threshold"))).alias("limits"))  # a row for each label
    both = probs.crossJoin(F.broadcast(limits))
    limit = lambda i: F.coalesce(F.try_element_at("limits", i.cast("int")), F.lit(0.5))
    scored = F.transform("p", lambda x, i: F.when(x >= limit(i), x).otherwise(F.lit(-1.0)))
    best = F.when(F.array_max(scored) >= 0, F.array_position(scored, F.array_max(scored))).otherwise(F.array_position("p", F.array_max("p"))) - 1
    return both.withColumn("pred", best.cast("int")).drop("limits")


def confident_joint(probs: DataFrame, classes: int) -> DataFrame:
    """(label, pred, n), zeros included."""
    grid = probs.sparkSession.range(classes).select(F.col("id").cast("int").alias("label")).crossJoin(probs.sparkSession.range(classes).select(F.col("id").cast("int").alias("pred")))
    counts = confident(probs, classes).groupBy("label", "pred").agg(F.count("*").alias("n"))
    return grid.join(counts, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def noise_scores(probs: DataFrame, flag: float = FLAG) -> DataFrame:
    """(key, label, score, flagged): the greatest other probability less the label's, plus what the label's lacks to 1."""
    others = F.array_max(F.filter("p", lambda x, i: i != F.col("label")))
    score = F.coalesce(others, F.lit(0.0)) - own_p() + (1 - own_p())
    return probs.select("key", "label", score.alias("score"), (score > flag).alias("flagged"))


def transition(joint: DataFrame) -> DataFrame:
    """(pred, label, t): of what seems to be pred, the share that is labelled so."""
    total = F.sum("n").over(Window.partitionBy("pred"))
    return joint.select("pred", "label", (F.col("n") / F.greatest(total, F.lit(1))).alias("t"))


def joint_distribution(joint: DataFrame) -> DataFrame:
    total = joint.agg(F.sum("n").alias("total"))
    return joint.crossJoin(F.broadcast(total)).select("label", "pred", F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0)).alias("share"))


def class_noise(probs: DataFrame, flag: float = FLAG) -> DataFrame:
    return noise_scores(probs, flag).groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("flagged").cast("double")).alias("noise_rate"))


def agreement(votes: DataFrame) -> DataFrame:
    """Mean share of classifiers that vote for a row's commonest label; votes is an array of labels."""
    most = F.array_max(F.transform(F.array_distinct("votes"), lambda v: F.size(F.filter("votes", lambda x: x == v))))
    return votes.agg(F.avg(most / F.size("votes")).alias("agreement"))


def noise_type(matrix: list[list[float]]) -> tuple[str, float]:
    """uniform, class_conditional or instance_dependent, with a confidence, from transition[pred][label]."""
    k = len(matrix)
    off = [matrix[i][j] for i in range(k) for j in range(k) if i != j]
    spread = lambda xs: (sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / len(xs)) ** 0.5 / (sum(xs) / len(xs) + 1e-10) if xs else 0.0
    if all(x < 0.01 for x in off):
        return "uniform", 0.95
    if (cv := spread(off)) < 0.3:
        return "uniform", 1 - cv
    if (cv := spread([1 - matrix[i][i] for i in range(k)])) > 0.5:
        return "class_conditional", min(1.0, cv)
    return "instance_dependent", 0.6


def folds(df: DataFrame, k: int, seed: int = 42, size: int | None = None, rows_each: int = 10_000) -> DataFrame:
    """df (key, label, ...) with fold: each label's rows dealt in turn by hash, in groups of about rows_each (``size`` sets
    their number), so that no label is one task."""
    size = size or max(1, df.count() // rows_each)
    mark = F.xxhash64("key", F.lit(seed))
    group = F.pmod(mark, F.lit(size))
    place = F.row_number().over(Window.partitionBy("label", group).orderBy(mark, "key"))
    return df.withColumn("fold", F.pmod(place + group, F.lit(k)).cast("int"))


def prepared(df: DataFrame, key: str, target: str, names: list[str] | None = None) -> tuple[DataFrame, list, list[str]]:
    """(key, label, x0, x1, ...) of the labelled rows, gaps filled with medians; the labels in order, and the columns' names."""
    names = [n for n in names or columns_of(df, "numeric") if n not in (target, key)]
    labels = [r[0] for r in df.where(col(target).isNotNull()).select(col(target)).distinct().limit(MOST_CLASSES + 1).collect()]
    if len(labels) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} different labels")
    labels.sort()
    medians = exact_quantiles(df, [number(df, n) for n in names], [0.5])
    place = F.create_map(*chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(labels)))
    own = df.where(col(target).isNotNull())
    return own.select(col(key).alias("key"), F.element_at(place, col(target)).cast("int").alias("label"), *(F.coalesce(number(df, n), F.lit(medians[i][0]).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, n in enumerate(names))), labels, names


def out_of_fold(df: DataFrame, key: str, target: str, names: list[str] | None = None, k: int | None = None, seed: int = 42, calibrate: bool = True, boosts: int = 100) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """(probabilities, votes, label names, warnings) of an ensemble of Spark ML classifiers, each row by models that have
    not seen it. Large tables get three folds and two classifiers, and aren't calibrated; a logistic regression isn't either.
    With more than two labels, boosting is one against the rest. Rows without a label are left out."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    own, labels, names = prepared(df, key, target, names)
    n = own.count()
    large = n > LARGE
    k = k or (3 if large else 5)
    ready = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="raw").transform(own)
    ready = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(ready).transform(ready)
    ready = saved(folds(ready.select("key", F.col("label"), "raw", "features"), k, seed), "folds")
    forest = dict(featuresCol="raw", labelCol="label", seed=seed)
    models = [("forest", RandomForestClassifier(numTrees=50 if large else 100, maxDepth=8 if large else 10, minInstancesPerNode=10 if large else 5, **forest)), ("logistic", LogisticRegression(labelCol="label", maxIter=500 if large else 1000))]
    if not large:
        models.append(("perceptron", MultilayerPerceptronClassifier(labelCol="label", layers=[len(names), 64, 32, len(labels)], seed=seed)))
        boosted = GBTClassifier(maxIter=boosts, maxDepth=5, stepSize=0.1, **forest)
        models.append(("boosted", boosted if len(labels) == 2 else OneVsRest(classifier=boosted, featuresCol="raw", labelCol="label", parallelism=2)))
    warned, made = [], []
    for name, model in models:
        try:
            parts = []
            for fold in range(k):
                fitted = model.fit(ready.where(F.col("fold") != fold))
                told = fitted.transform(ready.where(F.col("fold") == fold))
                if "probability" not in told.columns:  # margins of each label against the rest
                    p = normalised(F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m))))
                else:
                    p = vector_to_array("probability")
                parts.append(told.select("key", "label", "fold", p.alias("p")))
            every = parts[0]
            for x in parts[1:]:
                every = every.union(x)
            every = saved(every, f"probs-{name}")
            if calibrate and name != "logistic" and not large:
                every = saved(calibrated(every, k, len(labels)), f"calibrated-{name}")
            made.append(every.select("key", "label", "p"))
        except Exception as e:  # one classifier that can't be fitted leaves the others
            warned.append(f"{name}: {type(e).__name__}")
    if not made:
        raise RuntimeError(f"no classifier could be fitted: {warned}")
    joint = made[0].select("key", "label", F.array("p").alias("all"))
    for x in made[1:]:
        joint = joint.join(x.select("key", F.col("p").alias("q")), "key").select("key", "label", F.concat("all", F.array("q")).alias("all"))
    mean = F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: F.aggregate("all", F.lit(0.0), lambda s, p: s + F.get(p, i)) / F.size("all"))
    votes = joint.select("key", F.transform("all", lambda p: F.array_position(p, F.array_max(p)) - 1).alias("votes"))
    return saved(joint.select("key", "label", mean.alias("p")), "probs"), votes, labels, warned


def normalised(p: Column) -> Column:
    """Parts of 1; equal ones where all are 0."""
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.transform(p, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(p)))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values at sorted x that are nearest to y (pooling of adjacent violators)."""
    level: list[list[float]] = []  # (mean, weight, how many)
    for v, w in zip(y.tolist(), weight.tolist(), strict=True):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, w2, n2 = level.pop()
            v1, w1, n1 = level[-1]
            level[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([v for v, _, _ in level], [n for _, _, n in level])


def calibrated(probs: DataFrame, k: int, classes: int, steps: int = 2000) -> DataFrame:
    """probs (key, label, fold, p) by one isotonic curve for each fold and label, normalised. A fold's curves are fitted on the
    out-of-fold probabilities of the other folds, so they have seen neither its rows nor a model's training rows. Curves are
    made of the shares of rows with the label in ``steps`` steps of probability; one job fits all of them."""
    ship(probs.sparkSession)
    each = probs.select("fold", "label", F.posexplode("p").alias("class", "x"))
    binned = each.groupBy("fold", "class", F.round(F.col("x") * steps).cast("int").alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("class")).alias("hits"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))).alias("fold")
    sums = binned.select(other, "class", "step", "n", "hits").groupBy("fold", "class", "step").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        y = isotonic(pdf["step"].to_numpy(float), (pdf["hits"] / pdf["n"]).to_numpy(float), pdf["n"].to_numpy(float))
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "class": pdf["class"].iloc[:1], "xs": [pdf["step"].to_numpy(float) / steps], "ys": [y]})

    found = sums.groupBy("fold", "class").applyInPandas(curve, "fold int, class int, xs array<double>, ys array<double>").collect()  # at most steps points for each fold and label
    curves = {(r["fold"], r["class"]): (np.array(r.xs), np.array(r.ys)) for r in found}
    sent = probs.sparkSession.sparkContext.broadcast(curves)

    @F.pandas_udf("array<double>")
    def apply(fold: pd.Series, p: pd.Series) -> pd.Series:
        x = np.stack(p.tolist()) if len(p) else np.zeros((0, classes))
        out, own = x.copy(), fold.to_numpy()
        for f in np.unique(own):
            for c in range(classes):
                if (f, c) in sent.value:
                    out[own == f, c] = np.interp(x[own == f, c], *sent.value[f, c])
        total = out.sum(1, keepdims=True)
        return pd.Series(list(np.where(total > 0, out / np.where(total > 0, total, 1), 1 / classes)))

    return probs.select("key", "label", "fold", apply("fold", "p").alias("p"))


def one_against_rest(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression of each label against the rest, by Newton's method with a ridge; x ends with ones."""
    out, ridge = np.zeros((x.shape[1], classes)), np.diag([*[penalty] * (x.shape[1] - 1), 1e-6])
    for c in range(classes):
        w, t = out[:, c], (y == c).astype(float)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (t - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-5:
                break
    return out


def refitted_ratio(x: np.ndarray, y: np.ndarray, classes: int, k: int, seed, flag: float) -> float:
    """The share of flagged rows by out-of-fold probabilities of a logistic regression on x and its squares."""
    order = np.random.default_rng(seed).permutation(len(y))
    fold = np.empty(len(y), int)
    for c in range(classes):
        own = order[y[order] == c]
        fold[own] = np.arange(len(own)) % k
    p = np.zeros((len(y), classes))
    for f in range(k):
        train, rest = fold != f, fold == f
        if not rest.any():
            continue
        middle, wide = x[train].mean(0), x[train].std(0)
        z = (x - middle) / np.where(wide > 0, wide, 1.0)
        z = np.column_stack([z, np.clip(z, -4, 4) ** 2 - 1, np.ones(len(z))])
        margin = 1 / (1 + np.exp(-np.clip(z[rest] @ one_against_rest(z[train], y[train], classes), -30, 30)))
        p[rest] = margin / margin.sum(1, keepdims=True)
    own = p[np.arange(len(y)), y]
    others = np.where(np.arange(classes) == y[:, None], -1.0, p).max(1)
    return float((np.maximum(others, 0) - own + 1 - own > flag).mean())


def refitted_permutations(own: DataFrame, classes: int, rounds: int = PERMUTATIONS, k: int = 5, flag: float = FLAG, seed: int = 42) -> dict[int, float]:
    """The share of flagged rows for the labels as they are (-1) and for each shuffle of them (0, 1, ...), each by models
    fitted on those labels alone. own (key, label, x0, ...) is a bounded sample; a round is a group, all in one job."""
    ship(own.sparkSession)
    own = saved(own, "permute")
    names = [c for c in own.columns if c.startswith("x")]
    moved = shuffled_labels(own.select("key", "label"), rounds).union(own.select(F.lit(-1), "key", "label"))
    rows = moved.join(own.select("key", F.array(*names).alias("x")), "key").select("round", "key", "label", "x")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        round_ = int(pdf["round"].iloc[0])
        ratio = refitted_ratio(np.stack(pdf["x"].tolist()).astype(float), pdf["label"].to_numpy(int), classes, k, [seed, round_ + 1], flag)
        return pd.DataFrame({"round": [round_], "ratio": [ratio]})

    return {r["round"]: r["ratio"] for r in rows.groupBy("round").applyInPandas(fit, "round int, ratio double").collect()}


def shuffled_labels(own: DataFrame, rounds: int, rows_each: int = 10_000, seed: int = 42) -> DataFrame:
    """(round, key, label): the labels of (key, label), each round in another order. Keys and labels are ranked by hashes
    that have nothing in common, in cells of about rows_each rows, and meet by rank: all rounds are one plan."""
    cells = max(1, own.count() // rows_each)
    every = own.select("key", "label", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))

    def ranked(side: int) -> DataFrame:
        mark = F.xxhash64(F.lit(seed), F.lit(side), F.col("round"), F.col("key"))
        placed = every.withColumn("mark", mark).withColumn("cell", F.pmod("mark", F.lit(cells)))
        sizes = placed.groupBy("round", "cell").agg(F.count("*").alias("n"))  # rounds * cells rows
        before = sizes.select("round", "cell", (F.sum("n").over(Window.partitionBy("round").orderBy("cell")) - F.col("n")).alias("before"))
        place = F.row_number().over(Window.partitionBy("round", "cell").orderBy("mark", "key"))
        return placed.withColumn("place", place).join(before, ["round", "cell"]).withColumn("rank", F.col("place") + F.col("before"))

    keys, labels = ranked(1).select("round", "rank", "key"), ranked(2).select("round", "rank", "label")
    return keys.join(labels, ["round", "rank"]).select("round", "key", "label")


def permutation_test(probs: DataFrame, rounds: int = PERMUTATIONS, least: int = 5, refit: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Share of shuffles of the labels that leave no more flagged rows than the labels themselves do, and how far the
    observed ratio is from theirs. Without refit, the labels move and the probabilities stay, in one job for all rounds.
    refit makes probabilities for shuffled labels (key, label), which costs a fit of the ensemble for each round."""
    nothing = {"p_value": None, "significant": None, "null_mean": None, "null_std": None, "effect_size": None}
    if rounds < least:
        return nothing
    own = saved(probs.select("key", "label", "p"), "permute")
    ratio = lambda df: df.agg(F.avg(F.col("flagged").cast("double"))).first()[0] or 0.0
    observed = ratio(noise_scores(own))
    moved = shuffled_labels(own.select("key", "label"), rounds)
    if refit is None:
        scored = noise_scores(moved.join(own.select("key", "p"), "key").withColumn("key", F.col("round")))
        found = [r[1] for r in scored.groupBy("key").agg(F.avg(F.col("flagged").cast("double"))).collect()]  # a row for each round
    else:
        moved, found = saved(moved, "shuffled"), []
        for k in range(rounds):
            try:
                found.append(ratio(noise_scores(refit(moved.where(F.col("round") == k).select("key", "label")))))
            except Exception:  # a shuffle that can't be fitted leaves the others
                continue
    if len(found) < least:
        return nothing
    return compared(observed, found)


def refit_test(own: DataFrame, classes: int, rounds: int = PERMUTATIONS, least: int = 5) -> dict:
    """As permutation_test, by models that are fitted again for each shuffle and, to be compared, for the labels as they are."""
    if rounds < least:
        return {"p_value": None, "significant": None, "null_mean": None, "null_std": None, "effect_size": None}
    found = refitted_permutations(own, classes, rounds)
    return compared(found.pop(-1), list(found.values()))


def compared(observed: float, found: list[float]) -> dict:
    mean = sum(found) / len(found)
    spread = (sum((x - mean) ** 2 for x in found) / len(found)) ** 0.5
    p = sum(x <= observed for x in found) / len(found)
    return {"p_value": p, "significant": p < 0.05, "null_mean": mean, "null_std": spread, "effect_size": (observed - mean) / (spread + 1e-10)}


def why_skipped(df: DataFrame, target: str | None, least_rows: int = 10) -> str | None:
    if not target or target not in df.columns:
        return "no target column"
    if not [n for n in columns_of(df, "numeric") if n != target]:
        return "no numeric feature"
    n, classes = df.where(col(target).isNotNull()).agg(F.count("*"), F.count_distinct(col(target))).first()
    return "too few rows" if n < least_rows else "fewer than two classes" if classes < 2 else f"more than {MOST_CLASSES} classes" if classes > MOST_CLASSES else None
