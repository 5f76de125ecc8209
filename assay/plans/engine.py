"""Runs the operators on one table in the order of what they need from each other, and keeps what each found.

An operator is a ``Component``: ``analyze`` gives small results and lazily evaluated tables. One that fails or has nothing
to work on is marked, and the others go on. New ones are registered with ``register``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.columns import col, columns_of, strings_of
from assay.functions.storage import saved
from assay.operators import anomalies, categorical, constraints, duplicates, label_noise, near_duplicates, numeric, profile, quality, summary
from assay.report import html
from assay.report.explain import Explainer
from assay.sources.readers import Source, with_row_id
from assay.sources.results import ResultStore


@dataclass
class Config:
    overview: bool = True
    missing_values: bool = True
    exact_duplicates: bool = True
    near_duplicates: bool = True
    outliers: bool = True
    categorical_outliers: bool = True
    reconstruction: bool = True
    label_noise: bool = True
    constraints: bool = True
    quality: bool = True
    summary: bool = True
    key: str | None = None
    target_column: str | None = None
    explain: bool = True
    output_path: str = "data_quality_report.html"
    report_title: str = "Data quality report"
    options: dict[str, dict] = field(default_factory=dict)

    def enabled(self) -> list[str]:
        names = [f.name for f in fields(self) if f.type == "bool" and f.name != "explain" and getattr(self, f.name)]
        return [n for n in names if n != "label_noise" or self.target_column]


@dataclass
class Context:
    frame: DataFrame
    key: str
    config: Config
    results: dict[str, dict] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [c for c in self.frame.columns if c != "row_id"]


class Skipped(Exception):
    """There is nothing to work on."""


class Component(ABC):
    name: str
    needs: tuple[str, ...] = ()

    @abstractmethod
    def analyze(self, context: Context, **options) -> dict:
        """Small results; tables go to context.tables."""


REGISTRY: dict[str, type[Component]] = {}


def register(cls: type[Component]) -> type[Component]:
    REGISTRY[cls.name] = cls
    return cls


def rows(df: DataFrame) -> list[dict]:
    """Of tables with a row for each column, rule or example."""
    return [r.asDict(recursive=True) for r in df.collect()]


@register
class Overview(Component):
    name = "overview"

    def analyze(self, context, **options):
        df = context.frame.select(*context.names)
        known = context.tables["cardinality"] = saved(profile.cardinality(df), "cardinality")
        context.tables["describe"] = profile.describe(df)
        held = rows(known)
        return profile.shape(df).first().asDict() | {"dtypes": {r["dtype"]: r["n_columns"] for r in rows(profile.dtypes(df))}, "memory_mb": round(sum(r["bytes"] for r in rows(profile.memory(df))) / 1048576, 3), "potential_identifiers": [r["column"] for r in held if r["potential_identifier"]], "low_cardinality": [r["column"] for r in held if r["low_cardinality"]]}


@register
class MissingValues(Component):
    name = "missing_values"

    def analyze(self, context, **options):
        df = context.frame.select(*context.names)
        context.tables["missing"] = profile.missing(df)
        held = rows(context.tables["missing"])
        return {"num_columns_with_missing": sum(r["n_missing"] > 0 for r in held), "worst_columns": rows(profile.worst_missing(df)), **profile.completeness(df).first().asDict()}


@register
class ExactDuplicates(Component):
    name = "exact_duplicates"

    def analyze(self, context, **options):
        df = context.frame.select(*context.names)
        context.tables["duplicate_groups"] = duplicates.duplicate_groups(df)
        return duplicates.summary(df).first().asDict()


@register
class NearDuplicates(Component):
    name = "near_duplicates"

    def analyze(self, context, **options):
        names = [c for c in context.names if c != context.key]
        if not names:
            raise Skipped("no column beside the key")
        found = context.tables["near_duplicate_pairs"] = saved(near_duplicates.pairs(context.frame, context.key, names, **options), "pairs")
        out = near_duplicates.summary(context.frame, found).first().asDict()
        every = sorted(rows(near_duplicates.contributions(found, names)), key=lambda r: -r["contribution"])  # a row for each column
        facts = out | {"n_rows": context.frame.count()}
        texts = []
        if context.config.explain:
            top = found.orderBy(F.desc("similarity"), "a", "b").limit(3).collect()
            held = {r[context.key]: r.asDict() for r in context.frame.where(col(context.key).isin([k for r in top for k in (r.a, r.b)])).collect()} if top else {}  # at most six rows
            texts = [Explainer.shared().near_duplicate(held[r.a], held[r.b], r.similarity, [m for m in r.matching.split("|") if m]) for r in top]
        return out | {"top_contributing_columns": every[:5], "implications": near_duplicates.implications(facts, every), "recommendations": near_duplicates.recommendations(out["near_duplicate_ratio"], facts), "example_texts": texts}


@register
class Outliers(Component):
    name = "outliers"

    def analyze(self, context, attribute=True, **options):
        """attribute: outliers are explained by what features do to their paths in the forest, else by deviations."""
        names, gone = numeric.usable_columns(context.frame.select(*[c for c in context.names if c != context.key]))
        if not names:
            raise Skipped("no numeric column")
        scores = context.tables["outlier_scores"] = saved(anomalies.isolation_forest(context.frame, context.key, names, **options), "scores")
        flagged = scores.where("outlier")
        n, k = scores.count(), flagged.count()
        if attribute:
            fitted = {k: v for k, v in options.items() if k in ("trees", "rows", "seed")}
            why = anomalies.forest_attributions(context.frame, context.key, names, flagged.select(context.key), **fitted)
        else:
            why = numeric.deviations(context.frame, [context.key], names).withColumnRenamed("score", "deviation")
        context.tables["outlier_reasons"] = flagged.join(why, context.key)
        first = rows(context.tables["outlier_reasons"].orderBy(context.key).limit(3)) if k else []
        shown = [c for c in context.names if c != context.key]
        shown = [c for c in shown if c not in profile.likely_identifiers(context.frame, shown)][:10]
        values = rows(context.frame.where(col(context.key).isin([r[context.key] for r in first])).select(col(context.key), *map(col, shown))) if first else []
        by_key = {v[context.key]: v for v in values}
        texts = [Explainer.shared().outlier({c: x for c, x in by_key[r[context.key]].items() if c != context.key}, r["score"], {f["feature"]: f["attribution" if attribute else "deviation"] for f in r["features"]}) for r in first] if context.config.explain else []
        return {"outlier_ratio": round(k / n, 5) if n else 0.0, "threshold": anomalies.CUT, "skipped_columns": gone, "example_outliers": first, "example_values": values, "example_texts": texts}


@register
class CategoricalOutliers(Component):
    name = "categorical_outliers"

    def analyze(self, context, chi_square=False, null_above=categorical.NULL_WARNING, examples=categorical.EXAMPLES, **options):
        """options: those of ``categorical.shares``, for all tables."""
        df = context.frame.select(*context.names)
        names = columns_of(df, "categorical", "datetime")
        if not names:
            return {"outlier_ratio": 0.0, "n_columns": 0, "skipped_columns": [], "example_outliers": []}
        context.tables["rare_values"] = categorical.rare_values(df, names, **options)
        gone = rows(categorical.skipped(df, names, options.get("most_ratio", categorical.HIGH_RATIO)))
        used = [n for n in names if n not in {r["column"] for r in gone}]
        pairs = categorical.dependent_pairs(df, used) if chi_square and len(used) > 1 else []
        return categorical.outlier_ratio(df, names, **options).first().asDict() | {"skipped_columns": gone, "warnings": rows(categorical.warnings(df, names, null_above)), "dependent_pairs": pairs, "example_outliers": rows(categorical.rare_examples(context.frame, names, context.key, examples, **options))[:examples]}


@register
class Reconstruction(Component):
    name = "reconstruction"

    def analyze(self, context, **options):
        df, n = context.frame.select(*[c for c in context.names if c != context.key]), context.frame.count()
        if not n:
            raise Skipped("the table is empty")
        if not columns_of(df, "numeric"):
            raise Skipped("no numeric column")
        if n < 10:
            raise Skipped("fewer than ten rows")
        names, gone = numeric.usable_columns(df)
        if len(names) < 2:
            raise Skipped("fewer than two usable numeric columns")
        frame = context.frame
        if not options.pop("impute", True):
            frame = frame.na.drop(subset=names)
            if numeric.complete_rows(df, names).count() < 10:
                raise Skipped("fewer than ten complete rows")
        errors = saved(anomalies.autoencoder_errors(frame, context.key, names, **options), "errors")
        high = context.tables["reconstruction_errors"] = anomalies.high_errors(errors, context.key)
        some = rows(anomalies.error_examples(high, context.key, names))[:3]
        texts = [Explainer.shared().anomaly(r["error"], {f["feature"]: f["squared_error"] for f in r["features"]}) for r in some] if context.config.explain else []
        return anomalies.error_summary(high).first().asDict() | {"skipped_columns": gone, "example_explanations": some, "example_texts": texts}


@register
class LabelNoise(Component):
    name = "label_noise"

    def analyze(self, context, **options):
        target = context.config.target_column
        if why := label_noise.why_skipped(context.frame.select(*context.names), target):
            raise Skipped(why)
        df = numeric.sampled(context.frame.where(col(target).isNotNull()), label_noise.SAMPLE, context.key, target)
        names, permute = [n for n in columns_of(df, "numeric") if n in context.names], options.pop("permute", True)
        probs, votes, labels, warned = label_noise.out_of_fold(df, context.key, target, names, **options)
        scores = context.tables["label_noise_scores"] = label_noise.noise_scores(probs)
        joint = saved(label_noise.confident_joint(probs, len(labels)), "joint")
        matrix = [[0.0] * len(labels) for _ in labels]
        for r in label_noise.transition(joint).collect():  # a row for each pair of labels
            matrix[r["pred"]][r["label"]] = r["t"]
        kind, sure = label_noise.noise_type(matrix)
        n = probs.count()
        k = scores.where("flagged").count()
        test = label_noise.refit_test(label_noise.prepared(df, context.key, target, names)[0], len(labels)) if k and n <= label_noise.LARGE and permute else {"p_value": None, "effect_size": None}
        told = []
        if context.config.explain:
            for r in probs.join(scores.where("flagged").select("key", "score"), "key").orderBy(F.desc("score"), "key").limit(3).collect():
                likely = max((i for i in range(len(labels)) if i != r["label"]), key=lambda i: r["p"][i])
                told.append(Explainer.shared().label_noise(labels[r["label"]], labels[likely], r["score"]))
        return {"noise_ratio": round(k / n, 4), "noisy_rows": k, "noise_type": kind, "type_confidence": sure, "agreement": label_noise.agreement(votes).first()[0], "class_noise": {str(labels[r["label"]]): r["noise_rate"] for r in label_noise.class_noise(probs).collect()}, "noisy_examples": [r["key"] for r in scores.where("flagged").orderBy("key").limit(20).collect()], "mean_self_transition": sum(matrix[i][i] for i in range(len(labels))) / len(labels), "warnings": warned, "example_texts": told, **test}


@register
class Constraints(Component):
    name = "constraints"

    def analyze(self, context, unique=(), not_null=(), domains=None, patterns=None, rules=(), now=None, max_determinant=2, **options):
        df = context.frame.select(*context.names)
        c = constraints
        parts = [c.ranges(df), c.non_negative(df)]
        parts += [c.uniqueness(df, list(unique))] if unique else []
        parts += [c.not_null(df, list(not_null))] if not_null else []
        parts += [c.domain(df, domains)] if domains else []
        parts += [c.patterns(df, patterns)] if patterns else []
        parts += [c.rule(df, r) for r in rules]
        times = c.temporal_columns(df)
        if times:
            parts += [c.future_dates(df, times, now), c.date_order(df, c.date_pairs(times))]
        names = c.dependency_candidates(df)
        found = saved(c.dependencies(df, names), "dependencies")
        parts.append(c.dependency_violations(found))
        n_pairs = 0
        if max_determinant > 1 and len(names) > 2:
            known = {(c.unlisted(r["determinant"]), r["dependent"]) for r in found.collect()}  # pairs of columns
            context.tables["dependencies_of_two"] = two = saved(c.dependencies(df, names, 2, known=known), "dependencies")
            n_pairs = two.count()
        broken = context.tables["violations"] = saved(numeric.union_all(parts), "violations")
        context.tables["dependencies"] = found
        score = c.consistency(broken).first().asDict()
        texts = [n for n in strings_of(df) if n not in times]
        if texts:
            context.tables["rare_spellings"] = c.rare_values(df, texts)
        context.tables["column_scores"] = c.column_scores(broken)
        nearly = [r for r in found.where("n_broken > 0").orderBy(F.desc("confidence"), "determinant", "dependent").limit(3).collect() if len(c.unlisted(r["determinant"])) == 1]
        shown = {f"{r['determinant']} -> {r['dependent']}": rows(c.dependency_examples(df, c.unlisted(r["determinant"])[0], r["dependent"])) for r in nearly}
        told = {"temporal_statistics": rows(c.temporal_stats(df, times, now)) if times else [], "rare_values": rows(context.tables["rare_spellings"].limit(20)) if texts else [], "dependency_examples": shown, "column_scores": rows(context.tables["column_scores"])}
        return score | told | {"total_functional_dependencies": found.count() + n_pairs, "unique_columns": [r["column"] for r in c.unique_columns(df).collect()], "detected_patterns": rows(c.detected_patterns(df)) if strings_of(df) else [], "failed_rules": rows(broken.where("status = 'failed'").select("columns", "reason")), "example_violations": rows(broken.where("n_violations > 0").select("check", "columns", "severity", "n_violations").orderBy(F.desc("n_violations"), "check", "columns").limit(5)), "violation_rows": c.examples(context.frame, context.key, parts, broken.where("n_violations > 0").collect(), 5), "recommendations": c.recommendations(score)}


@register
class Quality(Component):
    name = "quality"
    needs = ("label_noise",)

    def analyze(self, context, weights=None, severity=None, **options):
        df = context.frame.select(*context.names)
        if why := quality.why_skipped(df.count()):
            raise Skipped(why)
        noise = context.results.get("label_noise", {}).get("noise_ratio") or 0.0
        meta = saved(quality.meta_features(df, context.config.target_column, noise), "meta")
        scores = quality.dimension_scores(meta)
        one = scores.withColumn("score", quality.composite(weights)).first().asDict()
        held = meta.first().asDict()
        found = quality.issues(held, severity)
        low, high = quality.interval(quality.bootstrap(context.frame.select(context.key, *[c for c in context.names if c != context.key]), context.key, weights=weights)).first()
        return {"data_readiness_score": round(one.pop("score"), 4), "confidence_interval": [low, high], "dimension_scores": one, "n_quality_issues": len(found), "high_severity_issues": sum(x["severity"] == "high" for x in found), "issues": found, "top_recommendations": quality.recommendations(held, severity)[:3], "key_meta_features": held}


@register
class Summary(Component):
    name = "summary"
    needs = ("overview", "missing_values", "exact_duplicates", "near_duplicates", "outliers", "categorical_outliers", "reconstruction", "label_noise", "constraints", "quality")

    def analyze(self, context, **options):
        said = Explainer.shared()
        return summary.dataset_summary({k: v for k, v in context.results.items() if v.get("status") == "done"}, said.dataset if context.config.explain else None)


def ordered(names: list[str]) -> list[str]:
    """Names after those they need."""
    out: list[str] = []

    def put(name: str) -> None:
        for need in REGISTRY[name].needs:
            if need in names and need not in out:
                put(need)
        if name not in out:
            out.append(name)

    for n in names:
        put(n)
    return out


class Analyzer:
    def __init__(self, spark: SparkSession, data, config: Config | None = None, log: Callable[[str], None] | None = None, cancelled: Callable[[], bool] | None = None):
        self.source, self.config = Source.open(spark, data), config or Config()
        self.log, self.cancelled = log or (lambda text: None), cancelled or (lambda: False)
        frame, key = self.source.frame, self.config.key
        if key is None:
            frame, key = saved(with_row_id(frame), "rows"), "row_id"
        self.context = Context(frame, key, self.config)

    def analyze(self) -> Analyzer:
        names = [n for n in self.config.enabled() if n in REGISTRY]
        names += [n for n in REGISTRY if n not in Config.__dataclass_fields__]
        for name in ordered(names):
            if self.cancelled():
                self.log("cancelled")
                break
            self.log(name)
            try:
                self.context.results[name] = REGISTRY[name]().analyze(self.context, **self.config.options.get(name, {})) | {"status": "done"}
            except Skipped as e:
                self.context.results[name] = {"skipped": True, "status": "skipped", "reason": str(e)}
            except Exception as e:  # one operator's failure leaves the others
                self.context.results[name] = {"status": "failed", "reason": f"{type(e).__name__}: {str(e)[:300]}"}
            if self.config.explain and self.context.results[name]["status"] == "done" and name != "summary":
                self.context.results[name]["explanation"] = Explainer.shared().component(name, self.context.results[name])
        return self

    def results(self) -> dict[str, dict]:
        return self.context.results

    def summary(self, name: str) -> dict:
        return self.context.results.get(name, {})

    def table(self, name: str) -> DataFrame:
        return self.context.tables[name]

    def save(self, folder: str, run: str | None = None) -> str:
        """Writes all results and tables as one run of a ResultStore, whose name is returned."""
        return ResultStore(self.context.frame.sparkSession, folder).save(self.context.results, self.context.tables, run)

    def info(self) -> dict:
        return self.source.info()

    def generate_report(self, path: str | None = None) -> str:
        self.written = path or self.config.output_path
        return html.write(self.context.results, self.written, self.config.report_title)

    def open_report(self) -> None:
        import webbrowser

        webbrowser.open(getattr(self, "written", self.config.output_path))
