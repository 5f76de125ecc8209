"""The registered queries of the profiling operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.graph import components
from assay.functions.storage import saved
from assay.operators import anomalies, categorical, constraints, dense_duplicates, duplicates, label_noise, near_duplicates, numeric, profile, quality, sketches, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "1995-06-17 00:00:00"


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else c for c, t in df.dtypes))


def labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
L_NUMBERS = LINEITEM[:8]
O_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def union(parts) -> str:
    return " UNION ALL ".join(parts)


@query("SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def overview_shape(spark, d):
    return profile.shape(table(spark, d, "lineitem"))


@query(union(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_present, count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) / count(*), 5) AS uniqueness_ratio, count(DISTINCT {c}) / count(*) > 0.98 AND count(DISTINCT {c}) > 50 AS potential_identifier, count(DISTINCT {c}) < 20 AS low_cardinality FROM lineitem" for c in LINEITEM))
def overview_cardinality(spark, d):
    return profile.cardinality(table(spark, d, "lineitem"))


@query(union(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, " + ", ".join(f"round(quantile_cont({c}::DOUBLE, {p}), 6) AS p{round(100 * p)}" for p in profile.PERCENTS) + f", max({c})::DOUBLE AS max FROM lineitem" for c in L_NUMBERS))
def overview_describe(spark, d):
    return rounded(profile.describe(table(spark, d, "lineitem")))


@query("SELECT * FROM (VALUES ('bigint', 3::BIGINT), ('double', 4), ('int', 1), ('string', 2), ('timestamp_ntz', 1)) AS t(dtype, n_columns)")
def dtype_distribution(spark, d):
    return profile.dtypes(table(spark, d, "lineitem"))


@query("SELECT 'doc_id' AS \"column\", (8 * count(*))::BIGINT AS bytes FROM documents UNION ALL SELECT 'n_chars', (8 * count(*))::BIGINT FROM documents UNION ALL " + union(f"SELECT '{c}', sum(strlen({c}))::BIGINT FROM documents" for c in ("text", "lang", "source")))
def memory_estimate(spark, d):
    return profile.memory(table(spark, d, "documents"))


def _missing_sql(source: str, names, extra: str = "") -> str:
    return union(f"SELECT '{c}' AS \"column\", {i} AS position, count(*) - count({c}) AS n_missing, round(1 - count({c}) / count(*), 6) AS missing_ratio FROM {source}" for i, c in enumerate(names))


@query(_missing_sql(LABELLED, ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]))
def missing_values(spark, d):
    return rounded(profile.missing(labelled(spark, d)))


@query(f"SELECT \"column\", n_missing, missing_ratio FROM ({_missing_sql(LABELLED, ['doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic'])}) ORDER BY missing_ratio DESC, position LIMIT 3")
def worst_missing(spark, d):
    return rounded(profile.worst_missing(labelled(spark, d)))


@query(f"SELECT \"column\", round(missing_ratio, 4) AS null_ratio FROM ({_missing_sql(LABELLED, ['doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic'])}) WHERE missing_ratio > 0.5")
def high_null_columns(spark, d):
    return profile.high_null(labelled(spark, d))


@query(f"SELECT '0000' || (quality IS NULL)::INT || (toxic IS NULL)::INT AS pattern, count(*) AS n FROM {LABELLED} GROUP BY 1")
def null_patterns(spark, d):
    return profile.null_patterns(labelled(spark, d))


@query(f"WITH m AS (SELECT (quality IS NULL)::INT AS q, (toxic IS NULL)::INT AS t FROM {LABELLED}) SELECT round((avg(q) + avg(t)) / 6, 6) AS missing_cells, round(((avg(q) > 0)::INT + (avg(t) > 0)::INT) / 6, 6) AS columns_with_missing, round(avg((q + t = 0)::INT), 6) AS complete_rows, round(greatest(avg(q), avg(t)), 6) AS worst_column FROM m")
def completeness(spark, d):
    return rounded(profile.completeness(labelled(spark, d)))


@query(f"WITH k AS (SELECT count(*) AS n FROM {LABELLED} GROUP BY quality IS NULL, toxic IS NULL) SELECT round(-sum(n / (SELECT sum(n) FROM k) * ln(n / (SELECT sum(n) FROM k))), 6) AS entropy FROM k")
def missing_pattern_entropy(spark, d):
    return rounded(profile.pattern_entropy(labelled(spark, d)))


def _dup_sql(source: str, names: str) -> str:
    return f"WITH g AS (SELECT count(*) AS n FROM {source} GROUP BY {names}), s AS (SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, count(*) FILTER (n > 1) AS duplicate_groups, count(*) AS k FROM g) SELECT n_rows, duplicate_rows, duplicate_groups, n_rows - duplicate_rows AS unique_rows, round(duplicate_rows / n_rows, 5) AS duplicate_ratio, CASE WHEN duplicate_rows = 0 THEN 'none' WHEN duplicate_rows / n_rows < 0.001 THEN 'low' WHEN duplicate_rows / n_rows < 0.01 THEN 'medium' ELSE 'high' END AS risk_level, round((n_rows - k) / n_rows, 6) AS excess_ratio FROM s"


@query(_dup_sql("documents", "text"))
def exact_dup_summary(spark, d):
    return rounded(duplicates.summary(table(spark, d, "documents"), ["text"]))


@query(_dup_sql("lineitem", "l_orderkey, l_linenumber"))
def exact_dup_summary_keys(spark, d):
    return rounded(duplicates.summary(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("SELECT md5(l_orderkey || '|' || l_linenumber) AS group_hash, count(*) AS n, l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return duplicates.duplicate_groups(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def _shares_sql(parts: dict[str, list[str]]) -> str:
    f = union(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, (SELECT count({c}) FROM {t}) AS n_present FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cs in parts.items() for c in cs)
    return f"SELECT *, n / n_present AS share, least(0.01, greatest(0.001, 5 / n_present)) AS threshold FROM ({f}) f WHERE (SELECT count(*) FROM ({f}) g WHERE g.\"column\" = f.\"column\") <= 0.8 * n_present"


CONVERSATIONS = {"conversations": ["role", "text"]}
PLANTED = "(SELECT event_id, event_type FROM events UNION ALL SELECT * FROM (VALUES (-1, 'clik'), (-2, 'veiw'), (-3, 'clik')) v(event_id, event_type))"


def planted_events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type").union(spark.createDataFrame([(-1, "clik"), (-2, "veiw"), (-3, "clik")], "event_id long, event_type string"))


@query(f"SELECT \"column\", value, n, n_present, round(share, 6) AS share, round(threshold, 6) AS threshold, share < threshold AS rare FROM ({_shares_sql({PLANTED: ['event_type']})})")
def categorical_shares(spark, d):
    return rounded(categorical.shares(planted_events(spark, d), ["event_type"]))


@query(f"SELECT \"column\", value, n, round(share, 9) AS share FROM ({_shares_sql({PLANTED: ['event_type']})}) WHERE share < threshold")
def categorical_rare(spark, d):
    return categorical.rare_values(planted_events(spark, d), ["event_type"])


@query(f"SELECT count(DISTINCT \"column\") AS n_columns, round(sum(n) FILTER (share < threshold) / (SELECT count(*) FROM {PLANTED}) / count(DISTINCT \"column\"), 5) AS outlier_ratio FROM ({_shares_sql({PLANTED: ['event_type']})})")
def categorical_outlier_ratio(spark, d):
    return categorical.outlier_ratio(planted_events(spark, d), ["event_type"])


@query(f"WITH r AS (SELECT * FROM ({_shares_sql({PLANTED: ['event_type']})}) WHERE share < threshold), k AS (SELECT r.\"column\", e.event_id AS row, r.value, round(r.share, 9) AS share, row_number() OVER (ORDER BY r.share, e.event_id) AS k FROM {PLANTED} e JOIN r ON e.event_type = r.value) SELECT \"column\", row, value, share FROM k WHERE k <= 5")
def categorical_examples(spark, d):
    return categorical.rare_examples(planted_events(spark, d), ["event_type"], "event_id")


@query("SELECT 'text' AS \"column\", count(DISTINCT text) AS n_unique, round(count(DISTINCT text) / count(text), 4) AS unique_ratio FROM documents HAVING count(DISTINCT text) > 0.8 * count(text)")
def categorical_skipped(spark, d):
    return categorical.skipped(table(spark, d, "documents"), ["text", "lang", "source"])


def _chi_sql(source: str, a: str, b: str) -> str:
    return f"WITH c AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {source} GROUP BY ALL), x AS (SELECT x, sum(n) AS nx FROM c GROUP BY x), y AS (SELECT y, sum(n) AS ny FROM c GROUP BY y), t AS (SELECT sum(n) AS t, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof FROM c), g AS (SELECT nx * ny / t AS e, abs(coalesce(n, 0) - nx * ny / t) AS gap, dof FROM x CROSS JOIN y CROSS JOIN t LEFT JOIN c ON c.x = x.x AND c.y = y.y) SELECT '{a}' AS a, '{b}' AS b, round(sum(CASE WHEN dof = 1 THEN gap - least(0.5, gap) ELSE gap END ** 2 / e), 6) AS chi_square, any_value(dof)::BIGINT AS dof FROM g"


@query(_chi_sql("lineitem", "l_returnflag", "l_linestatus"))
def chi_square_pairs(spark, d):
    return rounded(categorical.chi_square(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query("WITH k AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1) SELECT count(*) AS n_classes, round(max(n) / (min(n) + 1e-10), 6) AS imbalance, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*) + 1e-10), 6) AS class_entropy FROM k")
def class_balance(spark, d):
    return rounded(categorical.class_balance(table(spark, d, "labels"), "toxic"))


def _iqr_sql(source: str, names) -> str:
    return union(f"SELECT '{c}' AS \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3, count({c}) AS n, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers, round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 6) AS outlier_ratio FROM {source}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}) GROUP BY q1, q3" for c in names)


@query(_iqr_sql("lineitem", L_NUMBERS))
def iqr_outliers(spark, d):
    return rounded(numeric.iqr_outliers(table(spark, d, "lineitem")))


@query(_iqr_sql("events", ["value"]))
def iqr_outliers_events(spark, d):
    return rounded(numeric.iqr_outliers(table(spark, d, "events"), ["value"]))


@query(union(f"SELECT '{c}' AS \"column\", round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS kurtosis FROM orders" for c in O_NUMBERS))
def skew_kurt(spark, d):
    return rounded(numeric.skew_kurtosis(table(spark, d, "orders")), 5)


@query("SELECT round(stddev_samp(v) / (avg(v) + 1e-10), 6) AS variance_cv FROM (" + union(f"SELECT var_samp({c}) AS v FROM orders" for c in O_NUMBERS) + ")")
def variance_cv(spark, d):
    return rounded(numeric.variance_variation(table(spark, d, "orders")))


@query(union(f"SELECT '{c}' AS \"column\", 10 AS bins, round(ln(sum(k)) - sum(k * ln(k)) / sum(k), 6) AS entropy FROM (SELECT least(floor(({c}::DOUBLE - lo) / (hi - lo) * 10) + 1, 10) AS bin, count(*) AS k FROM orders, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM orders) GROUP BY 1)" for c in O_NUMBERS))
def hist_entropy(spark, d):
    return rounded(numeric.histogram_entropy(table(spark, d, "orders")))


PAIRS = [(a, b) for i, a in enumerate(L_NUMBERS) for b in L_NUMBERS[i + 1 :]]


@query(union(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS))
def correlation_matrix(spark, d):
    return rounded(numeric.correlations(table(spark, d, "lineitem")))


@query("SELECT round(avg((r > 0.9)::INT), 6) AS redundancy_ratio, round(avg(r), 6) AS mean_abs_r, round(stddev_pop(r), 6) AS std_abs_r FROM (" + union(f"SELECT abs(corr({a}, {b})) AS r FROM lineitem" for a, b in PAIRS) + ")")
def redundancy(spark, d):
    return rounded(numeric.redundancy(table(spark, d, "lineitem")))


@query("SELECT 'o_orderkey' AS \"column\", count(DISTINCT o_orderkey) AS n_unique, round(count(DISTINCT o_orderkey) / count(*), 4) AS unique_ratio FROM orders UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), round(count(DISTINCT o_totalprice) / count(*), 4) FROM orders HAVING count(DISTINCT o_totalprice) > 0.85 * count(*)")
def high_cardinality_filter(spark, d):
    return profile.high_cardinality(table(spark, d, "orders"), O_NUMBERS, 0.85, 50)


@query("SELECT o_orderkey, round((o_totalprice - a) / s, 6) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders)")
def standardise(spark, d):
    return rounded(numeric.standardised(table(spark, d, "orders"), ["o_totalprice"], keep=["o_orderkey"]))


@query(f"WITH f AS (SELECT doc_id, coalesce(quality, (SELECT median(quality) FROM labels))::DOUBLE AS q FROM {LABELLED}) SELECT doc_id, round((q - (SELECT avg(q) FROM f)) / (SELECT stddev_pop(q) FROM f), 6) AS quality FROM f")
def median_impute(spark, d):
    return rounded(numeric.standardised(labelled(spark, d), ["quality"], "median", ["doc_id"]))


Z = ["o_custkey", "o_totalprice"]


@query("WITH z AS (SELECT o_orderkey, abs((o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_pop(o_custkey) FROM orders)) AS a, abs((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)) AS b FROM orders) SELECT o_orderkey, round(greatest(a, b), 6) AS score, CASE WHEN round(b, 4) > round(a, 4) THEN 'o_totalprice' ELSE 'o_custkey' END AS feature, round(greatest(a, b), 4) AS deviation FROM z")
def zscore_explanations(spark, d):
    own = numeric.deviations(table(spark, d, "orders"), ["o_orderkey"], Z, 1)
    return rounded(own.select("o_orderkey", "score", F.col("features")[0]["feature"].alias("feature"), F.col("features")[0]["deviation"].alias("deviation")))


@query("SELECT 'o_orderkey' AS \"column\", count(DISTINCT o_orderkey) AS n_unique FROM orders HAVING count(DISTINCT o_orderkey) = count(*)" + "".join(f" UNION ALL SELECT '{c}', count(DISTINCT {c}) FROM orders HAVING count(DISTINCT {c}) = count(*)" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def unique_columns(spark, d):
    return constraints.unique_columns(table(spark, d, "orders"))


def _check(check, kind, columns, severity, n, rows, ratio=None):
    return f"SELECT '{check}' AS \"check\", '{kind}' AS constraint_type, '{columns}' AS columns, {severity} AS severity, ({n})::BIGINT AS n_violations, ({rows})::BIGINT AS n_rows, round({ratio or f'({n}) / ({rows})'}, 6) AS violation_ratio, 'checked' AS status, NULL::VARCHAR AS reason"


@query(union(_check("unique", "uniqueness", c, "'HIGH'", f"SELECT coalesce(sum(n) FILTER (n > 1), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})", "SELECT count(*) FROM lineitem") for c in ("l_orderkey", "l_linenumber")))
def uniqueness_violation(spark, d):
    return rounded(constraints.uniqueness(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("SELECT l_orderkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 5")
def uniqueness_examples(spark, d):
    return constraints.uniqueness_examples(table(spark, d, "lineitem"), "l_orderkey")


@query(union(_check("not_null", "not_null", c, f"CASE WHEN (SELECT 1 - count({c}) / count(*) FROM {LABELLED}) > 0.1 THEN 'HIGH' ELSE 'MEDIUM' END", f"SELECT count(*) - count({c}) FROM {LABELLED}", f"SELECT count(*) FROM {LABELLED}") for c in ("lang", "quality")))
def not_null_violation(spark, d):
    return rounded(constraints.not_null(labelled(spark, d), ["lang", "quality"]))


@query(_check("domain", "value_domain", "o_orderstatus", "'MEDIUM'", "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", "SELECT count(*) FROM orders"))
def value_domain_violation(spark, d):
    return rounded(constraints.domain(table(spark, d, "orders"), {"o_orderstatus": ["F", "O"]}))


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1")
def value_domain_values(spark, d):
    return constraints.domain_values(table(spark, d, "orders"), "o_orderstatus", ["F", "O"])


@query("WITH f AS (SELECT p_name AS value, count(*) AS n FROM (SELECT p_name FROM part UNION ALL SELECT 'odd nmae') GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM f), r AS (SELECT value, n FROM f, t WHERE n <= greatest(1, 0.001 * total)) SELECT 'p_name' AS \"column\", value, n FROM r WHERE (SELECT count(*) FROM r) < 0.1 * (SELECT k FROM t) ORDER BY n, value LIMIT 10")
def rare_value_typos(spark, d):
    return constraints.rare_values(table(spark, d, "part").select("p_name").union(spark.createDataFrame([("odd nmae",)], "p_name string")))


@query(union([_check("pattern", "pattern", "url", "'MEDIUM'", "SELECT count(*) FROM pages WHERE NOT regexp_matches(url, '^(?:https://)')", "SELECT count(*) FROM pages"), "SELECT 'pattern', 'pattern', 'html', 'INFO', 0, 0, 0.0, 'failed', 'bad pattern'"]))
def pattern_match(spark, d):
    own = rounded(constraints.patterns(table(spark, d, "pages"), {"url": "https://", "html": "(["}))
    return own.withColumn("reason", F.when(F.col("reason").startswith("bad pattern"), "bad pattern"))


@query("SELECT 'url' AS \"column\", 'url' AS pattern, round(avg(regexp_matches(url, '(?i)^https?://[^\\s]+$')::INT), 4) AS matching_ratio FROM pages")
def pattern_detect(spark, d):
    return constraints.detected_patterns(table(spark, d, "pages"), names=["url"])


CNR = "(SELECT c.*, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN 'ELSEWHERE' ELSE n_name END AS n_name, r_name FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
FD = ["c_nationkey", "n_name", "r_name", "c_mktsegment"]


def places(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    first = c.agg(F.min("c_custkey").alias("least"))
    both = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(F.broadcast(first))  # 25 and 5 rows
    return both.withColumn("n_name", F.when(F.col("c_custkey") == F.col("least"), "ELSEWHERE").otherwise(F.col("n_name"))).select("c_nationkey", "n_name", "r_name", "c_mktsegment")


def _fd_sql(dets, least: float) -> str:
    rows = union(f"SELECT '{','.join(det)}' AS determinant, '{dep}' AS dependent, count(*) AS n_groups, count(*) FILTER (k > 1) AS n_broken, round(1 - count(*) FILTER (k > 1) / count(*), 6) AS confidence FROM (SELECT count(DISTINCT {dep}) AS k FROM {CNR} GROUP BY {', '.join(det)})" for det, dep in dets)
    return f"SELECT * FROM ({rows}) WHERE confidence >= {least}"


@query(_fd_sql([((a,), b) for a in FD for b in FD if a != b], 0.95))
def fd_single(spark, d):
    return rounded(constraints.dependencies(places(spark, d), FD))


@query(_fd_sql([((a, b), c) for i, a in enumerate(FD) for b in FD[i + 1 :] for c in FD if c not in (a, b)], 0.5))
def fd_pair(spark, d):
    return rounded(constraints.dependencies(places(spark, d), FD, 2, 0.5))


@query("WITH v AS (SELECT DISTINCT l_orderkey::VARCHAR AS determinant, l_returnflag AS value FROM lineitem), b AS (SELECT determinant, count(*) AS n_values FROM v GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 3) SELECT b.determinant, b.n_values, string_agg(value, '|' ORDER BY value) AS examples FROM b JOIN v ON b.determinant = v.determinant GROUP BY ALL")
def fd_examples(spark, d):
    return constraints.dependency_examples(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query(f"SELECT 'functional_dependency' AS \"check\", 'functional_dependency' AS constraint_type, determinant || ',' || dependent AS columns, CASE WHEN confidence > 0.99 THEN 'LOW' ELSE 'MEDIUM' END AS severity, n_broken AS n_violations, n_groups AS n_rows, round(1 - confidence, 6) AS violation_ratio, 'checked' AS status, NULL::VARCHAR AS reason FROM ({_fd_sql([((a,), b) for a in FD for b in FD if a != b], 0.95)}) WHERE n_broken > 0")
def fd_violations(spark, d):
    return rounded(constraints.dependency_violations(constraints.dependencies(places(spark, d), FD)))


@query(f"SELECT 'o_orderdate' AS \"column\", min(o_orderdate)::TIMESTAMP AS earliest, max(o_orderdate)::TIMESTAMP AS latest, count(*) - count(o_orderdate) AS n_null, count(*) FILTER (o_orderdate > TIMESTAMP '{NOW}') AS n_future FROM orders")
def temporal_stats(spark, d):
    return constraints.temporal_stats(table(spark, d, "orders"), ["o_orderdate"], NOW)


@query(_check("future_date", "temporal", "o_orderdate", "'LOW'", f"SELECT count(*) FROM orders WHERE o_orderdate > TIMESTAMP '{NOW}'", "SELECT count(*) FROM orders"))
def future_dates(spark, d):
    return rounded(constraints.future_dates(table(spark, d, "orders"), ["o_orderdate"], NOW))


SHIPPED = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def shipped(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query(_check("date_order", "temporal", "o_orderdate,l_shipdate", "'HIGH'", f"SELECT count(*) FROM {SHIPPED} WHERE o_orderdate > l_shipdate", f"SELECT count(*) FROM {SHIPPED}"))
def date_order(spark, d):
    return rounded(constraints.date_order(shipped(spark, d).select("o_orderdate", "l_shipdate")))


@query(union([_check("comparison", "cross_column", "l_tax,l_discount", "'HIGH'", "SELECT count(*) FROM lineitem WHERE NOT l_tax <= l_discount", "SELECT count(*) FROM lineitem"), "SELECT 'comparison', 'cross_column', 'l_tax,absent', 'INFO', 0, 0, 0.0, 'failed', 'no column absent'"]))
def comparison_rule(spark, d):
    own = table(spark, d, "lineitem")
    return rounded(constraints.rule(own, {"type": "comparison", "columns": ["l_tax", "l_discount"], "operator": "<="}).union(constraints.rule(own, {"type": "comparison", "columns": ["l_tax", "absent"], "operator": "<="})))


@query(_check("sum", "cross_column", "l_tax,l_discount,l_quantity", "'HIGH'", "SELECT count(*) FROM lineitem WHERE abs(0.0 + l_tax + l_discount - l_quantity) > 0.9 * greatest(abs(l_quantity), 1.0)", "SELECT count(*) FROM lineitem"))
def sum_rule(spark, d):
    return rounded(constraints.rule(table(spark, d, "lineitem"), {"type": "sum", "columns": ["l_tax", "l_discount"], "total_column": "l_quantity", "tolerance": 0.9}))


@query(union(_check("non_negative", "range", c, "'MEDIUM'", f"SELECT count(*) FROM (SELECT c_acctbal AS account_amount, c_acctbal / 100 AS return_rate FROM customer) WHERE {c} < 0", "SELECT count(*) FROM customer") for c in ("account_amount",)))
def nonnegative_check(spark, d):
    own = table(spark, d, "customer")
    return rounded(constraints.non_negative(own.select(F.col("c_acctbal").alias("account_amount"), (F.col("c_acctbal") / 100).alias("return_rate"))))


@query(_check("range", "range", "return_rate", "'MEDIUM'", "SELECT count(*) FROM customer WHERE c_acctbal / 100 < 0 OR c_acctbal / 100 > 1", "SELECT count(*) FROM customer") + " UNION ALL " + _check("range", "range", "share_percent", "'MEDIUM'", "SELECT count(*) FROM customer WHERE c_acctbal / 50 < 0 OR c_acctbal / 50 > 100", "SELECT count(*) FROM customer"))
def range_check(spark, d):
    own = table(spark, d, "customer")
    return rounded(constraints.ranges(own.select((F.col("c_acctbal") / 100).alias("return_rate"), (F.col("c_acctbal") / 50).alias("share_percent"))))


@query(_check("foreign_key", "referential_integrity", "l_partkey", "'CRITICAL'", "SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)", "SELECT count(*) FROM lineitem"))
def foreign_key(spark, d):
    return rounded(constraints.foreign_key(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part"), "p_partkey"))


VIOLATIONS = union([ORACLES["date_order"], ORACLES["range_check"], ORACLES["not_null_violation"], ORACLES["future_dates"]])


def violations(spark, d):
    return numeric.union_all([date_order(spark, d), range_check(spark, d), not_null_violation(spark, d), future_dates(spark, d)])


@query(f"WITH v AS (SELECT * FROM ({VIOLATIONS}) WHERE n_violations > 0), s AS (SELECT count(*) AS total_violations, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info, 1 - least(1, sum(violation_ratio * CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.5 WHEN 'LOW' THEN 0.2 ELSE 0.1 END)) AS score FROM v) SELECT round(score, 6) AS consistency_score, total_violations, critical, high, medium, low, info, CASE WHEN total_violations = 0 THEN 'none' WHEN critical > 0 OR score < 0.5 THEN 'critical' WHEN high > 2 OR score < 0.7 THEN 'high' WHEN score < 0.85 THEN 'medium' ELSE 'low' END AS risk_level FROM s")
def consistency_score(spark, d):
    return constraints.consistency(violations(spark, d))


@query(f"SELECT \"column\", round(greatest(0, 1 - sum(0.5 * violation_ratio)), 4) AS score FROM (SELECT unnest(string_split(columns, ',')) AS \"column\", violation_ratio FROM ({VIOLATIONS}) WHERE n_violations > 0) GROUP BY 1")
def column_scores(spark, d):
    return constraints.column_scores(violations(spark, d))


@query(f"SELECT severity, count(*) AS n FROM ({VIOLATIONS}) WHERE n_violations > 0 GROUP BY 1")
def violations_by_severity(spark, d):
    return constraints.by_severity(violations(spark, d))


S_TEXT = "s_name"
TOKENS = "(SELECT s_suppkey, list_distinct(list_concat(list_transform(range(1, length(v) + 3), lambda i: 's_name:' || substr('__' || v || '__', i::BIGINT, 3)), CASE WHEN length(v) > 10 THEN list_transform(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: length(w) > 2), lambda w: 's_name:word:' || w) ELSE []::VARCHAR[] END)) AS tokens FROM (SELECT s_suppkey, lower(trim(s_name)) AS v FROM supplier))"


@query(f"SELECT s_suppkey, len(tokens)::INT AS n_tokens, array_to_string(list_sort(tokens), ' ') AS tokens FROM {TOKENS}")
def row_tokens(spark, d):
    own = table(spark, d, "supplier")
    tokens = near_duplicates.row_tokens(own, [S_TEXT])
    return own.select("s_suppkey", F.size(tokens).alias("n_tokens"), F.array_join(F.sort_array(tokens), " ").alias("tokens"))


@query(f"WITH h AS (SELECT s_suppkey, list_transform(tokens, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT) AS h FROM {TOKENS}) SELECT s_suppkey, k.k::INT AS k, list_min(list_transform(h, lambda x: ((k.k + 1) * 7919003 % 536870912 * 2 + 1) * x + (k.k + 1) * 104395301 % 4294967311)) IS NOT NULL AS made, list_min(list_transform(h, lambda x: (((k.k + 1) * 7919003 % 536870912 * 2 + 1) * x + (k.k + 1) * 104395301 % 4294967311) % 4294967311))::BIGINT AS value FROM h, range(128) k(k)")
def minhash_signature(spark, d):
    own = table(spark, d, "supplier")
    signed = own.select("s_suppkey", near_duplicates.signatures(near_duplicates.token_hashes(near_duplicates.row_tokens(own, [S_TEXT]))).alias("sig"))
    return signed.select("s_suppkey", F.posexplode("sig").alias("k", "value")).withColumn("made", F.lit(True))


def tokens_sql(name: str, key: str, columns: list[str]) -> str:
    """(key, tokens) of a table's rows, over several columns."""
    parts = []
    for c in columns:
        v = f"lower(trim({c}::VARCHAR))"
        grams = f"list_transform(range(1, length({v}) + 3), lambda i: '{c}:' || substr('__' || {v} || '__', i::BIGINT, 3))"
        words = f"CASE WHEN length({v}) > 10 THEN list_transform(list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: length(w) > 2), lambda w: '{c}:word:' || w) ELSE []::VARCHAR[] END"
        parts.append(f"CASE WHEN {c} IS NULL THEN ['{c}:__NULL__'] WHEN {v} = '' THEN ['{c}:__EMPTY__'] ELSE list_concat({grams}, {words}) END")
    return f"(SELECT {key} AS key, list_distinct(flatten([{', '.join(parts)}])) AS tokens FROM {name})"


def text_similarity_sql(c: str) -> str:
    grams = lambda v: f"list_distinct(CASE WHEN length({v}) >= 3 THEN list_transform(range(1, length({v}) - 1), lambda i: substr({v}, i::BIGINT, 3)) ELSE [{v}] END)"
    x, y = grams(f"lower(trim(x.{c}))"), grams(f"lower(trim(y.{c}))")
    return f"CASE WHEN x.{c} IS NULL AND y.{c} IS NULL THEN 1.0 WHEN x.{c} IS NULL OR y.{c} IS NULL THEN 0.0 WHEN x.{c} = y.{c} THEN 1.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END::DOUBLE"


def number_similarity_sql(c: str) -> str:
    far = f"coalesce(abs(x.{c}::DOUBLE - y.{c}::DOUBLE) / nullif(greatest(abs(x.{c}::DOUBLE), abs(y.{c}::DOUBLE)), 0), 0.0)"
    return f"CASE WHEN x.{c} IS NULL AND y.{c} IS NULL THEN 1.0 WHEN x.{c} IS NULL OR y.{c} IS NULL THEN 0.0 WHEN x.{c} = y.{c} THEN 1.0 ELSE 1 - least({far}, 1.0) END::DOUBLE"


P_TEXTS, P_NUMBERS = ["p_name", "p_brand", "p_type"], ["p_size", "p_retailprice"]
P_COLUMNS = P_TEXTS + P_NUMBERS
_ROW = f"md5(concat_ws('|', {', '.join(f'coalesce({c}::VARCHAR, chr(1))' for c in P_COLUMNS)}))"
LSH = f"""WITH firsts AS (SELECT {_ROW} AS mark, min(p_partkey) AS first FROM part GROUP BY 1),
copies AS (SELECT first AS a, p_partkey AS b, 1.0::DOUBLE AS estimate FROM part JOIN firsts ON mark = {_ROW} WHERE p_partkey <> first),
h AS (SELECT key, list_transform(tokens, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT) AS h FROM {tokens_sql("part", "p_partkey", P_COLUMNS)} WHERE key IN (SELECT first FROM firsts)),
sigs AS MATERIALIZED (SELECT key, list_transform(range(128), lambda k: list_min(list_transform(h, lambda x: (((k + 1) * 7919003 % 536870912 * 2 + 1) * x + (k + 1) * 104395301 % 4294967311) % 4294967311))) AS sig FROM h),
banded AS MATERIALIZED (SELECT key, band, sig[band * 4 + 1 : band * 4 + 4] AS slice FROM sigs, range(32) r(band)),
met AS (SELECT DISTINCT o.key AS a, t.key AS b FROM banded o JOIN banded t ON o.band = t.band AND o.slice = t.slice AND o.key < t.key),
agreed AS (SELECT a, b, len(list_filter(range(1, 129), lambda i: o.sig[i] = t.sig[i])) / 128 AS estimate FROM met JOIN sigs o ON o.key = a JOIN sigs t ON t.key = b),
lsh AS (SELECT * FROM agreed WHERE estimate >= 0.8 * 0.8 UNION ALL SELECT * FROM copies)"""
_LISTED = lambda test: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN s{i} {test} THEN '{c}' END" for i, c in enumerate(P_COLUMNS)) + "], lambda z: z IS NOT NULL), '|')"
NEAR_PAIRS = f"""{LSH}, sims AS (SELECT a, b, {", ".join(f"{(text_similarity_sql if c in P_TEXTS else number_similarity_sql)(c)} AS s{i}" for i, c in enumerate(P_COLUMNS))} FROM lsh JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b),
near AS (SELECT a, b, (0.0 + s0 + s1 + s2 + s3 + s4) / 5 AS exact, {_LISTED(">= 0.99")} AS matching, {_LISTED("< 0.5")} AS differing FROM sims WHERE (0.0 + s0 + s1 + s2 + s3 + s4) / 5 >= 0.8),
pairs AS (SELECT a, b, round(exact, 4) AS similarity, matching, differing FROM near)"""
NEAR_CLUSTERS = NEAR_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), n AS (SELECT DISTINCT a FROM e),
reach(node, low) USING KEY (node) AS (SELECT a, a FROM n UNION SELECT e.b, min(reach.low) FROM reach JOIN e ON reach.node = e.a JOIN recurring.reach AS now ON now.node = e.b WHERE reach.low < now.low GROUP BY e.b),
held AS (SELECT node, low AS cluster FROM reach),
clusters AS (SELECT cluster, size, n_pairs, mean_similarity FROM (SELECT cluster, count(*) AS size FROM held GROUP BY 1) JOIN (SELECT cluster, count(*) AS n_pairs, round(avg(similarity), 4) AS mean_similarity FROM pairs JOIN held ON a = node GROUP BY 1) USING (cluster))"""


@query(f"{LSH} SELECT a, b, round(estimate, 6) AS estimate FROM lsh")
def lsh_candidates(spark, d):
    return rounded(near_duplicates.candidates(table(spark, d, "part"), "p_partkey", P_COLUMNS))


@query(f"{NEAR_PAIRS} SELECT * FROM pairs")
def near_dup_pairs(spark, d):
    return near_duplicates.pairs(table(spark, d, "part"), "p_partkey", P_COLUMNS)


@query(f"{NEAR_CLUSTERS} SELECT * FROM clusters")
def near_dup_clusters(spark, d):
    return near_duplicates.clusters(saved(near_dup_pairs(spark, d), "pairs"))


@query(f"{NEAR_CLUSTERS}, told AS (SELECT (SELECT count(*) FROM pairs) AS total_pairs, (SELECT count(*) FROM held) AS affected_rows, (SELECT count(*) FROM held) / (SELECT count(*) FROM part) AS ratio, (SELECT count(*) FROM clusters) AS cluster_count) SELECT total_pairs, affected_rows, round(ratio, 5) AS near_duplicate_ratio, cluster_count, CASE WHEN ratio = 0 THEN 'none' WHEN ratio < 0.005 THEN 'low' WHEN ratio < 0.02 THEN 'medium' ELSE 'high' END AS risk_level FROM told")
def near_dup_summary(spark, d):
    return near_duplicates.summary(table(spark, d, "part"), saved(near_dup_pairs(spark, d), "pairs"))


@query(f"{NEAR_PAIRS} " + union(f"SELECT '{c}' AS \"column\", coalesce(round(avg(list_contains(string_split(matching, '|'), '{c}')::INT), 4), 0.0) AS contribution FROM pairs" for c in P_COLUMNS))
def column_contribution(spark, d):
    return near_duplicates.contributions(near_dup_pairs(spark, d), P_COLUMNS)


LINKS = "(SELECT DISTINCT l_orderkey AS a, -l_suppkey AS b FROM lineitem)"


@query(f"WITH RECURSIVE l AS MATERIALIZED {LINKS}, e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), n AS (SELECT DISTINCT a FROM e), reach(node, low) USING KEY (node) AS (SELECT a, a FROM n UNION SELECT e.b, min(reach.low) FROM reach JOIN e ON reach.node = e.a JOIN recurring.reach AS now ON now.node = e.b WHERE reach.low < now.low GROUP BY e.b) SELECT node, low AS component FROM reach")
def connected_components(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (-F.col("l_suppkey")).alias("b"))
    return components(links, "a", "b")


META = {"missing_cells": 0.2, "duplicate_ratio": 0.01, "near_duplicate_ratio": 0.02, "redundancy_ratio": 0.15, "noise_ratio": 0.05, "outlier_ratio": 0.1, "mean_abs_skewness": 2.0, "mean_abs_kurtosis": 1.0}


@query("WITH m AS (SELECT avg((quality IS NULL)::INT + (toxic IS NULL)::INT) / 6 AS missing_cells FROM " + LABELLED + ") SELECT round(greatest(0, 1 - 2 * missing_cells), 6) AS completeness, round(1 - (3 * 0.01 + 2 * 0.02 + 2 * 0.05), 6) AS consistency, round(1 - 2 * 0.05 - 0.5 * 0.1, 6) AS accuracy, round(1 - 5 * 0.01, 6) AS uniqueness, round(1 - 0.3 - 0.1, 6) AS validity, round(0.25 * greatest(0, 1 - 2 * missing_cells) + 0.2 * (1 - (3 * 0.01 + 2 * 0.02 + 2 * 0.05)) + 0.3 * (1 - 2 * 0.05 - 0.5 * 0.1) + 0.15 * 0.95 + 0.1 * 0.6, 6) AS score FROM m")
def composite_dimension_scores(spark, d):
    meta = profile.completeness(labelled(spark, d)).select("missing_cells", *(F.lit(v).alias(k) for k, v in META.items() if k != "missing_cells"))
    return rounded(quality.dimension_scores(meta).withColumn("score", quality.composite()))


@query()
def meta_features(spark, d):
    return rounded(quality.meta_features(table(spark, d, "orders"), "o_orderstatus"))


O_GAPS = " + ".join(f"({c} IS NULL)::INT" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
_OUT = " + ".join(f"coalesce(o{i}, 0)" for i in range(3))
BOOTSTRAP = f"""WITH numbered AS MATERIALIZED (SELECT *, ({O_GAPS}) / 6 AS gaps, row_number() OVER (ORDER BY ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 2))::INT, o_orderkey) - 1 AS place FROM orders),
size AS (SELECT count(*) AS n FROM orders),
draws AS (SELECT r.replicate, ('0x' || substr(md5(r.replicate::VARCHAR || '|' || d.draw::VARCHAR || '|42'), 1, 13))::BIGINT % n AS place FROM range(30) r(replicate), range(500) d(draw), size WHERE d.draw < n),
drawn AS MATERIALIZED (SELECT replicate, place, gaps, o_orderkey::DOUBLE AS x0, o_custkey::DOUBLE AS x1, o_totalprice::DOUBLE AS x2 FROM draws JOIN numbered USING (place)),
fences AS (SELECT replicate, count(*) AS n, count(DISTINCT place) AS different, avg(gaps) AS missing, {", ".join(f"quantile_cont(x{i}, 0.25) AS l{i}, quantile_cont(x{i}, 0.75) AS h{i}" for i in range(3))} FROM drawn GROUP BY replicate),
told AS (SELECT replicate, any_value(n) AS n, any_value(different) AS different, any_value(missing) AS missing, {", ".join(f"avg(CASE WHEN h{i} > l{i} THEN (x{i} < l{i} - 1.5 * (h{i} - l{i}) OR x{i} > h{i} + 1.5 * (h{i} - l{i}))::INT END) AS o{i}" for i in range(3))} FROM drawn JOIN fences f USING (replicate) GROUP BY replicate),
parts AS (SELECT greatest(0, 1 - 2 * missing) AS completeness, 1 - different / n AS repeated, CASE WHEN coalesce(o0, o1, o2) IS NULL THEN 0 ELSE ({_OUT}) / ((o0 IS NOT NULL)::INT + (o1 IS NOT NULL)::INT + (o2 IS NOT NULL)::INT) END AS outliers FROM told),
scores AS (SELECT greatest(0, least(1, 0.25 * completeness + 0.2 * greatest(0, 1 - 3 * repeated) + 0.3 * greatest(0, 1 - 0.5 * outliers) + 0.15 * greatest(0, 1 - 5 * repeated) + 0.1)) AS score FROM parts)
SELECT round(quantile_cont(score, 0.025), 6) AS low, round(quantile_cont(score, 0.975), 6) AS high FROM scores"""


@query(BOOTSTRAP)
def bootstrap_ci(spark, d):
    return rounded(quality.interval(quality.bootstrap(table(spark, d, "orders"), "o_orderkey")))


P1 = "(0.05 + 0.9 * ((d.n_chars * 7 + d.doc_id * 13) % 101) / 100.0)"
PROBS = f"(SELECT d.doc_id AS key, l.toxic AS label, CASE WHEN l.toxic = 1 THEN greatest({P1}, 0.3) ELSE {P1} * 0.8 END AS p1 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
CONFIDENT = f"(SELECT *, CASE WHEN p1 >= t1 AND 1 - p1 >= t0 THEN (p1 > 1 - p1)::INT WHEN p1 >= t1 THEN 1 WHEN 1 - p1 >= t0 THEN 0 ELSE (p1 > 1 - p1)::INT END AS pred FROM {PROBS}, (SELECT avg(p1) FILTER (label = 1) AS t1, avg(1 - p1) FILTER (label = 0) AS t0 FROM {PROBS}))"
NOISE = f"(SELECT key, label, CASE label WHEN 1 THEN (1 - p1) - p1 + (1 - p1) ELSE p1 - (1 - p1) + p1 END AS score FROM {PROBS})"
JOINT = f"(SELECT g.label, g.pred, count(c.key) AS n FROM (SELECT * FROM (VALUES (0), (1)) a(label), (VALUES (0), (1)) b(pred)) g LEFT JOIN {CONFIDENT} c ON c.label = g.label AND c.pred = g.pred GROUP BY ALL)"


def probabilities(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    x = 0.05 + 0.9 * ((F.col("n_chars") * 7 + F.col("doc_id") * 13) % 101) / 100.0
    p1 = F.when(F.col("toxic") == 1, F.greatest(x, F.lit(0.3))).otherwise(x * 0.8)
    return both.select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"), F.array(1 - p1, p1).alias("p"))


@query(f"SELECT label, round(avg(CASE label WHEN 1 THEN p1 ELSE 1 - p1 END), 6) AS threshold FROM {PROBS} GROUP BY label")
def cl_thresholds(spark, d):
    return rounded(label_noise.thresholds(probabilities(spark, d)))


@query(f"SELECT label, pred, n FROM {JOINT}")
def cl_confident_joint(spark, d):
    return label_noise.confident_joint(probabilities(spark, d), 2)


@query(f"SELECT key, label, round(score, 6) AS score, score > 0.5 AS flagged FROM {NOISE}")
def cl_noise_scores(spark, d):
    return rounded(label_noise.noise_scores(probabilities(spark, d)))


@query(f"SELECT pred, label, round(n / greatest(sum(n) OVER (PARTITION BY pred), 1), 6) AS t FROM {JOINT}")
def cl_transition(spark, d):
    return rounded(label_noise.transition(label_noise.confident_joint(probabilities(spark, d), 2)))


@query(f"SELECT label, pred, round(n / sum(n) OVER (), 6) AS share FROM {JOINT}")
def cl_joint_distribution(spark, d):
    return rounded(label_noise.joint_distribution(label_noise.confident_joint(probabilities(spark, d), 2)))


@query(f"SELECT label, count(*) AS n, round(avg((score > 0.5)::INT), 6) AS noise_rate FROM {NOISE} GROUP BY label")
def cl_class_noise(spark, d):
    return rounded(label_noise.class_noise(probabilities(spark, d)))


@query("WITH v AS (SELECT l_linenumber % 2 AS a, (l_quantity::INT) % 2 AS b, l_suppkey % 2 AS c FROM lineitem) SELECT round(avg(CASE WHEN a = b AND b = c THEN 1.0 ELSE 2 / 3 END), 6) AS agreement FROM v")
def cl_agreement(spark, d):
    votes = table(spark, d, "lineitem").select(F.array((F.col("l_linenumber") % 2).cast("long"), (F.col("l_quantity").cast("int") % 2).cast("long"), F.col("l_suppkey") % 2).alias("votes"))
    return rounded(label_noise.agreement(votes))


@query()
def label_noise_ensemble(spark, d):
    own = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("half", F.length("text") / 2)
    probs, *_ = label_noise.out_of_fold(own, "doc_id", "toxic", ["n_chars", "half", "quality"])
    return label_noise.noise_scores(probs)


@query()
def iforest_scores(spark, d):
    return anomalies.isolation_forest(table(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), "k", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(union(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_present, round(avg({c}::DOUBLE), 6) AS mean, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest, TRUE AS near FROM lineitem" for c in L_NUMBERS))
def sketched_profile(spark, d):
    """near: distinct counts within 4 standard errors of the exact ones, percentiles within 2 % of ranks."""
    own = sketches.sketched_profile(spark, f"{d}/lineitem.parquet").where(F.col("column").isin(L_NUMBERS))
    exact = profile.cardinality(table(spark, d, "lineitem"), L_NUMBERS).select("column", F.col("n_unique").alias("unique"))
    from assay.functions.ranks import exact_quantiles

    sides = exact_quantiles(table(spark, d, "lineitem"), [F.col(c).cast("double") for c in L_NUMBERS], [x for p in sketches.PERCENTS for x in (max(0.0, p - 0.02), min(1.0, p + 0.02))])
    ends = F.element_at(F.create_map(*(x for c, s in zip(L_NUMBERS, sides, strict=True) for x in (F.lit(c), F.array(*map(F.lit, s))))), F.col("column"))
    near = F.abs(F.col("n_unique") - F.col("unique")) <= 4 * 1.04 / 2 ** (sketches.BITS / 2) * F.col("unique")
    for k, p in enumerate(sketches.PERCENTS):
        near &= F.col(f"p{round(100 * p)}").between(F.get(ends, F.lit(2 * k)), F.get(ends, F.lit(2 * k + 1)))
    return rounded(own.join(exact, "column").select("column", "n_rows", "n_present", "mean", "least", "greatest", near.alias("near")))


@query()
def dense_near_duplicates(spark, d):
    return rounded(dense_duplicates.dense_pairs(table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"]))


@query()
def forest_attributions(spark, d):
    own, names = table(spark, d, "orders"), ["o_custkey", "o_totalprice"]
    scores = saved(anomalies.isolation_forest(own, "o_orderkey", names), "scores")
    return anomalies.forest_attributions(own, "o_orderkey", names, scores.where("outlier").select("o_orderkey"))


PCA = "WITH s AS (SELECT avg(o_custkey) AS ma, stddev_pop(o_custkey) AS sa, avg(o_totalprice) AS mb, stddev_pop(o_totalprice) AS sb, corr(o_custkey, o_totalprice) AS r FROM orders), e AS (SELECT o_orderkey, pow(((o_custkey - ma) / sa - CASE WHEN r < 0 THEN -1 ELSE 1 END * (o_totalprice - mb) / sb) / 2, 2) AS error FROM orders, s), t AS (SELECT quantile_cont(error, 0.95) AS threshold FROM e)"


@query(f"{PCA} SELECT o_orderkey, round(error, 6) AS error, round(threshold, 6) AS threshold, error >= threshold AS high FROM e, t")
def pca_reconstruction(spark, d):
    own = table(spark, d, "orders")
    return rounded(anomalies.high_errors(anomalies.pca_errors(own, "o_orderkey", ["o_custkey", "o_totalprice"]), "o_orderkey").drop("squares"))


@query()
def autoencoder_error(spark, d):
    own = table(spark, d, "orders")
    return rounded(anomalies.error_summary(anomalies.high_errors(anomalies.autoencoder_errors(own, "o_orderkey", ["o_custkey", "o_totalprice"]), "o_orderkey")))


_FENCED = union(f"SELECT avg((x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::INT) AS r FROM (SELECT {c}::DOUBLE AS x FROM orders), (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM orders)" for c in O_NUMBERS)
_SCORE = lambda v: f"CASE WHEN {v} > 0.2 THEN 3 WHEN {v} > 0.1 THEN 2 WHEN {v} > 0.05 THEN 1 ELSE 0 END"


@query(f"""WITH d AS (SELECT coalesce(sum(n) FILTER (n > 1), 0) / sum(n) AS ratio, count(*) FILTER (n > 1) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY text)),
m AS (SELECT {" + ".join(f"(count(*) > count({c}))::INT" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic"))} AS gaps FROM {LABELLED}),
o AS (SELECT avg(r) AS ratio FROM ({_FENCED})),
s AS (SELECT [CASE WHEN d.ratio = 0 THEN 0 WHEN d.ratio < 0.001 THEN 1 WHEN d.ratio < 0.01 THEN 2 ELSE 3 END, {_SCORE("round(d.ratio, 5)")}, {_SCORE("o.ratio")}] AS scores, (round(d.ratio, 5) > 0)::INT + groups + gaps + (o.ratio > 0)::INT AS total FROM d, m, o),
l AS (SELECT (list_max(scores) + list_avg(scores)) / 2 AS level, total FROM s)
SELECT CASE WHEN level >= 3.5 THEN 'critical' WHEN level >= 2.5 THEN 'high' WHEN level >= 1.5 THEN 'medium' WHEN level >= 0.5 THEN 'low' ELSE 'none' END AS overall_risk, total::BIGINT AS total_issues FROM l""")
def risk_rollup(spark, d):
    repeated = duplicates.summary(table(spark, d, "documents"), ["text"]).first()
    gaps = profile.missing(labelled(spark, d)).where("n_missing > 0").count()
    outliers = numeric.iqr_outliers(table(spark, d, "orders"), O_NUMBERS).agg(F.avg("outlier_ratio")).first()[0]
    given = {"exact_duplicates": {k: repeated[k] for k in ("duplicate_ratio", "duplicate_groups", "risk_level")}, "missing_values": {"num_columns_with_missing": gaps}, "outliers": {"outlier_ratio": outliers}}
    return spark.createDataFrame([(summary.overall_risk(given), summary.total_issues(given))], "overall_risk string, total_issues long")


@query("WITH n AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS t FROM n) SELECT l_returnflag, greatest(1, round(n * 1000.0 / t))::BIGINT AS n_rows FROM n, t")
def stratified_sample(spark, d):
    own = table(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return numeric.sampled(own, 1000, "k", "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n_rows"))
