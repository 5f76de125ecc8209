"""Declared and discovered constraints of one table, and the scores made of their violations.

Every check gives a row (check, constraint_type, columns, severity, n_violations, n_rows, violation_ratio); a rule that
can't be applied gives a row with status 'failed' and the reason instead of being passed over.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import col, columns_of, comparable, is_missing, number, present, strings_of
from assay.operators.numeric import union_all
from assay.operators.profile import cardinality, frequencies

WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2, "INFO": 0.1}
CONFIDENCE, DETECTED = 0.95, 0.8
#: Candidate columns beyond which dependencies are first sketched; bits of a sketch's register number; deviations of safety.
WIDE, SKETCH_BITS, SURE = 16, 12, 6
RESULT = "check string, constraint_type string, columns string, severity string, n_violations long, n_rows long, violation_ratio double, status string, reason string"

# What values of each kind look like, in the order in which they are tried.
PATTERNS = (
    ("email", r"^[\w\.-]+@[\w\.-]+\.\w+$"),
    ("phone", r"^[\d\-\+\(\)\s]{7,20}$"),
    ("url", r"^https?://[\w\.-]+"),
    ("date_iso", r"^\d{4}-\d{2}-\d{2}"),
    ("uuid", r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"),
)
# Names of two dates of which the first can't be after the second, and parts of names of shares and counts.
DATE_PAIRS = (("start_date", "end_date"), ("created_at", "updated_at"), ("birth_date", "death_date"), ("order_date", "ship_date"), ("hire_date", "termination_date"))
SHARE_NAMES = ("percent", "pct", "ratio", "rate")
COUNT_NAMES = ("count", "quantity", "qty", "amount", "price", "cost", "age", "size")
COMPARE = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "==": lambda a, b: a == b}


def rows_of(df: DataFrame, checks: list[tuple[str, str, str, str, Column]]) -> DataFrame:
    """Counts rows that break each of (check, type, columns, severity, broken), in one aggregation."""
    if not checks:
        return df.sparkSession.createDataFrame([], RESULT)
    one = df.agg(F.count("*").alias("n"), *(F.count_if(c[4]).alias(f"c{i}") for i, c in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(c[0]).alias("check"), F.lit(c[1]).alias("constraint_type"), F.lit(c[2]).alias("columns"), F.lit(c[3]).alias("severity"), F.col(f"c{i}").alias("n_violations")) for i, c in enumerate(checks)))
    out = _finished(one.select("n", F.inline(rows)).withColumnRenamed("n", "n_rows"))
    out.broken = {(c[0], c[2]): c[4] for c in checks}  # for examples
    return out


def _finished(df: DataFrame) -> DataFrame:
    ratio = F.coalesce(F.try_divide(F.col("n_violations"), F.col("n_rows")), F.lit(0.0))
    return df.select("check", "constraint_type", "columns", "severity", "n_violations", "n_rows", ratio.alias("violation_ratio"), F.lit("checked").alias("status"), F.lit(None).cast("string").alias("reason"))


def listed(names) -> str:
    """Names joined by commas; a comma of a name is marked, so that they can be told apart again."""
    return ",".join(n.replace("\\", "\\\\").replace(",", "\\,") for n in names)


def unlisted(columns: str) -> tuple[str, ...]:
    return tuple(re.sub(r"\\(.)", r"\1", x) for x in re.findall(r"(?:[^,\\]|\\.)+", columns))


def failed(df: DataFrame, check: str, kind: str, columns: list[str], reason: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(check, kind, listed(columns), "INFO", 0, 0, 0.0, "failed", reason)], RESULT)


def uniqueness(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows in groups of two or more equal values (missing ones equal each other), for each column."""
    parts = []
    for n in names:
        groups = df.groupBy(comparable(df, n).alias("v")).agg(F.count("*").alias("k"))
        parts.append(groups.agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("n_violations"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows")).select(F.lit("unique").alias("check"), F.lit("uniqueness").alias("constraint_type"), F.lit(n).alias("columns"), F.lit("HIGH").alias("severity"), "n_violations", "n_rows"))
    return _finished(union_all(parts))


def uniqueness_examples(df: DataFrame, name: str, most: int = 5) -> DataFrame:
    own = frequencies(df, [name]).where("n > 1")
    return own.orderBy(F.desc("n"), "value").limit(most).select("value", "n")


def unique_columns(df: DataFrame) -> DataFrame:
    """Columns without repeats or missing values, in tables of more than one row."""
    return cardinality(df).where("n_unique = n_rows and n_rows > 1").select("column", "n_unique")


def not_null(df: DataFrame, names: list[str]) -> DataFrame:
    own = rows_of(df, [("not_null", "not_null", n, "MEDIUM", is_missing(df, n)) for n in names])
    return own.withColumn("severity", F.when(F.col("violation_ratio") > 0.1, "HIGH").otherwise("MEDIUM"))


def domain(df: DataFrame, domains: dict[str, list]) -> DataFrame:
    return rows_of(df, [("domain", "value_domain", n, "MEDIUM", ~present(df, n).isin(list(v)) & ~is_missing(df, n)) for n, v in domains.items()])


def domain_values(df: DataFrame, name: str, allowed: list) -> DataFrame:
    """The values outside the domain and how often they occur."""
    return frequencies(df, [name]).where(~F.col("value").isin([str(v) for v in allowed])).select("value", "n")


def rare_values(df: DataFrame, names: list[str] | None = None, share: float = 0.001, most: int = 10) -> DataFrame:
    """(column, value, n): values of string columns so rare that they may be typing errors: n at most max(1, share of the
    column's values), if such values are fewer than a tenth of its distinct ones; the first ``most`` by n and value."""
    from assay.operators.profile import row_numbers

    own = frequencies(df, names or strings_of(df))
    totals = own.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    rare = own.join(F.broadcast(totals), "column").where(F.col("n") <= F.greatest(F.lit(1.0), share * F.col("total")))  # a row for each column
    few = rare.groupBy("column").agg(F.count("*").alias("rare"), F.first("k").alias("k")).where(F.col("rare") < 0.1 * F.col("k")).select("column")
    rare = rare.join(F.broadcast(few), "column")
    return rare.withColumn("place", row_numbers(rare, ["column"], ["n", "value"])).where(F.col("place") <= most).select("column", "value", "n")


def anchored(pattern: str) -> str:
    """A pattern that must match from the first character on, but not up to the last."""
    return f"^(?:{pattern})"


def patterns(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    out = []
    for name, pattern in declared.items():
        try:
            df.sparkSession.range(1).select(F.lit("").rlike(anchored(pattern))).collect()
        except Exception as e:  # the pattern can't be compiled
            out.append(failed(df, "pattern", "pattern", [name], f"bad pattern: {type(e).__name__}"))
            continue
        out.append(rows_of(df, [("pattern", "pattern", name, "MEDIUM", ~present(df, name).cast("string").rlike(anchored(pattern)))]))
    return union_all(out)


def detected_patterns(df: DataFrame, key: str | None = None, names: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """(column, pattern, matching_ratio): the first kind that more than 0.8 of a column's values look like. ``rows`` looks
    at the first rows by key only; by default all count."""
    names = names or strings_of(df)
    own = df.orderBy(col(key)).limit(rows) if rows and key else df
    marks = []
    for n in names:
        hits = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("pattern"), (F.count_if(col(n).rlike(f"(?iuU){p}")) / F.count(col(n))).alias("ratio")) for i, (k, p) in enumerate(PATTERNS)))
        marks.append(F.struct(F.lit(n).alias("column"), F.when(F.count(col(n)) > 0, hits).alias("hits")))
    found = own.agg(F.array(*marks).alias("marks")).select(F.inline("marks"))
    best = F.filter("hits", lambda h: h["ratio"] > DETECTED)[0]
    return found.where(F.exists("hits", lambda h: h["ratio"] > DETECTED)).select("column", best["pattern"].alias("pattern"), F.round(best["ratio"], 4).alias("matching_ratio"))


def date_pairs(names: list[str]) -> list[tuple[str, str]]:
    found = []
    plain = {n: n.lower().replace("_", "") for n in names}
    for first, last in ((x.replace("_", ""), y.replace("_", "")) for x, y in DATE_PAIRS):
        found += [(a, b) for a in names if first in plain[a] for b in names if last in plain[b] and a != b]
    return list(dict.fromkeys(found))


def temporal_columns(df: DataFrame, least: float = CONFIDENCE) -> list[str]:
    """Date and time columns, and string columns of whose present values at least ``least`` are dates: all count, in one
    aggregation, so gaps and the order of rows change nothing and a few bad dates don't hide the column."""
    times, texts = columns_of(df, "datetime"), strings_of(df)
    if texts:
        one = df.agg(*(F.count(col(n)).alias(f"n{i}") for i, n in enumerate(texts)), *(F.count(F.try_to_timestamp(col(n))).alias(f"t{i}") for i, n in enumerate(texts))).first()
        times += [n for i, n in enumerate(texts) if one[f"n{i}"] and one[f"t{i}"] >= least * one[f"n{i}"]]
    return times


def as_time(df: DataFrame, name: str) -> Column:
    return F.try_to_timestamp(col(name)) if name in strings_of(df) else col(name).cast("timestamp")


def future_dates(df: DataFrame, names: list[str], now: str | None = None) -> DataFrame:
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return rows_of(df, [("future_date", "temporal", n, "LOW", as_time(df, n) > at) for n in names])


def temporal_stats(df: DataFrame, names: list[str], now: str | None = None) -> DataFrame:
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    rows = [F.struct(F.lit(n).alias("column"), F.min(as_time(df, n)).cast("timestamp_ntz").alias("earliest"), F.max(as_time(df, n)).cast("timestamp_ntz").alias("latest"), F.count_if(as_time(df, n).isNull()).alias("n_null"), F.count_if(as_time(df, n) > at).alias("n_future")) for n in names]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def date_order(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    pairs = pairs or date_pairs(temporal_columns(df))
    return rows_of(df, [("date_order", "temporal", listed([a, b]), "HIGH", as_time(df, a) > as_time(df, b)) for a, b in pairs])


def comparison(df: DataFrame, a: str, b: str, operator: str) -> DataFrame:
    names = [n for n in (a, b) if n not in df.columns]
    if names or operator not in COMPARE:
        return failed(df, "comparison", "cross_column", [a, b], f"no column {names[0]}" if names else f"no operator {operator}")
    return rows_of(df, [("comparison", "cross_column", listed([a, b]), "HIGH", ~COMPARE[operator](present(df, a), present(df, b)))])


def sum_rule(df: DataFrame, parts: list[str], total: str, tolerance: float = 0.01) -> DataFrame:
    names = [n for n in (*parts, total) if n not in df.columns]
    if names:
        return failed(df, "sum", "cross_column", [*parts, total], f"no column {names[0]}")
    added = sum((F.coalesce(number(df, n), F.lit(0.0)) for n in parts), F.lit(0.0))
    whole = number(df, total)
    return rows_of(df, [("sum", "cross_column", listed([*parts, total]), "HIGH", F.abs(added - whole) > tolerance * F.greatest(F.abs(whole), F.lit(1.0)))])


def rule(df: DataFrame, given: dict) -> DataFrame:
    """A declared rule: {type: comparison, columns: [a, b], operator}, {type: sum, columns, total_column, tolerance} or
    {type: sql, condition}: rows for which the condition is false break it."""
    if given.get("type") == "comparison":
        return comparison(df, *given["columns"], given["operator"])
    if given.get("type") == "sum":
        return sum_rule(df, given["columns"], given["total_column"], given.get("tolerance", 0.01))
    if given.get("type") == "sql":
        return rows_of(df, [("sql", "cross_column", given["condition"], given.get("severity", "HIGH"), ~F.expr(given["condition"]))])
    return failed(df, str(given.get("type")), "cross_column", [], "no such rule")


def ranges(df: DataFrame) -> DataFrame:
    """Shares outside 0 to 1 (0 to 100 where the name says percent), by column name."""
    checks = []
    for n in columns_of(df, "numeric"):
        if any(x in n.lower() for x in SHARE_NAMES):
            most = 100 if "percent" in n.lower() else 1
            checks.append(("range", "range", n, "MEDIUM", (number(df, n) < 0) | (number(df, n) > most)))
    return rows_of(df, checks)


def non_negative(df: DataFrame) -> DataFrame:
    """Negative values in columns whose names say that they count or measure."""
    return rows_of(df, [("non_negative", "range", n, "MEDIUM", number(df, n) < 0) for n in columns_of(df, "numeric") if any(x in n.lower() for x in COUNT_NAMES)])


def foreign_key(df: DataFrame, name: str, other: DataFrame, other_name: str) -> DataFrame:
    """Rows whose value is in no row of another table."""
    held = other.select(col(other_name).alias("__key")).distinct()
    broken = df.where(~is_missing(df, name)).join(held, col(name) == F.col("__key"), "left_anti").agg(F.count("*").alias("n_violations"))
    total = df.agg(F.count("*").alias("n_rows"))
    return _finished(broken.crossJoin(total).select(F.lit("foreign_key").alias("check"), F.lit("referential_integrity").alias("constraint_type"), F.lit(name).alias("columns"), F.lit("CRITICAL").alias("severity"), "n_violations", "n_rows"))


def dependency_candidates(df: DataFrame) -> list[str]:
    return [r["column"] for r in cardinality(df).where("n_unique > 1 and n_unique < 0.5 * n_rows").collect()]


def dependencies(df: DataFrame, names: list[str] | None = None, size: int = 1, least: float = CONFIDENCE, known: set[tuple[tuple, str]] = frozenset()) -> DataFrame:
    """(determinant, dependent, n_groups, n_broken, confidence): groups of equal determinants (missing ones are a group)
    in which a dependent has one value at most. One aggregation for each determinant finds all its dependents: a group
    breaks the dependency where the least and the greatest value differ. Known dependencies of parts are left out, and of
    tables with more than WIDE candidate columns those that sketches rule out (see ``plausible``)."""
    names = names or dependency_candidates(df)
    parts = []
    some = plausible(df, names, size, least, known) if len(names) > WIDE else None
    for det in combinations(names, size):
        deps = [n for n in names if n not in det and not any(((d,), n) in known for d in det) and (some is None or (det, n) in some)]
        if not deps:
            continue
        groups = df.groupBy(*(comparable(df, d).alias(f"d{i}") for i, d in enumerate(det))).agg(*((F.min(comparable(df, n)) != F.max(comparable(df, n))).alias(f"b{i}") for i, n in enumerate(deps)))
        one = groups.agg(F.count("*").alias("n_groups"), *(F.count_if(F.col(f"b{i}")).alias(f"b{i}") for i in range(len(deps))))
        rows = F.array(*(F.struct(F.lit(listed(det)).alias("determinant"), F.lit(n).alias("dependent"), F.col(f"b{i}").alias("n_broken")) for i, n in enumerate(deps)))
        parts.append(one.select("n_groups", F.inline(rows)))
    if not parts:
        return df.sparkSession.createDataFrame([], "determinant string, dependent string, n_groups long, n_broken long, confidence double")
    every = union_all(parts).withColumn("confidence", 1 - F.try_divide(F.col("n_broken"), F.col("n_groups")))
    return every.where(F.col("confidence") >= least).select("determinant", "dependent", "n_groups", "n_broken", "confidence")


def sketched(df: DataFrame, sets: list[tuple[str, ...]], at_once: int = 400) -> dict[tuple[str, ...], float]:
    """About how many different values each set of columns has, missing ones being one; a scan for each ``at_once`` sets."""
    out: dict[tuple[str, ...], float] = {}
    for at in range(0, len(sets), at_once):
        part = sets[at : at + at_once]
        marks = [F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*(F.coalesce(comparable(df, n).cast("string"), F.lit("\x00")) for n in s)), F.lit(SKETCH_BITS))).alias(f"s{i}") for i, s in enumerate(part)]
        found = df.agg(*marks).first()
        out |= {s: float(found[i] or 0) for i, s in enumerate(part)}
    return out


def plausible(df: DataFrame, names: list[str], size: int, least: float, known: set[tuple[tuple, str]] = frozenset()) -> set[tuple[tuple[str, ...], str]]:
    """The dependencies (columns, column) that may hold for a share ``least`` of groups, by sketches of distinct counts.

    If X has g groups and X with A has p, the p - g values beyond one for each group are in groups that break X -> A, at most
    |A| - 1 in each: if (p - g) / (|A| - 1) is above the share that may break, the dependency is out. Counts are taken SURE
    deviations of a sketch in the dependency's favour. Sets grow by a column a level: as a set has no fewer values than its
    parts, sketches of pairs rule out most sets of three before these are sketched."""
    margin = SURE * 1.04 / 2 ** (SKETCH_BITS / 2)
    high, low = lambda x: x * (1 + margin), lambda x: x * (1 - margin)
    counts = sketched(df, [(n,) for n in names] + list(combinations(names, 2)))
    of = lambda *s: counts[tuple(sorted(s, key=names.index))]

    def may(groups: float, pairs: float, values: float) -> bool:
        return low(pairs) - high(groups) <= (1 - least) * high(groups) * max(1.0, high(values) - 1)

    if size == 1:
        return {((x,), a) for x in names for a in names if a != x and may(of(x), of(x, a), of(a))}
    open_ = []
    for det in combinations(names, size):
        for a in names:
            if a in det or any(((d,), a) in known for d in det):
                continue
            parts = [of(d, a) for d in det]
            if size > 2 or may(of(*det), max(parts), of(a)):
                open_.append((det, a))
    if size > 2:
        return set(open_)
    triples = list(dict.fromkeys(tuple(sorted((*det, a), key=names.index)) for det, a in open_))
    counts |= sketched(df, triples)
    return {(det, a) for det, a in open_ if may(of(*det), of(*det, a), of(a))}


def dependency_violations(found: DataFrame) -> DataFrame:
    """Dependencies that nearly hold, as violations."""
    own = found.where("n_broken > 0")
    return own.select(F.lit("functional_dependency").alias("check"), F.lit("functional_dependency").alias("constraint_type"), F.concat_ws(",", "determinant", F.replace(F.replace("dependent", F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,"))).alias("columns"), F.when(F.col("confidence") > 0.99, "LOW").otherwise("MEDIUM").alias("severity"), F.col("n_broken").alias("n_violations"), F.col("n_groups").alias("n_rows"), (1 - F.col("confidence")).alias("violation_ratio"), F.lit("checked").alias("status"), F.lit(None).cast("string").alias("reason"))


def dependency_examples(df: DataFrame, determinant: str, dependent: str, most: int = 3, values: int = 5) -> DataFrame:
    """The first groups that break a dependency, by key, with up to ``values`` of their values in order. Distinct pairs are
    ranked in their group, so nothing is collected whole."""
    from assay.operators.profile import row_numbers

    pairs = df.where(~is_missing(df, dependent)).groupBy(comparable(df, determinant).cast("string").alias("determinant"), comparable(df, dependent).cast("string").alias("value")).agg(F.count("*").alias("n"))
    broken = pairs.groupBy("determinant").agg(F.count("*").alias("n_values")).where("n_values > 1").orderBy("determinant").limit(most)
    own = pairs.join(F.broadcast(broken), "determinant")  # at most ``most`` rows
    return own.withColumn("k", row_numbers(own, ["determinant"], ["value"])).where(F.col("k") <= values).groupBy("determinant", "n_values").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("examples"))


def consistency(violations: DataFrame) -> DataFrame:
    """consistency_score, total_violations and counts by severity of the rows with violations, and risk_level."""
    own = violations.where("status = 'checked' and n_violations > 0")
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("severity"))
    one = own.agg(F.count("*").alias("total_violations"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in WEIGHTS), F.coalesce(F.sum(F.col("violation_ratio") * weight), F.lit(0.0)).alias("cost"))
    score = 1 - F.least(F.lit(1.0), F.col("cost"))
    risk = F.when(F.col("total_violations") == 0, "none").when((F.col("critical") > 0) | (score < 0.5), "critical").when((F.col("high") > 2) | (score < 0.7), "high").when(score < 0.85, "medium").otherwise("low")
    return one.select(F.round(score, 6).alias("consistency_score"), "total_violations", "critical", "high", "medium", "low", "info", risk.alias("risk_level"))


#: Checks whose ``columns`` are listed names; the others have one column's name as it is.
SEVERAL = ("date_order", "comparison", "sum", "functional_dependency")


def column_scores(violations: DataFrame) -> DataFrame:
    """(column, score): 1 less half of each ratio that a column takes part in, 0 at least; 4 decimals. Rules given as SQL
    name no columns of their own. Names are told apart at commas that aren't marked as theirs (see ``listed``)."""
    plain = F.transform(F.regexp_extract_all("columns", F.lit(r"(?:[^,\\]|\\.)+"), F.lit(0)), lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
    names = F.when(F.col("check").isin(*SEVERAL), plain).otherwise(F.array("columns"))
    own = violations.where("status = 'checked' and n_violations > 0 and check <> 'sql'").select(F.explode(names).alias("column"), "violation_ratio")
    return own.groupBy("column").agg(F.round(F.greatest(F.lit(0.0), 1 - F.sum(0.5 * F.col("violation_ratio"))), 4).alias("score"))


def by_severity(violations: DataFrame, by: str = "severity") -> DataFrame:
    return violations.where("status = 'checked' and n_violations > 0").groupBy(by).agg(F.count("*").alias("n"))


def recommendations(score: dict) -> list[str]:
    out = []
    if score["critical"] or score["high"]:
        out.append("Repair the rows that break high-severity rules before the table is used.")
    if score["medium"]:
        out.append("Review value domains, formats and ranges at the place where data enter.")
    if score["low"]:
        out.append("Keep watch on dependencies and dates that hold for nearly all rows.")
    return out or ["No rule was broken."]


def null_statistics(df: DataFrame) -> DataFrame:
    from assay.operators.profile import missing

    return missing(df).select("column", "n_missing", F.round("missing_ratio", 4).alias("null_ratio"))


def examples(df: DataFrame, key: str, results: list[DataFrame], found: list, most: int = 5, rules: int = 20) -> dict[str, list]:
    """By check and columns: the keys of the first rows that break a rule, for the first ``rules`` rules in found."""
    broken = {k: c for r in results for k, c in getattr(r, "broken", {}).items()}
    some = [(r["check"], r["columns"]) for r in found if (r["check"], r["columns"]) in broken][:rules]
    return {f"{check}:{columns}": [r[0] for r in first_rows(df, broken[check, columns], key, [], most).collect()] for check, columns in some}


def first_rows(df: DataFrame, broken: Column, key: str, names: list[str], most: int = 5) -> DataFrame:
    """The first rows by key that break a rule."""
    return df.where(broken).orderBy(col(key)).limit(most).select(col(key), *map(col, names))

