from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import categorical, constraints, duplicates, numeric, profile
from assay.sources.readers import Source


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(1, 1.0, "a", None), (2, float("nan"), "b", None), (3, 3.0, "", None), (4, None, "a", None), (4, None, "a", None)]
    return spark.createDataFrame(rows, "k long, x double, s string, gone string")


def test_nan_is_missing(tiny):
    got = {r["column"]: r["n_missing"] for r in profile.missing(tiny).collect()}
    assert got == {"k": 0, "x": 3, "s": 0, "gone": 5}
    assert [r["column"] for r in profile.worst_missing(tiny).collect()] == ["gone", "x", "k"]


def test_cardinality(tiny):
    got = {r["column"]: (r["n_present"], r["n_unique"]) for r in profile.cardinality(tiny).collect()}
    assert got == {"k": (5, 4), "x": (2, 2), "s": (5, 3), "gone": (0, 0)}


def test_duplicates_count_every_member(tiny):
    got = duplicates.summary(tiny).first()
    assert (got.duplicate_rows, got.duplicate_groups, got.unique_rows, got.risk_level) == (2, 1, 3, "high")
    assert got.excess_ratio == pytest.approx(0.2)


def test_pattern_entropy_and_completeness(tiny):
    assert profile.pattern_entropy(tiny).first()[0] == pytest.approx(-(0.4 * math.log(0.4) + 0.6 * math.log(0.6)))
    assert profile.completeness(tiny).first().missing_cells == pytest.approx(8 / 20)


def test_skewness_like_pandas(spark):
    x = [1.0, 2.0, 2.5, 3.0, 10.0, 11.5, 2.25]
    got = numeric.skew_kurtosis(spark.createDataFrame([(v,) for v in x], "x double")).first()
    assert got.skewness == pytest.approx(pd.Series(x).skew())
    assert got.kurtosis == pytest.approx(pd.Series(x).kurt())


def test_constant_column(spark):
    df = spark.createDataFrame([(2.0, float(i)) for i in range(20)], "c double, x double")
    got = {r["column"]: r["entropy"] for r in numeric.histogram_entropy(df).collect()}
    assert got["c"] == 0 and got["x"] > 0
    assert [r.c for r in numeric.standardised(df, ["c"]).collect()] == [0.0] * 20
    assert numeric.correlations(df).first().r is None


def test_rare_threshold_is_strict(spark):
    rows = [("a",)] * 990 + [("b",)] * 6 + [("c",)] * 4  # 5 / 1000 is the limit
    got = categorical.rare_values(spark.createDataFrame(rows, "s string"), ["s"]).collect()
    assert [(r.value, r.n) for r in got] == [("c", 4)]


def test_chi_square_tail():
    assert categorical.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert categorical.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)


def test_approximate_dependency(spark):
    rows = [(g, f"v{g}") for g in range(25) for _ in range(4)] + [(3, "other")]
    df = spark.createDataFrame(rows, "g int, v string")
    got = constraints.dependencies(df, ["g", "v"]).where("determinant = 'g'").first()
    assert (got.n_groups, got.n_broken) == (25, 1) and got.confidence == pytest.approx(0.96)
    assert constraints.dependency_violations(constraints.dependencies(df, ["g", "v"])).first().severity == "MEDIUM"
    shown = constraints.dependency_examples(df, "g", "v").first()
    assert (shown.determinant, shown.examples) == ("3", "other|v3")


def test_sum_rule_and_failed_rule(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 1.0), (1.0, 2.0, 9.0), (1.0, 2.0, None)], "a double, b double, t double")
    assert constraints.rule(df, {"type": "sum", "columns": ["a", "b"], "total_column": "t"}).first().n_violations == 1
    assert constraints.rule(df, {"type": "sum", "columns": ["a", "z"], "total_column": "t"}).first().status == "failed"
    assert constraints.rule(df, {"type": "sql", "condition": "a < t"}).first().n_violations == 1


def test_pattern_is_anchored_at_the_start_only(spark):
    df = spark.createDataFrame([("abc",), ("xabc",), (None,)], "s string")
    assert constraints.patterns(df, {"s": "ab"}).first().n_violations == 1


@pytest.mark.parametrize("good, kind", [(81, "email"), (80, None)])
def test_detected_patterns(spark, good, kind):
    rows = [(f"u{i}@x.org",) for i in range(good)] + [("no",)] * (100 - good)
    got = constraints.detected_patterns(spark.createDataFrame(rows, "s string")).collect()
    assert [r.pattern for r in got] == ([kind] if kind else [])


def test_date_pairs_by_name():
    assert constraints.date_pairs(["start_date", "end_date", "x"]) == [("start_date", "end_date")]
    assert constraints.date_pairs(["o_order_date", "ShipDate", "created_at", "updatedAt"]) == [("created_at", "updatedAt"), ("o_order_date", "ShipDate")]
    assert constraints.date_pairs(["calendar_date", "vendor_date", "reorder_at", "membership", "start", "end"]) == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, x double, s string")
    assert duplicates.summary(df).first().duplicate_ratio == 0
    assert profile.missing(df).count() == 3
    assert profile.completeness(df).count() == 1


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,2.5,x,2020-01-01\n2,NA,,2020-01-02\n")
    source = Source.open(spark, str(tmp_path / "t.csv"))
    assert dict(source.frame.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "timestamp_ntz"}
    assert source.frame.where("b is null and c is null").count() == 1
    assert source.info()["rows"] == 2
    with pytest.raises(ValueError):
        Source.open(spark, "t.unknown")
    assert Source.open(spark, pd.DataFrame({"a": [1]})).frame.count() == 1


@pytest.mark.parametrize("value, kind", [("2020-01-01 10:00:00", "date_iso"), ("2020-01-01", "phone"), ("555-1234", "phone"), ("a.b-c@x-y.org", "email"), ("HTTP://a.org/x y", "url"), ("0123456789", "phone"), ("0123456789ab", None), ("6F9619FF-8B86-D011-B42D-00C04FC964FF", "uuid")])
def test_kinds_of_values(spark, value, kind):
    got = constraints.detected_patterns(spark.createDataFrame([(value,)] * 3, "s string")).collect()
    assert [r.pattern for r in got] == [kind] * (kind is not None)


def test_json_and_orc(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert sorted(tuple(r) for r in Source.open(spark, str(tmp_path / "t.json")).frame.select("a", "b").collect()) == [(1, "x"), (2, None)]
    spark.range(3).write.orc(str(tmp_path / "t.orc"))
    assert sorted(r.id for r in Source.from_orc(spark, str(tmp_path / "t.orc")).frame.collect()) == [0, 1, 2]


def test_excel(spark, tmp_path):
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b</t></is></c><c r="D1" t="str"><v>d</v></c></row><row r="3"><c r="A3"><v>1</v></c><c r="B3" t="b"><v>1</v></c><c r="D3" s="1"><v>43831.5</v></c></row><row r="4"><c r="A4"><v>2.5</v></c><c r="D4" t="s"><v>1</v></c></row>'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>a</t></si><si><t>NA</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {space}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    frame = Source.open(spark, str(tmp_path / "t.xlsx")).frame
    assert dict(frame.dtypes) == {"a": "double", "b": "boolean", "column_2": "string", "d": "timestamp_ntz"}
    assert [(r.a, r.b, str(r.d)) for r in frame.orderBy("a").collect()] == [(1.0, True, "2020-01-01 12:00:00"), (2.5, None, "None")]


def test_exact_quantiles(spark):
    import numpy as np

    from assay.functions.ranks import exact_quantiles

    r = np.random.default_rng(3)
    columns = [r.normal(size=3000), r.integers(0, 3, 3000).astype(float), np.full(3000, 7.0)]
    rows = [(float(a), None if i % 3 == 0 else float(b), float(c), None) for i, (a, b, c) in enumerate(zip(*columns, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, [F.col(c) for c in "abcd"], shares)
    for name, found in zip("abc", got, strict=False):
        held = [x for x in (row["abcd".index(name)] for row in rows) if x is not None]
        assert found == pytest.approx(list(np.quantile(held, shares)), rel=1e-12, abs=1e-12)
    assert got[3] == [None] * 6
    for n in (2, 12, 500, 1999, 2400):
        found = exact_quantiles(spark.range(n), [F.col("id")], shares)[0]
        assert found == pytest.approx(list(np.quantile(np.arange(n), shares)), rel=1e-12, abs=1e-12), n
    assert exact_quantiles(df.limit(0), [F.col("a")], [0.5]) == [[None]]
    assert exact_quantiles(spark.range(1), [F.col("id")], [0.1, 0.9]) == [[0.0, 0.0]]


def test_likely_identifiers_and_examples(spark):
    df = spark.createDataFrame([(i, f"n{i}", i % 3, -1.0 if i == 4 else 0.5, f"c{i}") for i in range(40)], "k long, full_name string, kind int, tax_rate double, code string")
    assert profile.likely_identifiers(df, ["full_name", "kind", "tax_rate", "code"]) == ["full_name", "code"]
    found = constraints.ranges(df.select("tax_rate"))
    assert constraints.examples(df, "k", [found], found.collect()) == {f"{found.first().check}:tax_rate": [4]}
