"""Tables from files and frames. The file's ending chooses the reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from datetime import datetime, timedelta
from pathlib import PurePosixPath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.columns import col, kind_of

#: What counts as missing in text formats.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """With a header. Missing-value texts become NULL before types are inferred; a given schema saves that pass."""
    if schema:
        return spark.read.schema(schema).options(header=True, **options).csv(path)
    texts = spark.read.options(header=True, **options).csv(path)
    texts = texts.select(*(F.when(~col(c).isin(*MISSING_TEXTS), col(c)).alias(c) for c in texts.columns))
    return infer_types(texts)


def infer_types(texts: DataFrame) -> DataFrame:
    """Long, double, boolean or timestamp for string columns whose values all are; one aggregation for all columns."""
    rules = (("long", r"^[+-]?\d{1,18}$"), ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), ("boolean", r"^(?i:true|false)$"), ("timestamp_ntz", r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"))
    tests = [F.count(col(c)).alias(f"{i}_n") for i, c in enumerate(texts.columns)]
    for i, c in enumerate(texts.columns):
        tests += [F.sum(F.when(col(c).rlike(p), 1)).alias(f"{i}_{k}") for k, p in rules]
    seen = texts.agg(*tests).first() if tests else None
    out = []
    for i, c in enumerate(texts.columns):
        n = seen[f"{i}_n"]
        kind = next((k for k, _ in rules if n and seen[f"{i}_{k}"] == n), "string")
        out.append(F.expr(f"try_cast(`{c.replace('`', '``')}` AS {kind})").alias(c))
    return texts.select(*out)


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Built-in number formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, under a header, on the driver: a workbook is one small file. Types are inferred as in CSV; dates
    are cells with a built-in or spelled-out date format."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    rows = sheet_rows(raw)
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    width = max(map(len, rows))
    names = [v if v is not None else f"column_{i}" for i, v in enumerate(rows[0] + [None] * (width - len(rows[0])))]
    texts = [tuple(None if v in MISSING_TEXTS else v for v in r + [None] * (width - len(r))) for r in rows[1:]]
    return infer_types(spark.createDataFrame(texts, T.StructType([T.StructField(n, T.StringType()) for n in names])))


def sheet_rows(raw: bytes) -> list[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        parts = set(book.namelist())
        shared = ["".join(t.text or "" for t in x.iter(f"{SHEET}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in parts else []
        dates: list[bool] = []
        if "xl/styles.xml" in parts:
            styles = ElementTree.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{SHEET}numFmt") if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
            dates = [int(x.get("numFmtId", 0)) in DATE_FORMATS | own for cells in styles.iter(f"{SHEET}cellXfs") for x in cells.iter(f"{SHEET}xf")]
        sheet = ElementTree.fromstring(book.read(min((p for p in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", p)), key=lambda p: (len(p), p))))
    rows: list[list[str | None]] = []
    for row in sheet.iter(f"{SHEET}row"):
        rows += [[] for _ in range(int(row.get("r", len(rows) + 1)) - 1 - len(rows))]
        values: list[str | None] = []
        for cell in row.iter(f"{SHEET}c"):
            place = 0
            for c in re.match("[A-Z]*", cell.get("r", ""))[0]:
                place = 26 * place + ord(c) - 64
            values += [None] * (place - 1 - len(values))
            kind, v = cell.get("t", "n"), cell.find(f"{SHEET}v")
            value = "".join(t.text or "" for t in cell.iter(f"{SHEET}t")) if kind == "inlineStr" else None if v is None else v.text
            if value is not None and kind == "s":
                value = shared[int(value)]
            elif value is not None and kind == "b":
                value = "true" if value == "1" else "false"
            elif value is not None and kind == "n":
                style = int(cell.get("s", 0))
                if style < len(dates) and dates[style]:
                    value = str(datetime(1899, 12, 30) + timedelta(seconds=round(float(value) * 86400)))
            values.append(value)
        rows.append(values)
    return [r for r in rows if any(v is not None for v in r)]


COLUMNS_OF_ROWS = "map<string,map<string,string>>"


def read_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records, or a document that has each column as an object of row names and values. The latter is turned round: cells
    are exploded and grouped again by row; a column gets the narrowest of long, double, boolean and string that holds all of
    its values."""
    plain = spark.read.options(**{"multiLine": True} | options).json
    if str(options.get("multiLine", True)).lower() != "true":
        return plain(path)
    text = spark.read.text(path, wholetext=True)
    whole = text.select("value", F.input_file_name().alias("file"), F.from_json("value", COLUMNS_OF_ROWS).alias("columns"))
    turned = F.col("value").rlike(r"^\s*\{") & ~F.col("value").rlike(r"^\s*\{[^\n]*\}\s*\n\s*\{") & (F.size("columns") > 0) & F.forall(F.map_values("columns"), lambda m: m.isNotNull())
    if not whole.agg(F.coalesce(F.bool_and(F.coalesce(turned, F.lit(False))), F.lit(False))).first()[0]:
        return plain(path)
    cells = whole.select("file", F.explode("columns").alias("column", "rows")).select("file", "column", F.posexplode("rows").alias("place", "row", "value"))
    seen = cells.groupBy("column").agg(*(F.bool_and(F.col("value").isNull() | ok).alias(kind) for kind, ok in (("long", F.col("value").try_cast("long").isNotNull() & ~F.col("value").contains(".")), ("double", F.col("value").try_cast("double").isNotNull()), ("boolean", F.lower("value").isin("true", "false")))), F.count("value").alias("n"))
    kinds = {r["column"]: next((k for k in ("long", "double", "boolean") if r["n"] and r[k]), "string") for r in seen.collect()}  # a row for each column
    order = whole.select(F.posexplode(F.map_keys("columns")).alias("place", "column")).groupBy("column").agg(F.min("place").alias("place")).orderBy("place", "column").collect()
    rows = cells.groupBy("file", "row").agg(*(F.first(F.when(F.col("column") == r["column"], F.col("value")), ignorenulls=True).try_cast(kinds.get(r["column"], "string")).alias(r["column"]) for r in order))
    return rows.drop("file", "row") if not {"file", "row"} & set(kinds) else rows.select(*(rows[len(rows.columns) - len(order) + i] for i in range(len(order))))


READERS = {
    ".csv": read_csv,
    ".parquet": lambda spark, path, **o: spark.read.options(**o).parquet(path),
    ".json": read_json,
    ".orc": lambda spark, path, **o: spark.read.options(**o).orc(path),
    ".xlsx": read_excel,
}


class Source:
    """A table with what is known of it."""

    def __init__(self, frame: DataFrame, path: str | None = None):
        self.frame, self.path = frame, path

    @classmethod
    def open(cls, spark: SparkSession, data, **options) -> Source:
        """A path, a Spark frame or a pandas frame."""
        if isinstance(data, DataFrame):
            return cls(data)
        if hasattr(data, "iloc"):
            return cls(spark.createDataFrame(data))
        ending = PurePosixPath(str(data).rstrip("/")).suffix.lower()
        if ending not in READERS:
            raise ValueError(f"no reader for files that end in {ending or 'nothing'}")
        return cls(READERS[ending](spark, str(data), **options), str(data))

    @classmethod
    def from_csv(cls, spark, path, **options):
        return cls(read_csv(spark, path, **options), path)

    @classmethod
    def from_parquet(cls, spark, path, **options):
        return cls(READERS[".parquet"](spark, path, **options), path)

    @classmethod
    def from_json(cls, spark, path, **options):
        return cls(READERS[".json"](spark, path, **options), path)

    @classmethod
    def from_orc(cls, spark, path, **options):
        return cls(READERS[".orc"](spark, path, **options), path)

    @classmethod
    def from_xlsx(cls, spark, path):
        return cls(read_excel(spark, path), path)

    def schema(self) -> dict[str, str]:
        return {f.name: kind_of(f.dataType) for f in self.frame.schema.fields}

    def size_mb(self) -> float | None:
        """Of the file or folder, by the file system that holds it."""
        if not self.path:
            return None
        jvm = self.frame.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        store = where.getFileSystem(self.frame.sparkSession._jsc.hadoopConfiguration())
        return round(store.getContentSummary(where).getLength() / 1048576, 2)

    def info(self) -> dict:
        return {"path": self.path, "file_size_mb": self.size_mb(), "engine": "spark", "rows": self.frame.count(), "columns": len(self.frame.columns), "dtypes": dict(Counter(t for _, t in self.frame.dtypes))}


def normalised(df: DataFrame) -> DataFrame:
    """NaN as NULL, so that later steps know one kind of missing."""
    return df.select(*(F.nanvl(col(f.name), F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name) for f in df.schema.fields))


def with_row_id(df: DataFrame, keys: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """A row's identity: its key if it has one, else a number that holds for this plan only (write it before use)."""
    if keys:
        return df.withColumn(name, col(keys[0]) if len(keys) == 1 else F.concat_ws("|", *(col(k).cast("string") for k in keys)))
    return df.withColumn(name, F.monotonically_increasing_id())
