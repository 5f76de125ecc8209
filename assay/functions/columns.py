"""Column classes, the one notion of missing, and small expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, *FLOATING, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.StructType, T.MapType, T.BinaryType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def kind_of(data_type: T.DataType, decimal_as_numeric: bool = True) -> str:
    """numeric, datetime, nested or categorical (strings, booleans, intervals)."""
    if isinstance(data_type, T.DecimalType) and not decimal_as_numeric:
        return "categorical"
    if isinstance(data_type, NUMBERS):
        return "numeric"
    if isinstance(data_type, TIMES):
        return "datetime"
    return "nested" if isinstance(data_type, NESTED) else "categorical"


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def strings_of(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = col(name)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, FLOATING) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, NULL where it is missing."""
    return F.when(~is_missing(df, name), col(name))


def number(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def comparable(df: DataFrame, name: str) -> Column:
    """The value in a form that can be grouped and compared; maps by their JSON text."""
    return F.to_json(col(name)) if isinstance(df.schema[name].dataType, T.MapType) else present(df, name)


def as_rows(df: DataFrame, names: list[str], make) -> Column:
    """An array with make(name, place) for each column, to be exploded."""
    return F.array(*(make(n, i) for i, n in enumerate(names)))


def entropy(counts: DataFrame, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Shannon entropy in nats of counts, for each group of ``by``."""
    by = by or []
    return counts.groupBy(*by).agg((F.log(F.sum(n)) - F.sum(F.col(n) * F.log(F.col(n))) / F.sum(n)).alias("entropy"))


def shuffled(one: DataFrame, other: DataFrame, on) -> DataFrame:
    """An inner join that deals both sides. Spark takes a table's size on disk for its size in memory, so that one of millions
    of rows that compress well would be collected by the driver, to be broadcast."""
    return one.join(other.hint("merge"), on)
