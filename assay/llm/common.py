"""What the corpus operators share: texts and urls as columns, ranges of string keys; and from the rest of the package the
shared folder, connected components and shipping."""

from __future__ import annotations

import bisect
import ctypes
import gc
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.graph import components
from assay.functions.shipping import ship
from assay.functions.storage import new_path, saved, shared_folder

__all__ = ["WORD", "components", "id_text", "new_path", "range_bounds", "range_number", "reversed_host", "saved", "shared_folder", "ship", "text_of", "trim_worker", "url_host", "url_path", "with_id", "worker_cache"]

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_held: dict[str, dict] = {}


def worker_cache(owner: str, key: tuple, make: Callable[[], object]) -> object:
    """make()'s result, kept in this Python worker until a task of another owner asks: workers outlive stages, and what an
    earlier stage kept is of no use to a later one."""
    if owner not in _held:
        release_worker()
        _held[owner] = {}
    if key not in _held[owner]:
        _held[owner][key] = make()
    return _held[owner][key]


def release_worker() -> None:
    """Forgets what this worker kept and gives free memory back."""
    _held.clear()
    trim_worker()


def trim_worker() -> None:
    """Gives memory that this worker has freed back to the machine; Arrow's from now on too."""
    pa.set_memory_pool(pa.system_memory_pool())
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_text(name: str) -> Column:
    """An id on its way through pandas, where whole numbers beside nulls would become floating and lose digits."""
    return F.col(name).cast("long").cast("string")


def with_id(df: DataFrame, name: str) -> DataFrame:
    """df with such a text as a long again."""
    return df.withColumn(name, F.col(name).cast("long"))


def url_host(url: Column) -> Column:
    """What is after the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    r"""org\x02example\x02www for www.example.org: a host and its subdomains are one interval of such keys."""
    return F.array_join(F.reverse(F.split(host, r"\.")), "\x02")


def range_bounds(df: DataFrame, key: str, rows_each: int, sample: int = 1 << 15) -> list[str]:
    """Keys that cut df into ranges of about rows_each rows, 4096 at most. Only where ranges begin depends on the sample of
    about ``sample`` different keys, chosen by their hashes where the table is scanned, so the driver gets no more of a
    larger table."""
    n = df.count()
    parts = min(max(1, -(-n // max(1, rows_each))), sample // 8)
    if parts < 2:
        return []
    every = max(1, n // min(sample, 64 * parts))
    seen = df.select(key).where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).distinct().limit(4 * sample)
    keys = sorted(r[0] for r in seen.collect())
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def range_number(bounds: list[str], key: Column) -> Column:
    """The number of the range that a key is in: how many bounds are not above it."""
    if not bounds:
        return F.lit(0)
    sent = SparkSession.getActiveSession().sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        b = sent.value
        return keys.map(lambda k: bisect.bisect_right(b, k)).astype("int32")

    return number(key)
