r"""URL allow and block rules by a sort-merge range join.

A host and all its subdomains are one interval of reversed-host keys (org\x02example\x01... and org\x02example\x02www\x01...).
Rules and urls are dealt to the same key ranges, each rule to every range that its interval touches, and sorted; one sweep
over each range keeps a stack of the rules whose intervals are open, nested as the hosts are. Keys end in path and id, so
one host, or one url, with a third of all rows still fills many ranges. Nothing is broadcast but the range bounds (at most
4096 keys), so the rules may be as many as the urls.

Null urls and urls without :// have an empty host and path and fit no rule. Rules with a null or empty host fit nothing; a
null path is empty. Repeated rows each get a row; repeated rules count once (of those that differ in verdict only, block
wins). Of rules that fit, the one with the longest host and path together wins, then the one with the longer host.
Very long urls are read whole. An empty table gives an empty result. Columns other than the id and the url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import id_text, range_bounds, range_number, reversed_host, ship, url_host, url_path, with_id

FIRST, NESTED, PAST = "\x01", "\x02", "\x03"


class Frame:
    """The rules of one host, by path."""

    def __init__(self, name: str, host: str):
        self.name, self.host, self.paths, self.lengths = name, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if path not in self.paths or verdict == "block":
            self.paths[path] = verdict
        if len(path) not in self.lengths:
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def holds(self, key: str) -> bool:
        return key.startswith(self.name) and key[len(self.name) : len(self.name) + 1] in (FIRST, NESTED)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.paths), None)


def sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Over rows sorted by range, key and kind (rules, kind 0, before the urls of a key)."""
    stack: list[Frame] = []
    at = None
    for batch in batches:
        rules, verdicts = [], []
        for part, key, kind, host, path, verdict in zip(batch["part"], batch["key"], batch["kind"], batch["host"], batch["path"], batch["verdict"], strict=True):
            if part != at:
                stack, at = [], part
            while stack and not stack[-1].holds(key):
                stack.pop()
            if kind == 0:
                name = key[:-1]
                if not stack or stack[-1].name != name:
                    stack.append(Frame(name, host))
                stack[-1].add(path, verdict)
                continue
            best = (-1, None, default)
            for frame in stack:  # from the shortest host to the longest, which wins a tie
                if (host == frame.host or host.endswith(f".{frame.host}")) and (p := frame.longest(path)) is not None and len(frame.host) + len(p) >= best[0]:
                    best = (len(frame.host) + len(p), f"{frame.host}{p}", frame.paths[p])
            rules.append(best[1])
            verdicts.append(best[2])
        if rules:
            out = batch.loc[batch["kind"] == 1, ["page_id", "host", "path"]].copy()
            out["rule"], out["verdict"] = pd.Series(rules, dtype=object, index=out.index), verdicts
            yield out


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow", rows_each: int = 100_000) -> DataFrame:
    """rules: (verdict, host, path). Returns page_id, host, path, rule (host and path together) and verdict."""
    ship(pages.sparkSession)
    url = F.col(url_column).cast("string")
    own = pages.select(F.col(id_column).cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    own = own.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit(FIRST), "path", F.lit(FIRST), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(FIRST), F.xxhash64("page_id", "path").cast("string")))
    bounds = range_bounds(own, "key", rows_each)
    own = own.withColumn("part", range_number(bounds, F.col("key"))).select("part", "key", F.lit(1).alias("kind"), id_text("page_id").alias("page_id"), "host", "path", F.lit(None).cast("string").alias("verdict"))

    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # as in urls
    name = reversed_host(lower)
    held = rules.where(F.coalesce("host", F.lit("")) != "").select(F.concat(name, F.lit(FIRST)).alias("key"), lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    held = held.withColumn("last", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit(PAST)))
    held = held.withColumn("part", F.explode(F.sequence(range_number(bounds, F.col("key")), range_number(bounds, F.col("last")))))
    held = held.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("page_id"), "host", "path", "verdict")

    both = own.union(held)
    both = both.repartition(max(1, len(bounds) + 1), "part").sortWithinPartitions("part", "key", "kind")
    return with_id(both.mapInPandas(lambda batches: sweep(batches, default), "page_id string, host string, path string, rule string, verdict string"), "page_id")
