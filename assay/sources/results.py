"""Results of runs as tables: written whole or not at all."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class ResultStore:
    """A folder of runs. A run's tables are written below a name of their own; last comes its manifest, first under another
    name and then renamed, so a run either has one with all that it names, or doesn't count. Readers look at manifests
    alone, and ``clean`` removes what has none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join((self.folder, *parts))

    def save(self, results: dict[str, dict], tables: dict[str, DataFrame], run: str | None = None) -> str:
        """The run's name; one that exists is refused."""
        run = run or uuid.uuid4().hex
        if not re.fullmatch(r"[\w.-]+", run) or run in self.runs():
            raise ValueError(f"no name for a new run: {run}")
        attempt = f"{run}-{uuid.uuid4().hex}"
        held = {name: f"tables/{attempt}/{i}" for i, name in enumerate(sorted(tables))}
        for name, where in held.items():
            tables[name].write.parquet(self.at(where))
        text = json.dumps({"run": run, "tables": held, "results": results}, default=str)
        draft, final = self.path(self.at("drafts", attempt)), self.path(self.at("runs", f"{run}.json"))
        out = self.files.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.files.mkdirs(final.getParent())
        if self.files.exists(final) or not self.files.rename(draft, final):
            raise RuntimeError(f"another writer has made the run {run}")
        return run

    def runs(self) -> list[str]:
        where = self.path(self.at("runs"))
        return sorted(str(x.getPath().getName()).removesuffix(".json") for x in self.files.listStatus(where)) if self.files.exists(where) else []

    def manifest(self, run: str) -> dict:
        if run not in self.runs():
            raise KeyError(run)
        return json.loads("".join(r[0] for r in self.spark.read.text(self.at("runs", f"{run}.json"), wholetext=True).collect()))

    def results(self, run: str) -> dict[str, dict]:
        return self.manifest(run)["results"]

    def table(self, run: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.at(self.manifest(run)["tables"][name]))

    def drop(self, run: str) -> None:
        """The manifest goes first: readers never see a part of a run."""
        held = self.manifest(run)["tables"].values()
        self.files.delete(self.path(self.at("runs", f"{run}.json")), False)
        for where in {x.rpartition("/")[0] for x in held}:
            self.files.delete(self.path(self.at(where)), True)

    def clean(self) -> int:
        """Removes tables and drafts that no manifest names, as killed runs leave them; not to be called while one writes."""
        named = {x.split("/")[1] for run in self.runs() for x in self.manifest(run)["tables"].values()}
        gone = 0
        for folder in ("tables", "drafts"):
            where = self.path(self.at(folder))
            for x in self.files.listStatus(where) if self.files.exists(where) else []:
                if str(x.getPath().getName()) not in named:
                    self.files.delete(x.getPath(), True)
                    gone += 1
        return gone
