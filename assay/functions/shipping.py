"""Gets this package to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each context, so that their workers can import it; and bounds the batches
    that go to them by bytes, where the session has no bound: rows may be long texts."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES).rstrip("b") in ("67108864", str((1 << 31) - 1)):  # the defaults
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    if getattr(context, "_assay_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "assay.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("assay", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._assay_shipped = True
