"""Gives Python workers this package where it is not installed on them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "attestra.shipped"
#: Rows and bytes of an Arrow batch, where the session has Spark's own defaults: rows here are texts, and a batch of 10,000 is
#: held several times over by the executor and its Python worker.
_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), str(8 << 20)))


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application, and keeps Arrow batches small."""
    for key, default, small in _BATCHES:
        if spark.conf.get(key, default).removesuffix("b") in (default, "64m", "64M"):
            spark.conf.set(key, small)
    sc = spark.sparkContext
    if spark.conf.get(_SHIPPED, "") == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-attestra-"), "attestra.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("attestra", os.path.relpath(full, root)))
    sc.addPyFile(target)
    spark.conf.set(_SHIPPED, sc.applicationId)
