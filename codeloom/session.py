"""Sessions for tests and benchmarks, and shipping of the package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """A local session with adaptive execution and as many shuffle partitions as cores."""
    conf = {
        "spark.master": f"local[{cpus}]", "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cpus), "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.config(map=conf | settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once an application, so that it needn't be installed on them."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="codeloom-ship-")
        copy = Path(folder, "source", root.name)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, root.name), "zip", copy.parent, root.name))
    return spark
