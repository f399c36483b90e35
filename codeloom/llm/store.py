"""Tables that cut lineage.

They are written to the shared folder named by ``spark.checkpoint.dir``, so a
lost executor costs a retry and no data. Only a local session without that
setting gets a folder of its own. Tables that a lazy result still reads can't be dropped by
the operator that wrote them; whatever is left is deleted when the application ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"{_SETTING} must name a folder that every executor can reach")
    if context.applicationId not in _own:
        path = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[context.applicationId] = f"file://{path}"
    return _own[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/codeloom-{name}-{uuid.uuid4().hex[:12]}"
    if not _left:
        atexit.register(_clear)
    _left[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    _left.pop(path, None)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for path, spark in list(_left.items()):
        try:
            delete(spark, path)
        except Exception:  # the JVM has gone
            return


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class Table:
    """A DataFrame written to the shared folder; ``drop`` removes the files once nothing reads them."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of an execution as this ends (from Spark 4.1).

    Otherwise they go when the driver happens to collect garbage, and those of the last execution never by then: Spark
    still refers to it. A DataFrame run again shuffles again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df
