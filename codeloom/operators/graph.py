"""Reachability over edge tables, unused definitions, and dependencies."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}
_left: dict[str, SparkSession] = {}


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    if context.applicationId not in _own:
        path = tempfile.mkdtemp(prefix="codeloom-tables-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[context.applicationId] = f"file://{path}"
    return _own[context.applicationId]


def _delete_left() -> None:
    for path, spark in list(_left.items()):
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM has gone
            return


def _cut(df: DataFrame) -> DataFrame:
    """The DataFrame as a table in the cluster's shared folder, deleted when the application ends; a local session without one has a folder of its own."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/codeloom-{uuid.uuid4().hex[:16]}"
    if not _left:
        atexit.register(_delete_left)
    _left[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, depth)`` of everything the roots reach; roots have a column node, edges src and dst.

    A frontier loop: each round joins only the nodes found in the last one and drops those seen. Null ends are ignored.
    What a round finds is written before it meets the nodes seen, so that a small frontier is broadcast to these and to the edges, and
    a long chain doesn't shuffle them in every round.
    """
    pairs = _cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    seen = _cut(roots.where("node is not null").select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = _cut(pairs.join(frontier.select("node"), pairs["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct())
        met = seen.select("node").join(step, "node", "left_semi")
        frontier = _cut(step.join(met, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


_IMPLICIT = r"[.](test_[^.]*|visit_[^.]*|leave_[^.]*|on_[^.]*|main|run|execute|__[^.]*__)$"


def unused_definitions(table: DataFrame) -> DataFrame:
    """``(path, line, full_name, def_type, confidence)`` of definitions without a reference in any file.

    A definition counts as used if its simple name is referenced anywhere; implicit entry points and tests always are.
    Confidence is 100, less 20 for imports and 30 for methods, 50 more off for private or upper-case names; those below 60 aren't reported.
    """
    defs = table.where("kind = 'def'").select("path", "line", F.col("name").alias("full_name"), F.col("args").alias("def_type"))
    simple = F.substring_index("full_name", ".", -1)
    used = table.where("kind = 'ref'").groupBy(F.col("name").alias("simple")).agg(F.count(F.lit(1)).alias("n"))
    counted = defs.withColumn("simple", simple).join(used, "simple", "left").where("n is null").where(~F.col("full_name").rlike(_IMPLICIT))
    confidence = 100 - F.when(F.col("def_type") == "import", 20).when(F.col("def_type") == "method", 30).otherwise(0) - F.when(F.col("simple").rlike("^_|^[A-Z0-9_]+$"), 50).otherwise(0)
    return counted.withColumn("confidence", confidence).where("confidence >= 60").select("path", "line", "full_name", "def_type", "confidence")


PACKAGE_MODULES = {"pillow": "pil", "beautifulsoup4": "bs4", "pyyaml": "yaml", "scikit-learn": "sklearn", "python-dateutil": "dateutil", "opencv-python": "cv2", "pyjwt": "jwt", "python-dotenv": "dotenv"}


def dependency_audit(table: DataFrame, declared: DataFrame, local_modules: DataFrame) -> DataFrame:
    """``(problem, name)``: declared packages never imported (unused) and imported modules never declared (missing).

    declared has a column package, local_modules a column module. Names compare in lower case with - as _.
    """
    import sys

    spark = table.sparkSession
    known = F.create_map(*[F.lit(x) for kv in PACKAGE_MODULES.items() for x in kv])
    package = F.lower(F.trim("package"))
    wanted = declared.where("package is not null").select("package", F.coalesce(F.try_element_at(known, package), F.regexp_replace(package, "-", "_")).alias("module")).distinct()
    top = F.lower(F.substring_index("name", ".", 1))
    standard = spark.createDataFrame([(m.lower(),) for m in sorted(sys.stdlib_module_names)], "module string")
    own = local_modules.select(F.lower("module").alias("module")).distinct()
    imported = table.where("kind = 'import' and name not like '.%'").select(top.alias("module")).distinct().join(F.broadcast(standard), "module", "left_anti").join(own, "module", "left_anti")
    unused = wanted.join(imported, "module", "left_anti").select(F.lit("unused").alias("problem"), F.col("package").alias("name"))
    missing = imported.join(wanted, "module", "left_anti").select(F.lit("missing").alias("problem"), F.col("module").alias("name"))
    return unused.unionByName(missing)
