"""Python sources generated from the part table: their analysis has closed-form answers that SQL can compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").cast("long").alias("k"), (F.col("p_size") % 12).cast("int").alias("n"), F.col("p_brand").alias("brand"))


def _spread_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts from which sources are made: the table is small and read as a task or two, their parse is not."""
    return spread(_parts(spark, sf_dir), "k")


def sources(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """``(path, source)`` of one file a part; ``text`` may use k, n and brand."""
    return _spread_parts(spark, sf_dir).select(F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".py")).alias("path"), text.alias("source"))


def branches() -> Column:
    return F.concat(F.format_string("def f_%d(x):\n", "k"), F.repeat(F.lit("    if x: pass\n"), F.col("n")), F.lit("    return x\n"))


def arguments() -> Column:
    names = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.concat(F.lit("a"), i.cast("string"))), ", ")).otherwise("")
    return F.format_string("def f_%d(%s):\n    pass\n", F.col("k"), names)


def long_body() -> Column:
    return F.concat(F.format_string("def f_%d():\n", "k"), F.repeat(F.lit("    x = 1\n"), F.greatest(F.lit(1), F.col("n") * 5)))


def nested() -> Column:
    deep = F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.concat(F.repeat(F.lit(" "), i), F.lit("if x:\n")))
    return F.concat(F.format_string("def f_%d(x):\n", "k"), F.when(F.col("n") > 0, F.array_join(deep, "")).otherwise(""), F.repeat(F.lit(" "), F.col("n") + 1), F.lit("pass\n"))


def evals() -> Column:
    return F.when(F.col("k") % 7 == 0, F.lit("def f(x):\n    return eval(x)\n")).otherwise(F.lit("def f(x):\n    return x\n"))


def padded() -> Column:
    return F.concat(F.repeat(F.lit("\n"), F.col("n")), F.repeat(F.lit("# c\n"), F.col("n")), F.repeat(F.lit("x = 1\n"), F.col("n")))


def secret() -> Column:
    token = F.substring(F.concat(F.md5(F.col("k").cast("string")), F.md5(F.col("k").cast("string"))), 1, 36)
    return F.when(F.col("k") % 5 == 0, F.concat(F.lit('x = "ghp_'), token, F.lit('"\n'))).otherwise(F.lit("x = 1\n"))


def suppressed() -> Column:
    return F.concat(F.lit("eval(x)"), F.when(F.col("k") % 3 == 0, "  # noqa").when(F.col("k") % 3 == 1, "  # noqa: D002").otherwise(""), F.lit("\n"))


def imports() -> Column:
    return F.concat(F.format_string("import m_%d\n", "k"), F.when(F.col("k") % 2 == 0, F.format_string("m_%d.go()\n", "k")).otherwise(""))


def copies() -> Column:
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.length("brand") + 4), lambda i: F.concat(F.format_string("    v%d_", "k"), i.cast("string"), F.lit(" = a + 1\n"))), "")
    return F.concat(F.format_string("def f_%d(a):\n", "k"), body, F.lit("    return a\n"))


def flows() -> Column:
    return F.when(F.col("k") % 4 == 0, F.lit("import os\nx = input()\ny = x\nos.system(y)\n")).when(F.col("k") % 4 == 1, F.lit("import os, shlex\nx = input()\nos.system(shlex.quote(x))\n")).otherwise(F.lit("x = 1\n"))


def text(pattern: str) -> Column:
    """The pattern with {k} as the part's number, {p} half of it and {q} a third (rounded down)."""
    out = F.lit(pattern)
    for name, value in (("{k}", F.col("k")), ("{p}", F.floor(F.col("k") / 2)), ("{q}", F.floor(F.col("k") / 3))):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


MODULE = """import m{p}
def f_{k}():
    return m{p}.f_{p}()
class C_{k}:
    def go_{k}(self):
        return 1
    def idle_{k}(self):
        return 2
class D_{k}:
    def shared_{k}(self):
        return 3
thing.shared_{k}
"""


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module a part that calls that of half its number; every tenth is used at its own top level, and every seventh by a test alone."""
    part = _spread_parts(spark, sf_dir)
    used = F.when(F.col("k") % 10 == 3, text("f_{k}()\nC_{k}().go_{k}()\n")).otherwise("")
    modules = part.select(text("m{k}.py").alias("path"), F.concat(text(MODULE), used).alias("source"))
    tests = part.where("k % 7 = 0").select(text("tests/test_m{k}.py").alias("path"), text("from m{k} import f_{k}\ndef test_{k}():\n    f_{k}()\n").alias("source"))
    return modules.union(tests)


def documented() -> Column:
    return F.concat(text('def f_{k}():\n    """One\n    # two\n\n    three"""\n'), F.repeat(F.lit("    # note\n"), F.col("n")), F.lit("    x = 1  # after\n"))


def halted() -> Column:
    return F.concat(F.lit("def f(a):\n    x = 1\n    x = 2\n    return x\n"), F.repeat(F.lit("    y = 3\n"), F.col("n")))


def crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files a part: one returns input through two functions, the other runs it, or a constant instead."""
    part = _spread_parts(spark, sf_dir)
    give = F.when(F.col("k") % 3 == 0, text("def inner():\n    return input()\ndef get():\n    value = inner()\n    return value\n")).otherwise(text("def get():\n    return 'a'\n"))
    run = text("import os\nfrom a{k} import get\ndef go():\n    os.system(get())\n")
    return part.select(text("a{k}.py").alias("path"), give.alias("source")).union(part.select(text("b{k}.py").alias("path"), run.alias("source")))


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder a part with a conftest below one for all: the nearer definition wins, and even parts define the fixture in the test file itself."""
    part = _spread_parts(spark, sf_dir)
    one = "import pytest\n@pytest.fixture\ndef fx():\n    return 1\n"
    near = part.where("k % 3 = 0").select(text("t/d{k}/conftest.py").alias("path"), F.lit(one).alias("source"))
    test = part.select(text("t/d{k}/test_a.py").alias("path"), F.concat(F.when(F.col("k") % 2 == 0, F.lit(one)).otherwise(""), F.lit("def test_x(fx):\n    pass\n")).alias("source"))
    return near.union(test).union(spark.createDataFrame([("t/conftest.py", one)], "path string, source string"))
