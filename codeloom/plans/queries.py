"""Registered queries of the code-analysis operators, each with the SQL that answers it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import byte_entropy, lines, module_name, severity_rank, suppressed_codes, without_suppressed
from ..operators import cfg, clones, deadcode, facts, filters, fix, fixtures, graph, metrics, rules, secrets, summary, taint
from ..sources import reports
from . import corpus
from . import generated as g

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_P = "p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size % 12 AS INT) AS n, p_brand AS brand, 'm' || p_partkey || '.py' AS path FROM part)"
_LINES = "l AS (SELECT {key}, unnest(generate_series(1, len(string_split({text}, chr(10))))) AS line, unnest(string_split({text}, chr(10))) AS text FROM {table})"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits(key: str, table: str, text: str) -> str:
    values = ", ".join(f"({_quote(i)}, {_quote(n)}, {_quote(s)}, {b}, {_quote(rx)}, {k})" for k, (i, n, s, b, rx) in enumerate(secrets.PATTERNS))
    penalty = " - ".join(
        ["base", "CASE WHEN regexp_matches(text, '^\\s*#') THEN 10 ELSE 0 END", f"CASE WHEN regexp_matches(text, {_quote(secrets.PLACEHOLDER)}) THEN 30 ELSE 0 END"]
        + [f"CASE WHEN regexp_matches(text, {_quote(x)}) THEN 100 ELSE 0 END" for x in (r"(?i)#\s*(noqa|ignore)", secrets.ENV_ACCESS, secrets.PATH_OR_URL)]
    )
    return f"""
    WITH {_LINES.format(key=key, table=table, text=text)}, pat(rule_id, name, severity, base, rx, ord) AS (VALUES {values}),
    h AS (SELECT {key}, line, rule_id, name, severity, ord, least(100, greatest(0, {penalty})) AS confidence FROM l JOIN pat ON regexp_matches(l.text, pat.rx)),
    r AS (SELECT *, row_number() OVER (PARTITION BY {key}, line ORDER BY confidence DESC, ord) AS nth FROM h WHERE confidence >= 50)
    SELECT {key}, CAST(line AS BIGINT) AS line, rule_id, severity, CAST(confidence AS BIGINT) AS confidence FROM r WHERE nth = 1"""


@_query(_hits("doc_id", "documents", "text"))
def secret_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recognizers that SQL can follow, by themselves; ``secret_scan`` runs all."""
    found = secrets.secret_findings(_docs(spark, sf_dir), "doc_id", "text", entropy=False)
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "rule_id", "severity", F.col("confidence").cast("long").alias("confidence"))


@_query(_hits("page_id", "pages", "html"))
def secret_pattern_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_findings(_docs(spark, sf_dir, "pages"), "page_id", "html", entropy=False)
    return found.select("page_id", F.col("line").cast("long").alias("line"), "rule_id", "severity", F.col("confidence").cast("long").alias("confidence"))


@_query()
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_findings(_docs(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "rule_id", "severity", F.col("confidence").cast("long").alias("confidence"))


@_query()
def secret_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_findings(_docs(spark, sf_dir, "pages"), "page_id", "html")
    return found.select("page_id", F.col("line").cast("long").alias("line"), "rule_id", "severity", F.col("confidence").cast("long").alias("confidence"))


@_query()
def entropy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.entropy_hits(lines(_docs(spark, sf_dir), "doc_id", "text"), "doc_id").select("doc_id", "line", "rule_id", "matched_value", F.round("entropy", 6).alias("entropy"))


@_query("SELECT p_partkey, round(list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda c: -(len(list_filter(string_split(p_name, ''), lambda x: x = c)) / len(p_name)) * log2(len(list_filter(string_split(p_name, ''), lambda x: x = c)) / len(p_name)))), 6) AS entropy FROM part")
def name_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").select("p_partkey", F.round(byte_entropy(F.col("p_name")), 6).alias("entropy"))


_RAW = """SELECT {key}, count(*) AS loc, count(*) FILTER (trim(text) <> '' AND NOT starts_with(trim(text), '#')) AS sloc,
count(*) FILTER (starts_with(trim(text), '#')) AS comments, count(*) FILTER (trim(text) = '') AS blank FROM l GROUP BY {key}"""


@_query(f"WITH {_LINES.format(key='doc_id', table='documents', text='text')} {_RAW.format(key='doc_id')}")
def raw_line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.raw_metrics(_docs(spark, sf_dir), "doc_id", "text")


@_query(f"WITH {_LINES.format(key='doc_id', table='documents', text='text')} SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(text, '(?i)#\\s*(noqa|ignore)') GROUP BY doc_id")
def suppression_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = lines(_docs(spark, sf_dir), "doc_id", "text")
    return each.where(suppressed_codes(F.col("text")).isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_P} SELECT path, 1 + n AS cc, 1 + n AS mccabe, CASE WHEN 1 + n <= 5 THEN 'A' WHEN 1 + n <= 10 THEN 'B' ELSE 'C' END AS rank FROM p")
def cyclomatic_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = facts.facts(g.sources(spark, sf_dir, g.branches()), "function")
    return metrics.ranked(facts.functions(table)).select("path", "cc", "mccabe", "rank")


@_query(f"WITH {_P} SELECT path, 'C303' AS rule_id FROM p WHERE n > 5")
def argument_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_findings(facts.facts(g.sources(spark, sf_dir, g.arguments()), "function", "finding")).select("path", "rule_id")


@_query(f"WITH {_P} SELECT path, 'C304' AS rule_id FROM p WHERE greatest(1, 5 * n) + 1 > 50")
def function_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_findings(facts.facts(g.sources(spark, sf_dir, g.long_body()), "function", "finding")).select("path", "rule_id")


@_query(f"WITH {_P} SELECT path, n - 3 AS findings FROM p WHERE n > 3")
def nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_findings(facts.facts(g.sources(spark, sf_dir, g.nested()), "finding")).where("rule_id = 'Q302'")
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("findings"))


@_query(f"WITH {_P} SELECT path, n * (n + 1) // 2 AS cognitive FROM p")
def cognitive_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.functions(facts.facts(g.sources(spark, sf_dir, g.nested()), "function")).select("path", "cognitive")


@_query(f"WITH {_P} SELECT path, 'D001' AS rule_id, 'HIGH' AS severity, 'danger' AS category FROM p WHERE k % 7 = 0")
def danger_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.routed(rules.danger_findings(facts.facts(g.sources(spark, sf_dir, g.evals()), "call", "import", "finding")))
    return found.select("path", "rule_id", "severity", "category")


@_query(f"WITH {_P} SELECT path, 3 * n + 1 AS loc, n AS sloc, n AS comments, n + 1 AS blank FROM p")
def raw_source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.raw_metrics(g.sources(spark, sf_dir, g.padded()), "path", "source")


@_query(f"WITH {_P} SELECT path, 'S104' AS rule_id, 'CRITICAL' AS severity FROM p WHERE k % 5 = 0")
def secret_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_findings(g.sources(spark, sf_dir, g.secret()), "path", "source", path="path", entropy=False).select("path", "rule_id", "severity")


@_query(f"WITH {_P} SELECT path, 'D001' AS rule_id FROM p WHERE k % 3 <> 0")
def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = g.sources(spark, sf_dir, g.suppressed())
    found = rules.danger_findings(facts.facts(files, "call", "import", "finding"))
    return without_suppressed(found, lines(files, "path", "source"), "path").select("path", "rule_id")


@_query("""WITH RECURSIVE r(node, depth) AS (
  SELECT CAST(n_nationkey AS BIGINT) + 1, 0 FROM nation WHERE n_nationkey % 10 = 3
  UNION SELECT node // 2, depth + 1 FROM r WHERE node // 2 >= 1)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node""")
def call_graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("n_nationkey").cast("long") + 1
    nodes = _docs(spark, sf_dir, "nation")
    edges = nodes.select(number.alias("src"), F.floor(number / 2).alias("dst")).where("dst >= 1")
    reached = graph.reachable(nodes.where("n_nationkey % 10 = 3").select(number.alias("node")), edges)
    return reached.select("node", F.col("depth").cast("long").alias("depth"))


@_query(f"WITH {_P} SELECT path, 'm' || k || '.m_' || k AS full_name, 'import' AS def_type FROM p WHERE k % 2 = 1")
def unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unused_definitions(facts.facts(g.sources(spark, sf_dir, g.imports()), "def", "ref")).select("path", "full_name", "def_type")


@_query(f"WITH {_P}, q AS (SELECT length(brand) AS size, count(*) AS members FROM p GROUP BY length(brand)) SELECT size, members FROM q WHERE members > 1")
def clone_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = g.sources(spark, sf_dir, g.copies())
    groups = clones.clone_groups(clones.clone_pairs(clones.fragments(files), threshold=1.0))
    sizes = groups.withColumn("size", F.col("place.end_line") - F.col("place.start_line") - 5)
    return sizes.groupBy(F.col("size").cast("long").alias("size"), "group_place").agg(F.count(F.lit(1)).alias("members")).select("size", "members")


@_query(f"WITH {_P} SELECT path, 'input' AS source, 2 AS source_line, 'os.system' AS sink, 4 AS sink_line, 'D003' AS rule_id, 100 AS exploitability FROM p WHERE k % 4 = 0")
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.taint_findings(g.sources(spark, sf_dir, g.flows())).select("path", "source", "source_line", "sink", "sink_line", "rule_id", "exploitability")


@_query(f"WITH {_P} SELECT 'missing' AS problem, 'm_' || k AS name FROM p WHERE k % 3 <> 0 UNION ALL SELECT 'unused', 'x-' || brand FROM (SELECT DISTINCT brand FROM p)")
def dependency_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _docs(spark, sf_dir, "part")
    declared = part.select(F.concat(F.lit("x-"), F.col("p_brand")).alias("package")).distinct().unionByName(part.where("p_partkey % 3 = 0").select(F.format_string("m-%d", "p_partkey").alias("package")))
    table = facts.facts(g.sources(spark, sf_dir, g.imports()), "import")
    return graph.dependency_audit(table, declared, part.select(F.lit("local_only").alias("module")))


@_query(f"WITH {_P} SELECT path || ':2: D001 [HIGH] Use of eval' AS value FROM p WHERE k % 7 = 0")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rendered(rules.danger_findings(facts.facts(g.sources(spark, sf_dir, g.evals()), "call", "import", "finding")), "text")


@_query(f"WITH {_P} SELECT '::error file=' || path || ',line=2,title=D001::Use of eval' AS value FROM p WHERE k % 7 = 0")
def github_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rendered(rules.danger_findings(facts.facts(g.sources(spark, sf_dir, g.evals()), "call", "import", "finding")), "github")


@_query("SELECT 'pkg.sub.m' || p_partkey AS module, count(*) AS n FROM part GROUP BY 1")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").select(module_name(F.format_string("pkg/sub/m%d.py", "p_partkey")).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, k) AS nth FROM p) SELECT brand, k, n FROM r WHERE nth = 1")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = g._parts(spark, sf_dir)
    best = Window.partitionBy("brand").orderBy(F.desc("n"), "k")
    return part.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("brand", "k", "n")


@_query("""SELECT split_part(o_orderpriority, '-', 2) AS severity, count(*) AS n,
CASE split_part(o_orderpriority, '-', 2) WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS severity_rank FROM orders GROUP BY 1""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _docs(spark, sf_dir, "orders").groupBy(F.substring_index("o_orderpriority", "-", -1).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return named.withColumn("severity_rank", severity_rank(F.col("severity")).cast("int"))


@_query(corpus.expected_sql([(k, *f) for k, (_, found) in enumerate(corpus.SNIPPETS) for f in found], "rule_id, severity", "rule_id, severity", len(corpus.SNIPPETS)))
def rule_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every danger, quality and performance rule over sources whose findings are known."""
    table = facts.facts(corpus.snippet_sources(spark, sf_dir, [t for t, _ in corpus.SNIPPETS]), "call", "import", "function", "class", "finding")
    found = rules.all_findings(table)
    return found.select("path", F.col("line").cast("long").alias("line"), "rule_id", "severity")


@_query(corpus.expected_sql([(k, 1, *found) for k, (_, found) in enumerate(corpus.SECRETS) if found], "rule_id, severity, confidence", "rule_id, severity, CAST(confidence AS BIGINT) AS confidence", len(corpus.SECRETS)))
def secret_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret pattern, the suspicious assignments and the entropy recognizer over lines whose best finding is known."""
    files = corpus.snippet_sources(spark, sf_dir, [t for t, _ in corpus.SECRETS])
    assigned = facts.facts(files, "assign").select("path", "line", "name", F.col("message").alias("value"))
    found = secrets.secret_findings(files, "path", "source", path="path", assigned=assigned)
    return found.select("path", F.col("line").cast("long").alias("line"), "rule_id", "severity", F.col("confidence").cast("long").alias("confidence"))


_MI = "171 - 5.2 * ln((2 * n + 4) * log2(CASE WHEN n > 0 THEN 4 ELSE 3 END)) - 0.23 * (n + 1) - 16.2 * ln(n + 2)"


@_query(f"""WITH {_P}, g AS (SELECT max(n) + 1 AS worst, avg(least(100, greatest(0, {_MI}))) AS mi FROM p)
SELECT 'unused_percent' AS gate, CAST(100 AS DOUBLE) AS actual, CAST(5 AS DOUBLE) AS threshold, false AS passed FROM g
UNION ALL SELECT 'max_complexity', CAST(worst AS DOUBLE), 10.0, worst <= 10 FROM g UNION ALL SELECT 'min_mi', round(mi, 6), 40.0, mi >= 40 FROM g""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = g.sources(spark, sf_dir, g.branches())
    table = graph._cut(facts.facts(files, "function", "def", "ref"))  # four tables are made of one parse
    gates = metrics.quality_gates(metrics.file_metrics(metrics.source_metrics(files), facts.functions(table)), graph.unused_definitions(table), table.where("kind = 'def'"))
    return gates.withColumn("actual", F.round("actual", 6))


@_query(f"""WITH {_P} SELECT '{{"ruleId":"D001","level":"error","message":{{"text":"Use of eval"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path ||
'"}},"region":{{"startLine":2}}}}}}],"partialFingerprints":{{"primaryLocationLineHash":"' || md5(path || ':2:D001') || '"}}}}' AS value FROM p WHERE k % 7 = 0""")
def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rendered(rules.danger_findings(facts.facts(g.sources(spark, sf_dir, g.evals()), "call", "import", "finding")), "sarif")


@_query("""WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part), r(k) AS (SELECT k FROM p WHERE k % 10 = 3 OR k % 7 = 0 UNION SELECT r.k // 2 FROM r JOIN p ON p.k = r.k // 2),
d AS (SELECT k, 'f_' AS name, 'function' AS def_type, 2 AS line, k NOT IN (SELECT k FROM r) AS unreachable FROM p WHERE k % 10 <> 3 AND 2 * k NOT IN (SELECT k FROM p) AND 2 * k + 1 NOT IN (SELECT k FROM p)
UNION ALL SELECT k, 'C_', 'class', 4, true FROM p WHERE k % 10 <> 3 UNION ALL SELECT k, 'C_' || k || '.go_', 'method', 5, true FROM p WHERE k % 10 <> 3
UNION ALL SELECT k, 'C_' || k || '.idle_', 'method', 7, true FROM p UNION ALL SELECT k, 'D_', 'class', 9, true FROM p UNION ALL SELECT k, 'D_' || k || '.shared_', 'method', 10, true FROM p)
SELECT 'm' || k || '.' || name || k AS full_name, def_type, CAST(line AS BIGINT) AS line, unreachable, 'definitely_unused' AS category FROM d""")
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that nothing outside of tests references, and the methods of dead classes. Tests are roots, so what they call is reached."""
    found = deadcode.unused(deadcode.symbols(g.project(spark, sf_dir)))
    return found.select("full_name", "def_type", F.col("line").cast("long").alias("line"), "unreachable", "category")


@_query("""WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part), r(k, depth) AS (SELECT k, 1 FROM p WHERE k % 10 = 3 UNION ALL SELECT r.k // 2, depth + 1 FROM r JOIN p ON p.k = r.k // 2)
SELECT 'm' || k || '.f_' || k AS node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY k""")
def reachable_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that the call graph of a project reaches from its modules, and in how many calls."""
    table = graph._cut(deadcode.symbols(g.project(spark, sf_dir)).where("path not like 'tests/%'"))
    defs = deadcode.definitions(table)
    reached = graph.reachable(deadcode.roots(table, defs), deadcode.call_graph(table, defs))
    return reached.where("node like '%.f\\_%'").select("node", F.col("depth").cast("long").alias("depth"))


@_query(f"WITH {_P} SELECT path, 7 + n AS loc, 5 AS sloc, n AS comments, n + 1 AS single_comments, 3 AS multi, 2 AS blank FROM p")
def source_line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.source_metrics(g.sources(spark, sf_dir, g.documented()))


@_query(f"WITH {_P} SELECT path, 'unreachable' AS what, '' AS name, 5 AS line FROM p WHERE n > 0 UNION ALL SELECT path, 'dead store', 'x', 2 FROM p UNION ALL SELECT path, 'dead store', 'a', 1 FROM p")
def control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreachable blocks and values that no use sees."""
    flow = cfg.flows(g.sources(spark, sf_dir, g.halted()))
    gone = cfg.unreachable_code(flow).select("path", F.lit("unreachable").alias("what"), F.lit("").alias("name"), "line")
    return gone.union(cfg.dead_stores(flow).select("path", F.lit("dead store"), "name", "line"))


@_query(f"WITH {_P} SELECT 'b' || k || '.py' AS path, 'os.system' AS sink, 4 AS sink_line, 'input' AS source, 'D003' AS rule_id FROM p WHERE k % 3 = 0")
def cross_file_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input that comes through two functions of another file."""
    return taint.taint_findings(g.crossing(spark, sf_dir), across=True).select("path", "sink", "sink_line", "source", "rule_id")


@_query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part) SELECT 't/d' || k || '/test_a.py' AS path,
CASE WHEN k % 2 = 0 THEN 't/d' || k || '/test_a.py' WHEN k % 3 = 0 THEN 't/d' || k || '/conftest.py' ELSE 't/conftest.py' END AS fixture_path, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS rank FROM p""")
def fixture_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.resolved(fixtures.fixture_facts(g.fixtures(spark, sf_dir))).select("path", "fixture_path", "rank")


@_query(f"WITH {_P} SELECT path, 'D001' AS rule_id FROM p WHERE k % 7 = 0 AND NOT starts_with(path, 'm1') AND NOT regexp_matches(path, '^m2[0-9][.]py$')")
def ignored_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.danger_findings(facts.facts(g.sources(spark, sf_dir, g.evals()), "call", "import", "finding"))
    return filters.without_ignored(found, {"m1*.py": ("D001",), "m2[0-9].py": ("ALL",), "*.py": ("D002",)}).select("path", "rule_id")


@_query(f"WITH {_P} SELECT 'x_' || k AS simple FROM p WHERE k % 10 <> 1 AND NOT regexp_matches('x_' || k, '^x_2') AND NOT (starts_with(path, 'm3'))")
def whitelisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without those of exact, wildcard, regular and file-bound entries."""
    part = g._parts(spark, sf_dir).select(F.format_string("m%d.py", "k").alias("path"), F.format_string("x_%d", "k").alias("simple"), "k")
    exact = [(r.simple, "exact", None) for r in part.where("k % 10 = 1").select("simple").collect()]
    entries = filters.whitelist(spark, [*exact, ("x_2*", "wildcard", None), ("^x_", "regex", "m3*.py")])
    return filters.without_whitelisted(part, entries).select("simple")


_CATEGORIES = corpus.expected_sql([(k, *f) for k, (_, found) in enumerate(corpus.SNIPPETS) for f in found], "rule_id, severity", "rule_id, severity", len(corpus.SNIPPETS))


@_query(f"""SELECT CASE WHEN rule_id[1] IN ('D', 'X') THEN 'danger' ELSE 'quality' END AS category, severity, count(*) AS n,
CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS severity_rank FROM ({_CATEGORIES}) GROUP BY 1, 2, 4""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.category_counts(rules.routed(rule_corpus(spark, sf_dir)))


@_query("SELECT 'm' || p_partkey || '.py' AS path, 25 AS start, 25 + 23 + length(CAST(p_partkey AS VARCHAR)) AS \"end\" FROM part WHERE p_partkey % 4 = 0")
def fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of unused functions to remove."""
    files = g.sources(spark, sf_dir, g.text("def keep():\n    return 1\ndef f_{k}():\n    return 1\n"))
    dead = g._parts(spark, sf_dir).where("k % 4 = 0").select(g.text("m{k}.py").alias("path"), F.lit("function").alias("def_type"), g.text("m{k}.f_{k}").alias("full_name"), F.lit(3).alias("line"), F.lit(100).alias("confidence"))
    return fix.plan(files, dead).select("path", "start", "end")
