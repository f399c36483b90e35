"""Source-to-sink data flow inside functions and through what they return.

Every function is interpreted: sources taint names, assignments and expressions carry the taint, sanitizers
stop it, and a tainted dangerous argument of a sink is a finding. The interpretation needs the syntax tree and runs in
Arrow batches; scores and dedupe are columns.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .facts import dotted
from .graph import _cut

#: Call names whose result is tainted, attribute chains that are, and what a sink's tainted argument means.
SOURCES = re.compile(r"^(input|os[.]getenv|os[.]environ[.]get|request[.](get_json|get_data)|request[.](args|form|values|cookies|headers|GET|POST)[.](get|getlist)|req[.](get_json|get_body|params[.]get)|json[.]loads?|yaml[.](safe_)?load|.*[.]read(line|lines)?)$")
ATTRIBUTES = re.compile(r"^(sys[.]argv|os[.]environ|request[.](args|form|data|json|values|cookies|headers|files|GET|POST|body)|req[.](params|headers))$")
SANITIZER = re.compile(r"(^|[.])(int|float|bool|len|quote|shlex[.]quote|escape|html[.]escape|secure_filename|basename|sanitize_\w+|escape_\w+|encode_\w+|clean_\w+|\w+_(sanitized|escaped|encoded|cleaned))$")
SINKS = (
    (r"^(eval|exec|compile)$", "D001", "CodeInjection", "CRITICAL"),
    (r"[.](execute|executemany|executescript)$", "D101", "SqlInjection", "CRITICAL"),
    (r"(^|[.])(raw|text|read_sql|read_sql_query)$", "D102", "SqlInjection", "CRITICAL"),
    (r"^os[.](system|popen)$|^subprocess[.](run|call|Popen|check_call|check_output)$", "D003", "CommandInjection", "CRITICAL"),
    (r"^open$|^shutil[.]\w+$|^os[.](remove|unlink|rename|makedirs|listdir)$", "D501", "PathTraversal", "HIGH"),
    (r"^(requests|httpx)[.]\w+$|(^|[.])urlopen$", "D402", "Ssrf", "CRITICAL"),
    (r"(^|[.])redirect$", "D801", "OpenRedirect", "MEDIUM"),
    (r"(^|[.])(Markup|mark_safe|HttpResponse|HTMLResponse|render_template_string)$", "X001", "Xss", "HIGH"),
    (r"^(pickle|marshal|dill)[.]loads?$", "D201", "Deserialization", "CRITICAL"),
)
_RULES = [(re.compile(p), *rest) for p, *rest in SINKS]
FLOW = "path string, function string, source string, source_line int, sink string, sink_line int, rule_id string, vuln_type string, severity string, hops int"


class _Flow:
    """One function. ``summaries``: source of what functions return, by the name they are called by."""

    def __init__(self, path: str, name: str, summaries: dict[str, str] | None = None) -> None:
        self.path, self.name, self.rows, self.summaries, self.returned = path, name, [], summaries or {}, None

    def taint(self, n: ast.AST | None, state: dict) -> tuple[str, int, int] | None:
        """(source, line, hops) of an expression; the first found wins."""
        if n is None or isinstance(n, ast.Constant):
            return None
        if isinstance(n, ast.Name):
            return state.get(n.id)
        name = dotted(n) if isinstance(n, ast.Attribute) else None
        if name and ATTRIBUTES.match(name):
            return name, n.lineno, 0
        if isinstance(n, ast.Call):
            called = dotted(n.func) or ""
            if SANITIZER.search(called):
                return None
            if SOURCES.match(called):
                return called, n.lineno, 0
            if called in self.summaries:
                return self.summaries[called], n.lineno, 1
            parts = [*n.args, *(k.value for k in n.keywords), *([n.func.value] if isinstance(n.func, ast.Attribute) else [])]
        elif isinstance(n, ast.IfExp):
            parts = [n.body, n.orelse]
        elif isinstance(n, (ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            return None
        else:
            parts = [x for x in ast.iter_child_nodes(n) if isinstance(x, ast.expr)]
        return next((t for x in parts if (t := self.taint(x, state))), None)

    def sinks(self, n: ast.AST, state: dict) -> None:
        for call in (x for x in ast.walk(n) if isinstance(x, ast.Call)):
            called = dotted(call.func) or ""
            for pattern, rule, kind, severity in _RULES:
                if not pattern.search(called) or called.endswith((".execute", ".executemany")) and len(call.args) > 1:
                    continue
                found = next((t for x in [*call.args[:2], *(k.value for k in call.keywords)] if (t := self.taint(x, state))), None)
                if found:
                    self.rows.append((self.path, self.name, found[0], found[1], called, call.lineno, rule, kind, severity, found[2]))
                    break

    def run(self, body: list[ast.stmt], state: dict) -> dict:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            for x in ast.iter_child_nodes(n):
                if isinstance(x, ast.expr):
                    self.sinks(x, state)
            if isinstance(n, ast.Return) and n.value is not None and self.returned is None:
                found = self.taint(n.value, state)
                self.returned = found[0] if found and not found[0].startswith("function param") else None
            if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                found = self.taint(n.value, state)
                if found:
                    for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                        for name in ast.walk(t):
                            if isinstance(name, ast.Name):
                                state[name.id] = (found[0], found[1], found[2] + 1)
            elif isinstance(n, (ast.For, ast.AsyncFor)) and (found := self.taint(n.iter, state)):
                for name in ast.walk(n.target):
                    if isinstance(name, ast.Name):
                        state[name.id] = (found[0], found[1], found[2] + 1)
            if isinstance(n, ast.If):
                state = self.run(n.body, dict(state)) | self.run(n.orelse, dict(state))
            else:
                for block in (getattr(n, "body", None), *(h.body for h in getattr(n, "handlers", [])), getattr(n, "orelse", None), getattr(n, "finalbody", None)):
                    if isinstance(block, list):
                        state = self.run(block, state)
        return state


_WEB = re.compile(r"(^|[.])(Query|Path|Body|Form|Header|Cookie)$")


def _parameters(f: ast.FunctionDef | ast.AsyncFunctionDef) -> dict[str, tuple[str, int, int]]:
    a = f.args
    own = {x.arg: (f"function param: {x.arg}", f.lineno, 0) for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.arg not in ("self", "cls")}
    for x, d in [*zip([*a.posonlyargs, *a.args][len(a.posonlyargs) + len(a.args) - len(a.defaults) :], a.defaults, strict=True), *zip(a.kwonlyargs, a.kw_defaults, strict=True)]:
        if isinstance(d, ast.Call) and _WEB.search(dotted(d.func) or ""):
            own[x.arg] = (f"request param: {x.arg}", f.lineno, 0)
    return own


def _imports(nodes: list[ast.AST]) -> dict[str, str]:
    """Local name of every imported one and what it stands for."""
    out = {}
    for n in nodes:
        if isinstance(n, ast.ImportFrom) and n.module and not n.level:
            out |= {a.asname or a.name: f"{n.module}.{a.name}" for a in n.names}
        elif isinstance(n, ast.Import):
            out |= {a.asname or a.name: a.name for a in n.names}
    return out


def _module(path: str) -> str:
    return path.removesuffix(".py").strip("/").replace("/", ".").removesuffix(".__init__")


def _imported_calls(nodes: list[ast.AST]) -> list[tuple[str, str]]:
    """(called name, full name that it stands for by an import), of equal called names in the order of the imports."""
    names = _imports(nodes)
    if not names:
        return []
    place = {local: k for k, local in enumerate(names)}
    found = []
    for called in dict.fromkeys(dotted(n.func) or "" for n in nodes if isinstance(n, ast.Call)):
        ends = [k for k, c in enumerate(called) if c == "."] + [len(called)]
        found += [(called, names[x] + called[len(x) :]) for x in sorted((called[:k] for k in ends if called[:k] in names), key=place.__getitem__)]
    return found


def file_flows(path: str, source: str, known: dict[str, str] | None = None) -> tuple[list[tuple], dict[str, str], list[str]]:
    """Flows of a file's functions and module level, the sources that its functions return by full name, and the full names of imported
    functions that it calls; nothing if it doesn't parse.

    known: returned sources by full name of functions anywhere, of which only those that the file calls matter. Functions of the
    file are summed up until nothing changes, so a source goes through any chain of returns.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], {}, []
    nodes = list(ast.walk(tree))
    functions = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    imported, module = _imported_calls(nodes), _module(path)
    summaries = {called: known[full] for called, full in imported if full in known} if known else {}
    returned: dict[str, str] = {}
    while True:
        before = len(returned)
        for n in functions:
            flow = _Flow(path, n.name, summaries | returned)
            flow.run(n.body, _parameters(n))
            if flow.returned:
                returned.setdefault(n.name, flow.returned)
        if len(returned) == before:
            break
    rows = []
    top = _Flow(path, "<module>", summaries | returned)
    top.run(tree.body, {})
    rows += top.rows
    for n in functions:
        flow = _Flow(path, n.name, summaries | returned)
        flow.run(n.body, _parameters(n))
        rows += flow.rows
    return rows, {f"{module}.{k}": v for k, v in returned.items()}, list(dict.fromkeys(full for _, full in imported))


#: A flow; or of kind return, a function ``name`` and the source it returns; or of kind call, an imported ``name`` that the file calls.
_SUMMARY = f"{FLOW}, kind string, name string"


def _summaries(files: DataFrame) -> DataFrame:
    """Rows of ``_SUMMARY`` for ``(path, source)`` rows, or for ``(path, source, known)`` with an array of the returned sources (name, source) that matter."""
    fields = [x.split() for x in _SUMMARY.split(", ")]
    wide = len(FLOW.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32() if t == "int" else pa.string() for _, t in fields]
        for batch in batches:
            known = batch.column("known").to_pylist() if "known" in batch.schema.names else [[]] * batch.num_rows
            rows = []
            for path, source, own in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), known, strict=True):
                flows, returned, called = file_flows(path, source, {x["name"]: x["source"] for x in own})
                rows += [(*r, "flow", None) for r in flows]
                rows += [(path, None, origin, *[None] * (wide - 3), "return", name) for name, origin in returned.items()]
                rows += [(path, *[None] * (wide - 1), "call", name) for name in called]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [n for n, _ in fields])

    return files.where("path is not null and source is not null").mapInArrow(run, _SUMMARY)


def _returned(rows: DataFrame) -> DataFrame:
    """``(name, source)``: the first of the sources that functions of a full name return."""
    return rows.where("kind = 'return'").groupBy("name").agg(F.min("source").alias("source"))


def _across(files: DataFrame) -> DataFrame:
    """Flows with what imported functions of other files return, to any depth.

    Each file is parsed once, and those that call a function known to return a source again with what they call, until no new function
    is known. Calls meet known functions in a join, so neither number has a bound and a file gets no more than it calls.
    """
    files = files.select("path", "source")
    first = _cut(_summaries(files))
    calls = first.where("kind = 'call'").select("path", "name")
    known = _cut(_returned(first))
    while True:
        met = _cut(calls.join(known, "name").groupBy("path").agg(F.collect_set(F.struct("name", "source")).alias("known")))
        again = _cut(_summaries(files.join(met, "path")))
        rows = first.join(met, "path", "left_anti").unionByName(again)
        now = _cut(_returned(rows))
        if now.join(known, "name", "left_anti").isEmpty() and known.join(now, "name", "left_anti").isEmpty():
            return rows
        known = now


def taint_findings(files: DataFrame, across: bool = False) -> DataFrame:
    """Flows with an exploitability of 0 to 100, one for each path, sink line and source line. across: also from functions of other files that return a source."""
    rows = _across(files) if across else _summaries(files.select("path", "source"))
    found = rows.where("kind = 'flow'").drop("kind", "name")
    base = F.when(F.col("severity") == "CRITICAL", 90).when(F.col("severity") == "HIGH", 75).when(F.col("severity") == "MEDIUM", 60).otherwise(45)
    kind = F.when(F.col("vuln_type").isin("CodeInjection", "CommandInjection"), 10).when(F.col("vuln_type").isin("SqlInjection", "Deserialization"), 8).when(F.col("vuln_type") == "PathTraversal", 6).when(F.col("vuln_type") == "Ssrf", 5).when(F.col("vuln_type") == "Xss", 4).otherwise(2)
    origin = F.when(F.col("source").rlike("^(request|req|input)"), 8).when(F.col("source").rlike("^(sys|os)"), 5).when(F.col("source").rlike("^function param"), 2).otherwise(3)
    score = F.least(F.lit(100), F.greatest(F.lit(0), base + kind + origin - 2 * (F.col("hops") - 1)))
    first = Window.partitionBy("path", "sink_line", "source_line").orderBy("rule_id", "function", "source")
    return found.withColumn("exploitability", score).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def bumped(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """Raises the severity of injection findings on a line that a source other than a parameter reaches."""
    hit = flows.where("source not like 'function param:%'").select("path", F.col("sink_line").alias("line"), F.lit(True).alias("hit")).distinct()
    up = F.when(F.col("severity") == "HIGH", "CRITICAL").when(F.col("severity") == "MEDIUM", "HIGH").otherwise(F.col("severity"))
    joined = findings.join(hit, ["path", "line"], "left")
    return joined.withColumn("severity", F.when(F.col("hit") & F.col("rule_id").isin("D001", "D002", "D003", "D101", "D102", "D402", "D501"), up).otherwise(F.col("severity"))).drop("hit")
