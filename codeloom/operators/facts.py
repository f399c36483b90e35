"""Facts of Python sources: one parse a file gives rows for calls, functions, classes, imports, definitions, references and statement findings.

Parsing is the one step that needs Python; it runs in Arrow batches and emits only the kinds asked for, so every rule, join and
aggregation after it is Catalyst's.
"""

from __future__ import annotations

import ast
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TEST_PATH
from .scopes import scoped_findings

_TEST = re.compile(TEST_PATH)
KINDS = ("error", "call", "function", "class", "import", "def", "ref", "edge", "assign", "docstring", "finding")
SCHEMA = "path string, kind string, name string, scope string, line int, end_line int, loop_depth int, args string, kwargs map<string,string>, metrics map<string,double>, rule_id string, severity string, message string"
_NAMES = [x.strip().split(" ")[0] for x in SCHEMA.replace("map<string,string>", "m").replace("map<string,double>", "d").split(",")]
_LOGGER = re.compile(r"^(logging|logger|log)[.](debug|info|warning|error|critical|exception)$")
_SENSITIVE = re.compile(r"(?i)password|passwd|secret|token|api_key")
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
#: Statements that hold blocks in their own scope.
_COMPOUND = frozenset((*_NESTS, ast.TryStar))
_LEAVES = frozenset((ast.Name, ast.Constant))


class _Fields(dict):
    """The fields of a class of nodes that can hold further nodes. Contexts and operators have none below; neither has what isn't a node."""

    def __init__(self, *without: str) -> None:
        self.without = frozenset(("ctx", "op", "ops", *without))

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = found = () if kind in _LEAVES else tuple(f for f in getattr(kind, "_fields", ()) if f not in self.without)
        return found


_FIELDS = _Fields()
#: Of statements: the fields that hold expressions.
_EXPRESSIONS = _Fields("body", "orelse", "finalbody", "handlers", "cases", "items", "keywords", "type_params", "names", "args")


def _below(n: ast.AST, todo: list, fields: _Fields = _FIELDS) -> None:
    """Appends what the fields of a node hold: nodes, and values that have no fields."""
    for f in fields[n.__class__]:
        x = getattr(n, f, None)
        if x.__class__ is list:
            todo += x
        elif x is not None:
            todo.append(x)


def dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *parts[::-1]])
    return "." + ".".join(parts[::-1]) if parts else None


def literal(node: ast.AST) -> bool:
    """Constants, and lists or tuples of them."""
    return isinstance(node, ast.Constant) or isinstance(node, (ast.List, ast.Tuple)) and all(map(literal, node.elts))


def _blocks(node: ast.AST) -> list[list[ast.stmt]]:
    if node.__class__ not in _COMPOUND:
        return []
    own = [getattr(node, f, []) for f in ("body", "orelse", "finalbody")]
    return own + [h.body for h in getattr(node, "handlers", [])] + [c.body for c in getattr(node, "cases", [])]


def _looped(n: ast.For | ast.AsyncFor | ast.While) -> int:
    return 1 + bool(n.orelse)


_OWN_SCOPE = frozenset((*_FUNCTION, ast.ClassDef, ast.Lambda))
_BRANCHES = {
    ast.If: lambda n: 1, ast.IfExp: lambda n: 1, ast.Assert: lambda n: 1, ast.For: _looped, ast.AsyncFor: _looped, ast.While: _looped,
    ast.Try: lambda n: len(n.handlers) + bool(n.orelse),
    ast.match_case: lambda n: not (isinstance(n.pattern, ast.MatchAs) and n.pattern.pattern is None),
    ast.BoolOp: lambda n: len(n.values) - 1, ast.comprehension: lambda n: 1 + len(n.ifs),
}


def cyclomatic(body: list[ast.stmt]) -> int:
    """1 and one for every branch, loop (and its else), handler, assert, case, boolean operator and comprehension part; nested scopes apart."""
    total, todo = 1, list(body)
    for n in todo:
        kind = n.__class__
        if kind in _OWN_SCOPE:
            continue
        if kind in _BRANCHES:
            total += _BRANCHES[kind](n)
        _below(n, todo)
    return total


def mccabe(body: list[ast.stmt]) -> int:
    """1 and one for every if, loop, handler and match statement."""
    total, todo = 1, list(body)
    while todo:
        n = todo.pop()
        if n.__class__ not in _COMPOUND:
            continue
        total += isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Match)) + len(getattr(n, "handlers", []))
        todo += [x for b in _blocks(n) for x in b]
    return total


def _choices(n: ast.stmt) -> int:
    """Boolean operators and conditional expressions of a statement; defaults of lambdas apart."""
    total, todo = 0, []
    _below(n, todo, _EXPRESSIONS)
    for x in todo:
        kind = x.__class__
        if kind in _LEAVES or kind is ast.arguments:
            continue
        total += kind is ast.BoolOp or kind is ast.IfExp
        _below(x, todo)
    return total


def cognitive(body: list[ast.stmt]) -> int:
    def block(stmts: list[ast.stmt], nest: int) -> int:
        total = 0
        for n in stmts:
            total += _choices(n)
            if isinstance(n, _FUNCTION):
                total += block(n.body, nest + 1)
            elif n.__class__ not in _COMPOUND:
                continue
            elif isinstance(n, ast.If):
                total += 1 + nest + block(n.body, nest + 1)
                chained = len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If)
                total += block(n.orelse, nest if chained else nest + 1)
            elif isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
                total += 1 + nest + block(n.body, nest + 1) + block(n.orelse, nest + 1)
            elif isinstance(n, ast.Try):
                total += block(n.body, nest) + sum(1 + nest + block(h.body, nest + 1) for h in n.handlers) + block(n.orelse, nest) + block(n.finalbody, nest)
            elif isinstance(n, ast.Match):
                total += sum(1 + nest + block(c.body, nest + 1) for c in n.cases)
            else:
                total += sum(block(b, nest) for b in _blocks(n))
        return total

    return block(body, 0)


_OPERATORS = frozenset((ast.Assign, ast.Call, ast.Attribute, ast.Subscript, ast.If, ast.For, ast.While, ast.Return, ast.FunctionDef, ast.Lambda, ast.IfExp))


def halstead(node: ast.AST) -> dict[str, float]:
    """h1 and h2 are all operators and operands, n1 and n2 the distinct ones; volume, difficulty, effort, time and bugs follow."""
    operators, operands = [], []
    todo = [node]
    for n in todo:
        kind = n.__class__
        if kind is ast.Name:
            operands.append(n.id)
            continue
        if kind is ast.Constant:
            operands.append(repr(n.value))
            continue
        if kind in _OPERATORS:
            operators.append(kind.__name__)
        elif kind is ast.BinOp or kind is ast.UnaryOp or kind is ast.AugAssign:
            operators.append(n.op.__class__.__name__)
        elif kind is ast.BoolOp:
            operators += [n.op.__class__.__name__] * (len(n.values) - 1)
        elif kind is ast.Compare:
            operators += [o.__class__.__name__ for o in n.ops]
        elif kind is ast.arg:
            operands.append(n.arg)
        _below(n, todo)
    h1, h2, n1, n2 = len(operators), len(operands), len(set(operators)), len(set(operands))
    volume = (h1 + h2) * math.log2(n1 + n2) if n1 + n2 else 0.0
    difficulty = n1 / 2 * h2 / n2 if n2 else 0.0
    effort = difficulty * volume
    return {"h1": h1, "h2": h2, "n1": n1, "n2": n2, "volume": volume, "difficulty": difficulty, "effort": effort, "time": effort / 18, "bugs": volume / 3000}


def lcom4(node: ast.ClassDef) -> int:
    """Components of the methods that share a field or call each other; dunders and static methods don't count."""
    static = lambda f: any(dotted(d) == "staticmethod" for d in f.decorator_list)
    methods = {f.name: f for f in node.body if isinstance(f, _FUNCTION) and not (f.name.startswith("__") and f.name.endswith("__")) and not static(f)}
    group = {m: m for m in methods}

    def find(x: str) -> str:
        while group[x] != x:
            x = group[x]
        return x

    owner: dict[str, str] = {}
    for name, f in methods.items():
        for n in ast.walk(f):
            if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in ("self", "cls"):
                other = n.attr if n.attr in methods else owner.setdefault(n.attr, name)
                group[find(other)] = find(name)
    return len({find(m) for m in methods})


class _Walk:
    def __init__(self, path: str, kinds: frozenset[str]) -> None:
        self.path, self.kinds, self.rows = path, kinds, []

    def put(self, kind: str, name: str | None, scope: str, node: ast.AST | None, **more) -> None:
        if kind in self.kinds:
            self.rows.append({"path": self.path, "kind": kind, "name": name, "scope": scope, "line": getattr(node, "lineno", None), "end_line": getattr(node, "end_lineno", None), **more})

    def flag(self, rule: str, severity: str, message: str, scope: str, node: ast.AST) -> None:
        self.put("finding", None, scope, node, rule_id=rule, severity=severity, message=message)

    def module(self, tree: ast.Module, name: str) -> None:
        self.block(tree.body, name, 0, 0, False)
        if "docstring" in self.kinds:
            for n in ast.walk(tree):
                if isinstance(n, (ast.Module, ast.ClassDef, *_FUNCTION)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
                    self.put("docstring", None, name, n.body[0])
        if "finding" in self.kinds:
            for rule, severity, message, node in scoped_findings(tree, bool(_TEST.search(self.path))):
                self.flag(rule, severity, message, name, node)
        if "ref" in self.kinds:
            for n in ast.walk(tree):
                if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                    self.put("ref", n.id, name, n)
                elif isinstance(n, ast.Attribute):
                    self.put("ref", n.attr, name, n)
                elif isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value.isidentifier():
                    self.put("ref", n.value, name, n)

    def block(self, body: list[ast.stmt], scope: str, nest: int, loop: int, in_class: bool) -> None:
        for n in body:
            self.statement(n, scope, nest, loop, in_class)

    def statement(self, n: ast.stmt, scope: str, nest: int, loop: int, in_class: bool) -> None:
        if isinstance(n, _FUNCTION):
            own = f"{scope}.{n.name}"
            a = n.args
            count = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
            self.put("def", own, scope, n, args="method" if in_class else "function")
            if "function" in self.kinds:
                numbers = {"cc": cyclomatic(n.body), "mccabe": mccabe(n.body), "cognitive": cognitive(n.body), "n_args": count, "length": n.end_lineno - n.lineno + 1, **halstead(n)}
                self.put("function", own, scope, n, metrics={k: float(v) for k, v in numbers.items()})
            for d in [*a.defaults, *a.kw_defaults]:
                if isinstance(d, (ast.List, ast.Dict, ast.Set)) or isinstance(d, ast.Call) and dotted(d.func) in ("list", "dict", "set"):
                    self.flag("L001", "MEDIUM", "Mutable default argument", own, d)
            for d in n.decorator_list:
                if (dotted(d) or "").split(".")[-1] == "csrf_exempt":
                    self.flag("D903", "HIGH", "View is exempt from CSRF protection", own, d)
            self.block(n.body, own, nest, 0, False)
            return
        if isinstance(n, ast.ClassDef):
            own = f"{scope}.{n.name}"
            self.put("def", own, scope, n, args="class")
            if "class" in self.kinds:
                self.put("class", own, scope, n, args=" ".join(filter(None, map(dotted, [*n.bases, *(d.func if isinstance(d, ast.Call) else d for d in n.decorator_list)]))), metrics={"lcom4": float(lcom4(n)), "cc": float(cyclomatic(n.body))})
            self.block(n.body, own, nest, loop, True)
            return
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            base = "." * n.level + (f"{n.module}." if n.module else "") if isinstance(n, ast.ImportFrom) else ""
            for alias in n.names:
                local = alias.asname or alias.name.split(".")[0]
                self.put("import", base + alias.name, scope, n, args=local)
                self.put("def", f"{scope}.{local}", scope, n, args="import")
            return
        if isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if "assign" in self.kinds and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
                    named = t.id if isinstance(t, ast.Name) else t.attr if isinstance(t, ast.Attribute) else t.slice.value if isinstance(t, ast.Subscript) and isinstance(t.slice, ast.Constant) else None
                    if isinstance(named, str):
                        self.put("assign", named, scope, n, message=n.value.value)
                if isinstance(t, ast.Name):
                    self.put("def", f"{scope}.{t.id}", scope, n, args="variable")
                    if t.id == "SECRET_KEY" and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
                        self.flag("D902", "CRITICAL", "SECRET_KEY is hard-coded", scope, n)
                    if t.id in ("host", "HOST", "bind", "BIND_ADDRESS") and isinstance(n.value, ast.Constant) and n.value.value in ("0.0.0.0", "::"):
                        self.flag("D404", "MEDIUM", "Binds to all interfaces", scope, n)
                    if t.id.isupper() and isinstance(n.value, ast.List) and n.value.elts and all(isinstance(x, ast.Constant) for x in n.value.elts) and isinstance(n, ast.Assign):
                        self.flag("P012", "LOW", "Constant list could be a tuple", scope, n)
        if isinstance(n, ast.Assert):
            self.flag("D701", "LOW", "Assertions are removed in optimised code", scope, n)
        if isinstance(n, ast.Try):
            bare = next((h for h in n.handlers if h.type is None), None)
            if bare:
                self.flag("L002", "LOW", "Bare except", scope, bare)
            if loop and len(n.body) <= 2 and any((dotted(h.type) if h.type else "") in ("KeyError", "AttributeError", "IndexError") for h in n.handlers):
                self.flag("P008", "LOW", "Exception used for control flow in a loop", scope, n)
        if isinstance(n, _NESTS):
            nest += 1
            if nest > 3:
                self.flag("Q302", "LOW", f"Nesting of {nest} blocks", scope, n)
        looped = loop + isinstance(n, (ast.For, ast.AsyncFor, ast.While))
        for field in _EXPRESSIONS[n.__class__]:
            if field in ("value", "test", "iter") and not isinstance(n, ast.Assert) and isinstance(value := getattr(n, field, None), ast.expr):
                self.expression(value, scope, loop if field == "iter" else looped)
        if n.__class__ not in _COMPOUND:
            return
        if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If):
            self.block(n.body, scope, nest, looped, in_class)
            self.statement(n.orelse[0], scope, nest - 1, looped, in_class)
            return
        for b in _blocks(n):
            self.block(b, scope, nest, looped, in_class)

    def expression(self, n: ast.AST, scope: str, loop: int) -> None:
        if n.__class__ in _LEAVES or isinstance(n, (ast.IfExp, ast.JoinedStr, ast.NamedExpr, ast.Slice)):
            return
        if isinstance(n, ast.Call):
            name = dotted(n.func)
            kinds = "".join("L" if literal(x) else "D" for x in n.args)
            named = {k.arg: json.dumps(k.value.value) if isinstance(k.value, ast.Constant) and isinstance(k.value.value, (str, int, float, bool, type(None))) else dotted(k.value) or "?" for k in n.keywords if k.arg}
            first = n.args[0].value if n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str) else None
            if name and name.endswith(".bind") and n.args and isinstance(n.args[0], ast.Tuple) and n.args[0].elts and isinstance(n.args[0].elts[0], ast.Constant) and n.args[0].elts[0].value in ("0.0.0.0", "::"):
                self.flag("D404", "MEDIUM", "Binds to all interfaces", scope, n)
            if name and _LOGGER.match(name) and any(_SENSITIVE.search(x) for a in [*n.args, *(k.value for k in n.keywords)] for y in ast.walk(a) for x in (getattr(y, "id", None), getattr(y, "attr", None), getattr(y, "value", None)) if isinstance(x, str)):
                self.flag("D901", "MEDIUM", "Log call with sensitive names", scope, n)
            self.put("call", name, scope, n, args=kinds, kwargs=named, loop_depth=loop, message=first)
            if name:
                self.put("edge", name, scope, n)
        elif isinstance(n, ast.Compare):
            for op, right in zip(n.ops, n.comparators, strict=True):
                if isinstance(op, (ast.Eq, ast.NotEq)) and isinstance(right, ast.Constant) and (right.value is None or isinstance(right.value, bool)):
                    self.flag("L003", "LOW", f"Comparison with {right.value}", scope, n)
                if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, ast.List) and (loop or len(right.elts) >= 4):
                    self.flag("P001", "MEDIUM", "Membership test in a list", scope, n)
        elif isinstance(n, ast.Attribute) and loop and (dotted(n) or "").count(".") >= 3:
            self.flag("P006", "LOW", "Long attribute chain in a loop", scope, n)
        for x in ast.iter_child_nodes(n):
            if isinstance(x, (ast.expr, ast.keyword, ast.comprehension)) and not isinstance(x, ast.Slice):
                self.expression(x.value if isinstance(x, ast.keyword) else x, scope, loop)


def file_facts(path: str, source: str, kinds: frozenset[str] = frozenset(KINDS)) -> list[dict]:
    """Fact rows of one file. A file that doesn't parse gives one row of kind error."""
    walk = _Walk(path, kinds)
    try:
        walk.module(ast.parse(source), path.removesuffix(".py").strip("/").replace("/", ".").removesuffix(".__init__"))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{"path": path, "kind": "error", "line": getattr(e, "lineno", None), "message": str(e)}] if "error" in kinds else []
    return walk.rows


def facts(files: DataFrame, *kinds: str) -> DataFrame:
    """Facts of ``(path, source)`` rows, of the given kinds or all. Rows with a null path or source give none."""
    wanted = frozenset(kinds or KINDS)
    string, number = pa.string(), pa.int32()
    types = [string, string, string, string, number, number, number, string, pa.map_(string, string), pa.map_(string, pa.float64()), string, string, string]
    schema = pa.schema(list(zip(_NAMES, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                rows += file_facts(path, source, wanted)
                if len(rows) > 20_000:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    return files.select("path", "source").where("path is not null and source is not null").mapInArrow(run, SCHEMA)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    def column(f: pa.Field) -> list:
        own = [row.get(f.name) for row in rows]
        return [None if x is None else list(x.items()) for x in own] if pa.types.is_map(f.type) else own

    return pa.RecordBatch.from_arrays([pa.array(column(f), f.type) for f in schema], schema=schema)


def functions(table: DataFrame) -> DataFrame:
    """``(path, name, line, end_line, metric...)`` of function rows."""
    names = ("cc", "mccabe", "cognitive", "n_args", "length", "h1", "h2", "n1", "n2", "volume", "difficulty", "effort", "time", "bugs")
    whole = {"cc", "mccabe", "cognitive", "n_args", "length", "h1", "h2", "n1", "n2"}
    return table.where("kind = 'function'").select("path", "name", "line", "end_line", *[F.col("metrics")[n].cast("long" if n in whole else "double").alias(n) for n in names])
