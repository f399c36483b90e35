"""Dead code: definitions against references, reachability from entry points, penalties and categories.

One parse a file gives definitions, reference keys, call edges and facts about frameworks and dynamic code. Resolution, counting,
reachability and scoring are joins and columns over them.

Reference keys: a full dotted name; ``.attr`` for an attribute of anything; a simple name that isn't bound in the module. Edges go from
the enclosing definition (or ``module.<module>``, which is always a root) to such keys.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_test_path
from .graph import _cut, reachable

FACTS = "path string, kind string, name string, simple string, parent string, type string, line int, module string, extra string"
_NAMES = [x.split()[0] for x in FACTS.split(", ")]
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_IMPLICIT = re.compile(r"^(test_.*|visit_.*|leave_.*|on_.*|main|run|execute|__.*__|pytest_.*|setUp|tearDown|setUpClass|tearDownClass|setup_method|teardown_method|setup_module|teardown_module)$")
_FRAMEWORK_DECORATOR = re.compile(r"route|get|post|put|delete|validator|task|login_required|permission_required|trigger|function_name|_input$|_output$")
_FRAMEWORKS = frozenset(("flask", "django", "fastapi", "celery", "pydantic", "rest_framework", "azure", "starlette", "sanic", "tornado", "aiohttp"))
_MANAGED_BASES = re.compile(r"(BaseModel|View|ViewSet|APIView|Serializer|ModelAdmin|Command|AppConfig|Form|Middleware)$")


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else ""


class _File:
    def __init__(self, path: str) -> None:
        self.path = path
        self.module = re.sub(r"(^|\.)__init__$", "", re.sub(r"\.(py|ipynb)$", "", path).strip("/").replace("/", "."))
        self.rows: list[tuple] = []
        self.alias: dict[str, str] = {}
        self.names: set[str] = set()

    def put(self, kind: str, name: str, parent: str = "", type_: str = "", line: int | None = None, extra: str = "") -> None:
        self.rows.append((self.path, kind, name, name.rpartition(".")[2], parent, type_, line, self.module, extra))

    def read(self, tree: ast.Module) -> None:
        body = list(ast.walk(tree))
        for n in body:
            if isinstance(n, ast.Import):
                self.alias |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names}
            elif isinstance(n, ast.ImportFrom):
                base = self.absolute(n)
                self.alias |= {a.asname or a.name: f"{base}.{a.name}".strip(".") for a in n.names if a.name != "*"}
                for a in n.names:
                    if a.name == "*":
                        self.put("star", base)
            if isinstance(n, (ast.Import, ast.ImportFrom)) and (set(x.split(".")[0] for x in ([a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""])) & _FRAMEWORKS):
                self.put("framework", self.module)
        self.names = {n.name for n in tree.body if isinstance(n, (*_FUNCTION, ast.ClassDef))} | {t.id for n in tree.body if isinstance(n, (ast.Assign, ast.AnnAssign)) for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Name)}
        for n in tree.body:
            if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
                for x in n.value.elts:
                    if isinstance(x, ast.Constant) and isinstance(x.value, str):
                        self.put("export", f"{self.module}.{x.value}")
            if isinstance(n, ast.If) and self.is_main(n.test):
                for x in (y for s in n.body for y in ast.walk(s) if isinstance(y, ast.Call) and isinstance(y.func, ast.Name)):
                    self.put("ref", f"{self.module}.{x.func.id}", f"{self.module}.<module>")
        self.block(tree.body, self.module, f"{self.module}.<module>", "", None)

    def absolute(self, n: ast.ImportFrom) -> str:
        if not n.level:
            return n.module or ""
        parts = self.module.split(".") if self.module else []
        keep = len(parts) - n.level + (self.path.endswith("__init__.py"))
        return ".".join([*parts[: max(0, keep)], *([n.module] if n.module else [])])

    @staticmethod
    def is_main(test: ast.expr) -> bool:
        sides = [test.left, *test.comparators] if isinstance(test, ast.Compare) and len(test.comparators) == 1 else []
        return any(isinstance(x, ast.Name) and x.id == "__name__" for x in sides) and any(isinstance(x, ast.Constant) and x.value == "__main__" for x in sides)

    def block(self, body: list[ast.stmt], scope: str, caller: str, kind: str, owner: str | None) -> None:
        for n in body:
            if isinstance(n, (*_FUNCTION, ast.ClassDef)):
                own = f"{scope}.{n.name}"
                what = "class" if isinstance(n, ast.ClassDef) else "method" if kind == "class" else "function"
                marks = []
                for d in n.decorator_list:
                    last = _dotted(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2]
                    if _FRAMEWORK_DECORATOR.search(last.lower()):
                        marks.append("framework")
                    if last == "fixture":
                        marks.append("fixture")
                    self.refs(d, caller, owner)
                bases = [b for x in getattr(n, "bases", []) if (b := _dotted(x))]
                if any(_MANAGED_BASES.search(b) for b in bases):
                    marks.append("managed")
                if any(b.rpartition(".")[2] in ("Enum", "IntEnum", "StrEnum", "Flag") for b in bases):
                    marks.append("enum")
                if any(b.rpartition(".")[2] == "Protocol" for b in bases):
                    marks.append("protocol")
                self.put("def", own, scope, what, n.lineno, " ".join(marks))
                for b in bases:
                    self.put("base", self.key(b), own)
                    self.put("ref", self.key(b), caller)
                if isinstance(n, ast.ClassDef):
                    self.block(n.body, own, own, "class", own)
                else:
                    for x in [*n.args.defaults, *(d for d in n.args.kw_defaults if d), *([n.returns] if n.returns else []), *(a.annotation for a in [*n.args.args, *n.args.kwonlyargs] if a.annotation)]:
                        self.refs(x, caller, owner)
                    self.block(n.body, own, own, "function", owner)
                continue
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                for a in n.names:
                    if a.name != "*" and isinstance(n, ast.ImportFrom):
                        self.put("binding", f"{scope}.{a.asname or a.name}", extra=self.alias[a.asname or a.name])
                    if a.name != "*":
                        self.put("def", f"{scope}.{a.asname or a.name.split('.')[0]}", scope, "import", n.lineno, "typing" if kind == "typing" else "")
                continue
            if isinstance(n, (ast.Assign, ast.AnnAssign)) and kind in ("", "class", "typing"):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and t.id != "__all__":
                        self.put("def", f"{scope}.{t.id}", scope, "variable", n.lineno, "constant" if kind == "" and t.id.upper() == t.id and any(c.isalpha() for c in t.id) else "")
            blocks = [b for b in (getattr(n, f, None) for f in ("body", "orelse", "finalbody")) if isinstance(b, list)] + [h.body for h in getattr(n, "handlers", [])] + [c.body for c in getattr(n, "cases", [])]
            typing = isinstance(n, ast.If) and _dotted(n.test).endswith("TYPE_CHECKING")
            for x in ast.iter_child_nodes(n):
                if isinstance(x, ast.expr) and not (isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets)):
                    self.refs(x, caller, owner)
                elif isinstance(x, (ast.withitem, ast.ExceptHandler, ast.match_case)):
                    for y in ast.iter_child_nodes(x):
                        if isinstance(y, ast.expr):
                            self.refs(y, caller, owner)
            for b in blocks:
                self.block(b, scope, caller, "typing" if typing else kind, owner)

    def key(self, dotted: str) -> str:
        """The full name of a dotted one, by the file's imports and top-level names; else as it is."""
        head, dot, rest = dotted.partition(".")
        if head in self.alias:
            return self.alias[head] + dot + rest
        return f"{self.module}.{dotted}" if head in self.names else dotted

    def refs(self, tree: ast.AST, caller: str, owner: str | None) -> None:
        for n in ast.walk(tree):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                self.put("ref", self.key(n.id), caller)
                if n.id in self.alias:
                    self.put("ref", f"{self.module}.{n.id}", caller)
            elif isinstance(n, ast.Attribute):
                self.put("ref", f".{n.attr}", caller)
                name = _dotted(n)
                if owner and name.startswith(("self.", "cls.")) and name.count(".") == 1:
                    self.put("ref", f"{owner}.{n.attr}", caller)
                elif name and name.partition(".")[0] in (*self.alias, *self.names):
                    self.put("ref", self.key(name), caller)
            elif isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value.isidentifier():
                self.put("ref", n.value, caller)
            if isinstance(n, ast.Call):
                name = _dotted(n.func)
                if name in ("getattr", "hasattr", "setattr") and len(n.args) > 1:
                    if isinstance(n.args[1], ast.Constant):
                        self.put("call", f".{n.args[1].value}", caller)
                        self.put("ref", f".{n.args[1].value}", caller)
                    elif name == "getattr":
                        self.put("dynamic", caller.removesuffix(".<module>"))
                if name in ("exec", "globals", "locals") or name == "eval" and not (n.args and isinstance(n.args[0], ast.Constant)):
                    self.put("dynamic", caller.removesuffix(".<module>"))
                if name.rpartition(".")[2] in ("import_module", "__import__") and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
                    self.put("dynamic_import", n.args[0].value)
                if name == "isinstance" and len(n.args) > 1 and (seen := _dotted(n.args[1])):
                    self.put("runtime", self.key(seen))
                if owner and name.startswith(("self.", "cls.")) and name.count(".") == 1:
                    self.put("call", f"{owner}.{name.partition('.')[2]}", caller)
                if name:
                    self.put("call", self.key(name), caller)
                if isinstance(n.func, ast.Attribute):
                    self.put("call", f".{n.func.attr}", caller)


def symbols(files: DataFrame) -> DataFrame:
    """Facts of ``(path, source)`` rows for dead code. Files that don't parse, and nulls, give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                try:
                    file = _File(path)
                    file.read(ast.parse(source))
                    rows += file.rows
                except (SyntaxError, ValueError, RecursionError):
                    continue
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "line" else pa.string()) for k, c in zip(_NAMES, columns, strict=True)], _NAMES)

    return files.select("path", "source").where("path is not null and source is not null").mapInArrow(run, FACTS)


def definitions(table: DataFrame) -> DataFrame:
    flag = lambda x: F.array_contains(F.split("extra", " "), x)
    rows = table.where("kind = 'def'").withColumns({x: flag(x) for x in ("framework", "fixture", "managed", "enum", "protocol", "typing", "constant")})
    return rows.select("path", "line", "module", F.col("name").alias("full_name"), "simple", "parent", F.col("type").alias("def_type"), is_test_path(F.col("path")).alias("test"), "framework", "fixture", "managed", "enum", "protocol", "typing", "constant")


def reference_counts(table: DataFrame) -> DataFrame:
    """``(key, every, production)``: references of each key in all files and outside of tests; exports count once at least."""
    refs = table.where("kind = 'ref'").select(F.col("name").alias("key"), F.lit(1).alias("n"), F.when(is_test_path(F.col("path")), 0).otherwise(1).alias("p"))
    counts = refs.groupBy("key").agg(F.sum("n").alias("every"), F.sum("p").alias("production"))
    exports = table.where("kind = 'export'").select(F.col("name").alias("key")).distinct()
    both = counts.join(exports.withColumn("export", F.lit(1)), "key", "full_outer")
    return both.select("key", *(F.greatest(F.coalesce(c, F.lit(0)), F.coalesce("export", F.lit(0))).cast("long").alias(c) for c in ("every", "production")))


def expand_stars(table: DataFrame) -> DataFrame:
    """References to names that a star import brings: a bare name of the importer that the imported module exports in ``__all__``; names bound in the importer win."""
    stars = table.where("kind = 'star'").select("module", F.col("name").alias("source")).distinct()
    exports = table.where("kind = 'export'").select(F.col("module").alias("source"), "simple")
    bare = table.where("kind = 'ref' and name not like '%.%'").select("path", "module", F.col("name").alias("simple"), "parent")
    bound = table.where("kind = 'def'").select(F.col("parent").alias("module"), "simple").distinct()
    found = bare.join(bound, ["module", "simple"], "left_anti").join(stars, "module").join(exports, ["source", "simple"])
    return found.select("path", F.lit("ref").alias("kind"), F.concat_ws(".", "source", "simple").alias("name"), "simple", "parent", F.lit("").alias("type"), F.lit(None).cast("int").alias("line"), "module", F.lit("").alias("extra"))


def propagate_imports(table: DataFrame) -> DataFrame:
    """``(key)``: all names that referenced names stand for through chains of ``from a import b``; cycles end by themselves."""
    chain = table.where("kind = 'binding'").select(F.col("name").alias("src"), F.col("extra").alias("dst"))
    start = table.where("kind = 'ref'").select(F.col("name").alias("node")).join(chain.select(F.col("src").alias("node")), "node", "left_semi")
    return reachable(start, chain).where("depth > 0").select(F.col("node").alias("key"))


def with_imports(counts: DataFrame, every: DataFrame, production: DataFrame) -> DataFrame:
    """Reference counts of which the given keys have one at least, from all files and from those outside of tests."""
    both = counts
    for name, keys in (("e", every), ("p", production)):
        both = both.join(keys.select("key", F.lit(1).alias(name)).distinct(), "key", "full_outer")
    return both.select("key", *(F.greatest(F.coalesce(c, F.lit(0)), F.coalesce(k, F.lit(0))).cast("long").alias(c) for c, k in (("every", "e"), ("production", "p"))))


def resolved(defs: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``references`` and ``evidence`` by the cascade: the full name; for enum members Class.member; the simple name, but not for
    variables, imports and fixtures; an attribute of that name, for functions, methods and classes. Definitions outside of tests see
    references outside of tests only. The evidence weighs 1.0 for full and enum names, .35 for simple ones, .60 for attributes.
    """
    seen = lambda p: F.coalesce(F.when(F.col("test"), F.col(f"{p}_e")).otherwise(F.col(f"{p}_p")), F.lit(0))
    side = lambda key, p: counts.select(F.col("key").alias(key), F.col("every").alias(f"{p}_e"), F.col("production").alias(f"{p}_p"))
    keyed = defs.join(side("full_name", "k1"), "full_name", "left").withColumn("nk1", seen("k1")).drop("k1_e", "k1_p")
    # Few definitions are members of enums, so few counts are of Class.member, and broadcast then.
    member = F.concat_ws(".", F.substring_index("parent", ".", -1), "simple")
    wanted = _cut(defs.where("enum_member").select(member.alias("k2")).distinct())
    keyed = keyed.withColumn("k2", F.when(F.col("enum_member"), member).otherwise(F.col("full_name")))  # not null, which would all meet in a task
    keyed = keyed.join(_cut(side("k2", "k2").join(wanted, "k2", "left_semi")), "k2", "left").withColumn("nk2", seen("k2")).drop("k2", "k2_e", "k2_p")
    # The simple name and the attribute of that name come by one join: keys with no dot, and with one at their head alone.
    attribute = F.startswith("key", F.lit("."))
    short = counts.where("key not like '_%.%'").select(F.when(attribute, F.expr("substring(key, 2)")).otherwise(F.col("key")).alias("simple"), attribute.alias("attribute"), "every", "production")
    own = short.groupBy("simple").agg(*(F.max(F.when(F.col("attribute") == a, F.col(c))).alias(f"{k}_{c[0]}") for k, a in (("k3", False), ("k4", True)) for c in ("every", "production")))
    keyed = keyed.join(own, "simple", "left").withColumns({"nk3": seen("k3"), "nk4": seen("k4")}).drop("k3_e", "k3_p", "k4_e", "k4_p")
    member = F.col("enum_member")
    callable_ = F.col("def_type").isin("function", "method", "class")
    simple = ~F.col("def_type").isin("variable", "parameter", "import") & ~F.col("fixture") & ~member
    n = F.when(F.col("nk1") > 0, F.col("nk1")).when(member, F.col("nk2")).when(simple & (F.col("nk3") > 0), F.col("nk3")).when(callable_, F.col("nk4")).otherwise(0)
    weight = F.when(F.col("nk1") > 0, 1.0).when(member & (F.col("nk2") > 0), 1.0).when(simple & (F.col("nk3") > 0), 0.35).when(callable_ & (F.col("nk4") > 0), 0.6).otherwise(0.0)
    implicit = F.col("simple").rlike(_IMPLICIT.pattern)
    return keyed.withColumns({"references": F.when(implicit, F.greatest(n, F.lit(1))).otherwise(n), "evidence": F.when(implicit, 1.0).otherwise(weight)}).drop("nk1", "nk2", "nk3", "nk4")


def resolved_in_file(defs: DataFrame, table: DataFrame) -> DataFrame:
    """The rule for one file by itself: full-name references, and those of the simple name if it is unique in the file; they add up."""
    own = table.where("kind = 'ref'").groupBy("path", F.col("name").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    unique = defs.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("path", "simple")))
    full = unique.join(own.toDF("path", "full_name", "n1"), ["path", "full_name"], "left").join(own.toDF("path", "simple", "n2"), ["path", "simple"], "left")
    return full.withColumn("references", F.coalesce("n1", F.lit(0)) + F.when(F.col("same") == 1, F.coalesce("n2", F.lit(0))).otherwise(0)).drop("n1", "n2", "same")


def duck_typed(table: DataFrame, defs: DataFrame) -> DataFrame:
    """``(full_name)`` of methods that classes share with a protocol: three or more that are 70 % of it, or any if the protocol is tested by isinstance."""
    methods = defs.where("def_type = 'method'").select("parent", "simple", "full_name")
    protocols = defs.where("protocol").select(F.col("full_name").alias("protocol_name"))
    wanted = methods.join(protocols, methods["parent"] == protocols["protocol_name"]).select("protocol_name", "simple")
    sizes = wanted.groupBy("protocol_name").agg(F.count(F.lit(1)).alias("size"))
    runtime = table.where("kind = 'runtime'").select(F.col("name").alias("protocol_name"), F.lit(True).alias("runtime")).distinct()
    offered = methods.join(protocols, methods["parent"] == protocols["protocol_name"], "left_anti")
    shared = offered.join(wanted, "simple").groupBy("parent", "protocol_name").agg(F.count(F.lit(1)).alias("n")).join(sizes, "protocol_name").join(runtime, "protocol_name", "left")
    good = shared.where(((F.col("n") >= 3) & (F.col("n") >= 0.7 * F.col("size"))) | F.coalesce("runtime", F.lit(False))).select("parent", "protocol_name")
    return offered.join(good, "parent").join(wanted, ["protocol_name", "simple"], "left_semi").select("full_name").distinct()


def prefixes(name: Column) -> Column:
    """All dotted prefixes of a name, itself included."""
    parts = F.split(name, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))


def call_graph(table: DataFrame, defs: DataFrame) -> DataFrame:
    """``(src, dst)`` between definitions: exact calls and references, attributes to all methods of that name, bare names to all functions and classes of that name, classes to their bases."""
    used = table.where("kind in ('call', 'base')").select(F.col("parent").alias("src"), F.col("name").alias("key")).distinct()
    names = defs.where("def_type in ('function', 'method', 'class')").select("full_name", "simple", "def_type").distinct()
    exact = used.join(names.select(F.col("full_name").alias("key")).distinct(), "key").select("src", F.col("key").alias("dst"))
    loose = used.where("key like '.%'").withColumn("simple", F.expr("substring(key, 2)")).join(names.where("def_type = 'method'"), "simple").select("src", F.col("full_name").alias("dst"))
    bare = used.where("key not like '%.%'").join(names.where("def_type <> 'method'"), F.col("key") == F.col("simple")).select("src", F.col("full_name").alias("dst"))
    return exact.union(loose).union(bare).distinct()


def roots(table: DataFrame, defs: DataFrame, include_tests: bool = False) -> DataFrame:
    """``(node)``: modules, exports, framework-managed and decorated definitions, implicitly used names, tests if asked for, everything of dynamically imported modules, and public methods of root classes."""
    modules = table.select(F.concat("module", F.lit(".<module>")).alias("node"))
    exports = table.where("kind = 'export'").select(F.col("name").alias("node"))
    marked = F.col("managed") | F.col("framework") | F.col("simple").rlike(_IMPLICIT.pattern) | (F.lit(include_tests) & F.col("test"))
    own = defs.where(marked).select(F.col("full_name").alias("node"))
    dynamic = table.where("kind = 'dynamic_import'").select(F.col("name").alias("prefix")).distinct()
    loaded = defs.select(F.col("full_name").alias("node"), F.explode(prefixes(F.col("full_name"))).alias("prefix")).join(dynamic, "prefix").select("node")
    ducks = duck_typed(table, defs).select(F.col("full_name").alias("node"))
    first = reduce(DataFrame.union, (modules, exports, own, loaded, ducks)).distinct()
    classes = defs.where("def_type = 'class'").select(F.col("full_name").alias("node")).join(first, "node", "left_semi")
    public = defs.where("def_type = 'method' and simple not like '\\\\_%'").join(classes.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("full_name").alias("node"))
    return first.union(public).distinct()


def confidence(include_tests: bool = False) -> Column:
    """100 less the penalties of a definition, in order; 0 to 100."""
    less = lambda c, n, when: F.greatest(c - F.when(when, n).otherwise(0), F.lit(0))  # noqa: E731  (c once, or the expression doubles with every step)
    name, simple, kind = F.col("full_name"), F.col("simple"), F.col("def_type")
    method = kind == "method"
    c = F.when(F.col("framework"), 40).otherwise(100)
    c = less(c, 50, F.col("managed"))
    c = less(c, 60, method & F.contains(name, F.lit("Mixin")))
    c = less(c, 50, method & name.rlike("Base|Abstract|Interface"))
    c = less(c, 30, method & F.contains(name, F.lit("Adapter")))
    c = less(c, 30, kind.isin("method", "function") & simple.rlike("^(on_|watch_)"))
    c = less(c, 40, kind.isin("method", "function") & (simple == "compose"))
    c = less(c, 80, simple.rlike("^_([^_]|$)"))
    c = less(c, 100, simple.rlike("^__.*__$"))
    c = less(c, 60, F.col("dynamic_module"))
    c = less(c, 50, F.col("dynamic_parent") & ~F.col("dynamic_module"))
    config = simple.rlike("CONFIG|SETTING|OPTION|FLAG|DEFAULT|_ENV$")
    c = less(c, 5, F.col("constant") & ~config)
    c = less(c, 30, F.col("constant") & config)
    c = c + F.when((kind == "variable") & simple.rlike("temp|tmp|foo|bar|^debug"), 15).when((kind == "variable") & (F.length(simple) <= 2) & ~simple.startswith("_"), 10).otherwise(0)
    c = less(c, 15, F.col("path").rlike(r"(^|/)__init__[.]py$"))
    settings = (kind == "variable") & simple.rlike("^[A-Z_]+$") & F.substring_index("parent", ".", -1).rlike("(Settings|Config)$")
    visitor = method & simple.rlike("^(visit_|leave_|transform_)")
    c = F.when(settings | visitor, 0).otherwise(F.least(c, F.lit(100)))
    c = F.when(F.col("typing") & (kind == "import") & (F.col("references") > 0), 0).otherwise(c)
    tested = F.lit(not include_tests) & (F.col("test") | F.col("fixture"))
    return F.when(tested & ~F.col("fixture"), 0).when(tested, F.greatest(c - 30, F.lit(0))).otherwise(c).cast("int")


def unused(table: DataFrame, threshold: int = 60, include_tests: bool = False) -> DataFrame:
    """``(path, line, full_name, def_type, references, confidence, unreachable, category)`` of dead definitions.

    Dead is what nothing references and either can't be reached from the roots (functions, methods and classes of a confidence above 0) or
    has a confidence of ``threshold``. Methods of a dead class are dead with it, but for visitor and hook names.
    """
    table = _cut(table)
    table = table.union(_cut(expand_stars(table)))
    enums = definitions(table)
    classes = enums.where("enum and def_type = 'class'").select(F.col("full_name").alias("parent"), F.lit(True).alias("enum_member"))
    defs = enums.join(_cut(classes.distinct()), "parent", "left").withColumn("enum_member", F.coalesce("enum_member", F.lit(False)))
    scopes = _cut(table.where("kind = 'dynamic'").select(F.col("name").alias("prefix")).distinct())  # mostly few, and broadcast then
    whole = scopes.select(F.col("prefix").alias("module"), F.lit(True).alias("dynamic_module"))
    inner = defs.select("full_name", F.explode(prefixes(F.col("parent"))).alias("prefix")).join(scopes, "prefix").select("full_name", F.lit(True).alias("dynamic_parent")).distinct()
    defs = defs.join(whole, "module", "left").join(inner, "full_name", "left").na.fill(False, ["dynamic_module", "dynamic_parent"])
    defs = _cut(defs)
    counted = resolved(defs, _cut(with_imports(reference_counts(table), propagate_imports(table), propagate_imports(table.where(~is_test_path(F.col("path")))))))
    reached = reachable(roots(table, defs, include_tests), call_graph(table, defs)).select(F.col("node").alias("full_name"), F.lit(True).alias("reached"))
    callable_ = F.col("def_type").isin("function", "method", "class")
    known = counted.join(reached, "full_name", "left").withColumn("unreachable", callable_ & F.col("reached").isNull()).withColumn("confidence", confidence(include_tests))
    known = _cut(known)
    implicit = F.col("simple").rlike(_IMPLICIT.pattern)
    dead = known.where((F.col("references") == 0) & ((F.col("unreachable") & (F.col("confidence") > 0)) | (F.col("confidence") >= threshold)))
    gone = dead.where("def_type = 'class'").select(F.col("full_name").alias("parent"), F.col("unreachable").alias("parent_unreachable"))
    kept = ~F.col("simple").rlike("^(visit_|leave_|transform_|on_|watch_)|^compose$")
    promoted = known.where((F.col("def_type") == "method") & (F.col("references") > 0) & kept & ~implicit).join(gone, "parent").where((F.col("parent_unreachable") & (F.col("confidence") > 0)) | (F.col("confidence") >= threshold)).withColumn("unreachable", F.col("unreachable") | F.col("parent_unreachable"))
    config = F.col("constant") & (F.col("confidence") < 90) & F.upper("simple").rlike("CONFIG|SETTING|OPTION|FLAG|DEFAULT|_ENV$")
    category = F.when(config, "configuration_constant").when(F.col("confidence") >= 90, "definitely_unused").when(F.col("confidence") >= 60, "probably_unused").otherwise("possibly_intentional")
    columns = ("path", "line", "full_name", "def_type", "references", "confidence", "unreachable")
    return dead.select(*columns, category.alias("category")).union(promoted.select(*columns, category.alias("category"))).distinct()


def parents(defs: DataFrame) -> DataFrame:
    """``(full_name, parent_name, parent_type)``: each definition with the function or class that holds it."""
    callers = defs.where("def_type in ('function', 'method', 'class')").select(F.col("full_name").alias("parent_name"), F.col("def_type").alias("parent_type")).distinct()
    return defs.select("full_name", F.col("parent").alias("parent_name")).join(callers, "parent_name")

