"""Control flow of functions: blocks, unreachable code, reaching definitions, and what they say of unused names."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_LEAVES = (ast.Return, ast.Raise, ast.Break, ast.Continue)


class Graph:
    """Blocks of statements with edges; block 0 is the entry and 1 the exit."""

    def __init__(self, body: list[ast.stmt], parameters: tuple[str, ...] = ()) -> None:
        self.statements: list[list[ast.AST]] = [[], []]
        self.after: list[set[int]] = [set(), set()]
        self.branches = self.loops = self.depth = 0
        self.parameters = parameters
        end = self.block(body, self.new(0), None, None, 0)
        if end is not None:
            self.after[end].add(1)

    def new(self, *before: int | None) -> int:
        self.statements.append([])
        self.after.append(set())
        for b in before:
            if b is not None:
                self.after[b].add(len(self.after) - 1)
        return len(self.after) - 1

    def block(self, body: list[ast.stmt], at: int | None, head: int | None, out: int | None, depth: int) -> int | None:
        """The block after the body, or None if nothing goes on. head and out: where continue and break lead."""
        for n in body:
            if at is None:
                at = self.new()  # unreachable
            if isinstance(n, ast.If):
                self.branches += 1
                self.statements[at].append(n.test)
                ends = [self.block(n.body, self.new(at), head, out, depth)]
                ends.append(self.block(n.orelse, self.new(at), head, out, depth) if n.orelse else at)
                at = self.new(*ends) if any(e is not None for e in ends) else None
            elif isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
                self.loops += 1
                self.depth = max(self.depth, depth + 1)
                top = self.new(at)
                self.statements[top] += [n.test] if isinstance(n, ast.While) else [n.iter, n.target]
                leave = self.new()
                end = self.block(n.body, self.new(top), top, leave, depth + 1)
                if end is not None:
                    self.after[end].add(top)
                forever = isinstance(n, ast.While) and isinstance(n.test, ast.Constant) and bool(n.test.value)
                if not forever:
                    last = self.block(n.orelse, self.new(top), head, out, depth) if n.orelse else top
                    if last is not None:
                        self.after[last].add(leave)
                at = leave
            elif isinstance(n, (ast.Try, ast.TryStar)):
                self.branches += len(n.handlers)
                first = self.new(at)
                body_end = self.block(n.body, first, head, out, depth)
                inside = range(first, len(self.after))
                ends = [self.block(n.orelse, body_end, head, out, depth) if body_end is not None else None]
                for h in n.handlers:
                    ends.append(self.block(h.body, self.new(*inside), head, out, depth))
                at = self.new(*ends) if any(e is not None for e in ends) else None
                if n.finalbody:
                    at = self.block(n.finalbody, at if at is not None else self.new(first), head, out, depth)
            elif isinstance(n, (ast.With, ast.AsyncWith)):
                self.statements[at] += [x for i in n.items for x in (i.context_expr, i.optional_vars) if x]
                at = self.block(n.body, at, head, out, depth)
            elif isinstance(n, ast.Match):
                self.branches += len(n.cases)
                self.statements[at].append(n.subject)
                ends, open_ = [], True
                for c in n.cases:
                    ends.append(self.block(c.body, self.new(at), head, out, depth))
                    open_ &= not (isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None)
                at = self.new(*ends, at if open_ else None) if open_ or any(e is not None for e in ends) else None
            else:
                self.statements[at].append(n)
                if isinstance(n, _LEAVES):
                    to = {ast.Break: out, ast.Continue: head}.get(type(n), 1)
                    if to is not None:
                        self.after[at].add(to)
                    at = None
        return at

    def reached(self) -> set[int]:
        seen, todo = {0}, [0]
        while todo:
            for b in self.after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    def unreachable_lines(self) -> list[int]:
        seen = self.reached()
        return sorted(s[0].lineno for b, s in enumerate(self.statements) if b not in seen and s)

    def reverse_postorder(self) -> list[int]:
        order, seen = [], set()

        def visit(b: int) -> None:
            todo = [(b, iter(sorted(self.after[b])))]
            seen.add(b)
            while todo:
                at, rest = todo[-1]
                for x in rest:
                    if x not in seen:
                        seen.add(x)
                        todo.append((x, iter(sorted(self.after[x]))))
                        break
                else:
                    order.append(at)
                    todo.pop()

        visit(0)
        return order[::-1]

    def unused_definitions(self) -> list[tuple[str, int]]:
        """(name, line) of assignments and parameters whose value reaches no use; names that inner functions read are left out."""
        captured = {x.id for s in self.statements for n in s for f in ast.walk(n) if isinstance(f, (*_FUNCTION, ast.Lambda)) for x in ast.walk(f) if isinstance(x, ast.Name)}
        events = [[e for n in s for e in _events(n)] for s in self.statements]
        events[0] = [("def", p, 0) for p in self.parameters]
        before: list[set[int]] = [set() for _ in self.after]
        for b, to in enumerate(self.after):
            for x in to:
                before[x].add(b)
        out: list[set] = [set() for _ in self.after]
        order = self.reverse_postorder()
        changed = True
        while changed:
            changed = False
            for b in order:
                now = set().union(*(out[x] for x in before[b])) if before[b] else set()
                for what, name, line in events[b]:
                    if what == "def":
                        now = {d for d in now if d[0] != name} | {(name, line, b)}
                if now != out[b]:
                    out[b], changed = now, True
        used = set()
        for b in order:
            live = set().union(*(out[x] for x in before[b])) if before[b] else set()
            for what, name, line in events[b]:
                if what == "use":
                    used |= {d for d in live if d[0] == name}
                else:
                    live = {d for d in live if d[0] != name} | {(name, line, b)}
        every = {(n, line, b) for b in order for what, n, line in events[b] if what == "def"}
        return sorted({(n, line) for n, line, _ in every - used if n not in captured and not n.startswith("_")})


def _events(node: ast.AST) -> list[tuple[str, str, int]]:
    """Uses and definitions of names in the order in which they happen."""
    if isinstance(node, (*_FUNCTION, ast.ClassDef)):
        return []
    names = [x for x in ast.walk(node) if isinstance(x, ast.Name)]
    uses = [("use", x.id, x.lineno) for x in names if isinstance(x.ctx, (ast.Load, ast.Del))]
    if isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
        uses.append(("use", node.target.id, node.lineno))
    return uses + [("def", x.id, x.lineno) for x in names if isinstance(x.ctx, ast.Store)]


def _functions(source: str) -> Iterator[ast.FunctionDef | ast.AsyncFunctionDef]:
    try:
        return (n for n in ast.walk(ast.parse(source)) if isinstance(n, _FUNCTION))
    except (SyntaxError, ValueError, RecursionError):
        return iter(())


_FLOW = "path string, function string, start_line int, end_line int, blocks int, depth int, branches int, loops int, kinds array<string>, unreachable array<int>, unused array<struct<name:string,line:int>>"


def flows(files: DataFrame) -> DataFrame:
    """One row a function: size of its graph, kinds of its statements with their numbers, first lines of unreachable blocks, and definitions that reach no use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, text = pa.int32(), pa.string()
        types = (text, text, number, number, number, number, number, number, pa.list_(text), pa.list_(number), pa.list_(pa.struct([("name", text), ("line", number)])))
        for batch in batches:
            rows = []
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                for f in _functions(source):
                    a = f.args
                    names = tuple(x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))] if x.arg not in ("self", "cls"))
                    g = Graph(f.body, names)
                    kinds = Counter(type(n).__name__ for s in g.statements for n in s)
                    unused = [{"name": n, "line": line or f.lineno} for n, line in g.unused_definitions()]
                    rows.append((path, f.name, f.lineno, f.end_lineno, len(g.after), g.depth, g.branches, g.loops, sorted(f"{k}:{v}" for k, v in kinds.items()), g.unreachable_lines(), unused))
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _FLOW.split(", ", 8)[:8]] + ["kinds", "unreachable", "unused"])

    return files.select("path", "source").where("path is not null and source is not null").mapInArrow(run, _FLOW)


def fingerprints(flow: DataFrame) -> DataFrame:
    """``(place, blocks, depth, branches, loops, kinds)`` of the rows of ``flows``."""
    return flow.select(F.struct("path", "start_line", "end_line").alias("place"), "blocks", "depth", "branches", "loops", "kinds")


def unreachable_code(flow: DataFrame) -> DataFrame:
    return flow.select("path", "function", F.explode("unreachable").alias("line"))


def dead_stores(flow: DataFrame) -> DataFrame:
    """``(path, function, name, line)`` of values that no use sees: what flow says beyond counting references."""
    return flow.select("path", "function", F.explode("unused").alias("u")).select("path", "function", "u.name", "u.line")


def refined(defs: DataFrame, flow: DataFrame) -> DataFrame:
    """Definitions ``(path, line, simple, references, ...)`` whose references are 0 where flow finds that the value reaches no use, unless their scope is dynamic."""
    dead = dead_stores(flow).select("path", "line", F.col("name").alias("simple"), F.lit(True).alias("dead")).distinct()
    dynamic = F.coalesce(F.col("dynamic_module"), F.lit(False)) | F.coalesce(F.col("dynamic_parent"), F.lit(False)) if {"dynamic_module", "dynamic_parent"} <= set(defs.columns) else F.lit(False)
    joined = defs.join(dead, ["path", "line", "simple"], "left")
    return joined.withColumn("references", F.when(F.coalesce("dead", F.lit(False)) & ~dynamic, 0).otherwise(F.col("references"))).drop("dead")
