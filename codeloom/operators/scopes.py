"""Findings that need what came before in the same scope: types of names, connections, loop targets, mutated names.

One walk in statement order keeps a stack of scopes; each name maps to what it was last assigned.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

Found = tuple[str, str, str, ast.AST]  # rule id, severity, message, node
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOP = (ast.For, ast.AsyncFor, ast.While)
_COMPOUND = frozenset((*_LOOP, ast.If, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match))
_DEFAULTS = frozenset("admin administrator root password pass passwd 1234 12345 123456 password123 qwerty letmein welcome changeme default guest test secret".split())
_CREDENTIAL = ("password", "passwd", "pwd", "pass", "user", "login", "admin", "auth", "credential", "token", "secret")
_PURE = frozenset(("len", "abs", "min", "max", "sum", "round", "bool", "int", "float", "str"))
_PATH_TYPES = frozenset(("Path", "PurePath", "PosixPath", "WindowsPath"))
_METHODS = {kind.__name__: frozenset(x for x in dir(kind)) for kind in (str, bytes, list, tuple, dict, set, int, float)} | {"bool": frozenset(), "None": frozenset()}
_LITERALS = {ast.JoinedStr: "str", ast.List: "list", ast.ListComp: "list", ast.Tuple: "tuple", ast.Set: "set", ast.SetComp: "set", ast.Dict: "dict", ast.DictComp: "dict"}


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else ""


def target_names(node: ast.AST) -> Iterator[str]:
    """Names that an assignment to the node binds."""
    if isinstance(node, ast.Name):
        yield node.id
    elif isinstance(node, (ast.Tuple, ast.List)):
        for x in node.elts:
            yield from target_names(x)
    elif isinstance(node, ast.Starred):
        yield from target_names(node.value)


def _constant(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) or isinstance(node, (ast.List, ast.Tuple)) and all(map(_constant, node.elts))


def _type(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Constant):
        return "None" if node.value is None else type(node.value).__name__
    return _LITERALS.get(type(node))


def _text(node: ast.AST) -> bool:
    """An expression that is certainly a string."""
    if isinstance(node, ast.Call):
        return dotted(node.func) in ("str", "repr", "format") or isinstance(node.func, ast.Attribute) and node.func.attr == "format" and _type(node.func.value) == "str"
    return _type(node) == "str" or isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add) and (_text(node.left) or _text(node.right))


def _raw(node: ast.AST) -> bool:
    return _type(node) == "bytes" or isinstance(node, ast.Call) and dotted(node.func) in ("bytes", "bytearray", "memoryview")


def _same(a: ast.AST, b: ast.AST) -> bool:
    if isinstance(a, ast.Constant) and isinstance(b, ast.Constant):
        return isinstance(a.value, str) and a.value == b.value
    return type(a) is type(b) and bool(dotted(a)) and dotted(a) == dotted(b)


def _uses(body: list[ast.stmt], name: str) -> bool:
    return any(isinstance(x, ast.Name) and x.id == name for s in body for x in ast.walk(s))


class _Scope:
    def __init__(self) -> None:
        self.types: dict[str, str | None] = {}
        self.text: set[str] = set()
        self.raw: set[str] = set()
        self.loops: list[tuple[set[str], set[str]]] = []  # targets and mutated names of the loops around


class _Walk:
    def __init__(self, test_file: bool) -> None:
        self.found: list[Found] = []
        self.test_file = test_file
        self.scopes = [_Scope()]
        self.module_names: set[str] = set()
        self.locals: list[set[str]] = []
        self.ldap: dict[str, set[str]] = {"ldap": set(), "ldap3": set(), "class": set()}
        self.connections: dict[str, int] = {}
        self.paths: set[str] = set()
        self.depth = 0

    def add(self, rule: str, severity: str, message: str, node: ast.AST) -> None:
        self.found.append((rule, severity, message, node))

    # names

    def bind(self, names: Iterator[str], value: ast.AST | None) -> None:
        names = list(names)
        for n in names:
            (self.locals[-1] if self.locals else self.module_names).add(n)
            if self.depth:
                for _, mutated in self.scopes[-1].loops[-1:]:
                    mutated.add(n)
        if value is None:
            return
        here, kind = self.scopes[-1], _type(value)
        for n in names:
            if kind:
                here.types[n] = kind
            (here.text.add if _text(value) else here.text.discard)(n)
            (here.raw.add if _raw(value) else here.raw.discard)(n)
            if isinstance(value, ast.Call):
                if (at := self.connection(value)) is not None:
                    self.connections[n] = at
                if dotted(value.func).rpartition(".")[2] in _PATH_TYPES:
                    self.paths.add(n)

    def known(self, name: str, of: str) -> bool:
        return any(name in getattr(s, of) for s in self.scopes)

    def connection(self, node: ast.AST) -> int | None:
        """Place of the filter among the arguments of ``search`` of a connection that the call makes."""
        if not isinstance(node, ast.Call):
            return None
        module, _, last = dotted(node.func).rpartition(".")
        if last in self.ldap["class"] and not module or last == "Connection" and module in self.ldap["ldap3"]:
            return 1
        return 2 if last == "initialize" and module in self.ldap["ldap"] else None

    # statements

    def block(self, body: list[ast.stmt], loop: int) -> None:
        for n in body:
            self.statement(n, loop)

    def statement(self, n: ast.stmt, loop: int) -> None:
        self.depth = loop
        if isinstance(n, (*_FUNCTION, ast.ClassDef)):
            (self.locals[-1] if self.locals else self.module_names).add(n.name)
            self.scopes.append(_Scope())
            self.locals.append(set())
            self.block(n.body, 0 if isinstance(n, _FUNCTION) else loop)
            self.scopes.pop()
            self.locals.pop()
            return
        if isinstance(n, ast.Import):
            for a in n.names:
                if a.name in ("ldap", "ldap3"):
                    self.ldap[a.name].add(a.asname or a.name)
        elif isinstance(n, ast.ImportFrom) and n.module == "ldap3" and not n.level:
            self.ldap["class"] |= {a.asname or a.name for a in n.names if a.name == "Connection"}
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                self.bind(target_names(t), n.value)
        elif isinstance(n, ast.AugAssign):
            self.bind(target_names(n.target), None)
        if loop:
            self.concatenation(n)
        if isinstance(n, ast.If) and not self.test_file:
            self.race(n)
        inner = loop
        if isinstance(n, _LOOP):
            inner = loop + 1
            if isinstance(n, (ast.For, ast.AsyncFor)):
                self.iteration(n)
            targets = set(target_names(n.target)) if not isinstance(n, ast.While) else set()
            self.scopes[-1].loops.append((targets, set(targets)))
            self.bind(iter(targets), None)
        for field in ("value", "test", "iter"):
            x = getattr(n, field, None)
            if isinstance(x, ast.expr) and not (field == "test" and isinstance(n, ast.Assert)):
                self.expression(x, inner if field != "iter" else loop)
        if n.__class__ not in _COMPOUND:
            return
        self.depth = inner
        for body in (getattr(n, "body", []), *(h.body for h in getattr(n, "handlers", [])), getattr(n, "orelse", []), getattr(n, "finalbody", []), *(c.body for c in getattr(n, "cases", []))):
            if isinstance(body, list):
                self.block(body, inner)
        if isinstance(n, _LOOP):
            self.scopes[-1].loops.pop()
        self.depth = loop

    def concatenation(self, n: ast.stmt) -> None:
        adds = isinstance(n, ast.AugAssign) and isinstance(n.op, ast.Add) and (_text(n.value) or isinstance(n.target, ast.Name) and self.known(n.target.id, "text"))
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and isinstance(n.value, ast.BinOp) and isinstance(n.value.op, ast.Add):
            name, left = n.targets[0].id, n.value.left
            adds = isinstance(left, ast.Name) and left.id == name and (_text(n.value.right) or self.known(name, "text"))
        if adds:
            self.add("P003", "LOW", "String built by + in a loop", n)

    def iteration(self, n: ast.For) -> None:
        it, t = n.iter, n.target
        if isinstance(it, ast.Call) and isinstance(it.func, ast.Attribute) and it.func.attr == "items" and isinstance(t, ast.Tuple) and len(t.elts) == 2 and all(isinstance(x, ast.Name) for x in t.elts):
            if any(x.id == "_" or not _uses([*n.body, *n.orelse], x.id) for x in t.elts):
                self.add("P009", "LOW", "items() of which one part isn't used", it)
        if isinstance(n, ast.For) and len(n.body) == 1:
            inner = n.body[0]
            if isinstance(inner, ast.If) and len(inner.body) == 1 and not inner.orelse:
                inner = inner.body[0]
            grows = isinstance(inner, ast.Expr) and isinstance(inner.value, ast.Call) and isinstance(inner.value.func, ast.Attribute) and inner.value.func.attr in ("append", "add")
            if grows or isinstance(inner, ast.Assign) and len(inner.targets) == 1 and isinstance(inner.targets[0], ast.Subscript):
                self.add("P013", "MEDIUM", "Loop that a comprehension can replace", n)

    def race(self, n: ast.If) -> None:
        pairs, tail = [(n.test, n.body)], n.orelse
        while len(tail) == 1 and isinstance(tail[0], ast.If):
            pairs.append((tail[0].test, tail[0].body))
            tail = tail[0].orelse
        for test, body in pairs:
            checked = self.checked(test)
            if checked is not None and (self.opens(body, checked) or self.opens(tail, checked)):
                self.add("D507", "MEDIUM", "Existence check before open", n)
                return

    def checked(self, test: ast.expr) -> ast.expr | None:
        if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            return self.checked(test.operand)
        if isinstance(test, ast.BoolOp):
            return next((c for x in test.values if (c := self.checked(x)) is not None), None)
        if not isinstance(test, ast.Call):
            return None
        name = dotted(test.func)
        if name in ("os.path.exists", "os.path.isfile", "os.path.lexists", "path.exists", "path.isfile", "os.access") and test.args:
            return test.args[0]
        if isinstance(test.func, ast.Attribute) and test.func.attr in ("exists", "is_file") and self.is_path(test.func.value):
            return test.func.value
        return None

    def is_path(self, node: ast.AST) -> bool:
        return isinstance(node, ast.Name) and node.id in self.paths or isinstance(node, ast.Call) and dotted(node.func).rpartition(".")[2] in _PATH_TYPES

    def opens(self, body: list[ast.stmt], path: ast.expr) -> bool:
        for n in (x for s in body for x in ast.walk(s) if isinstance(x, ast.Call)):
            if dotted(n.func) in ("open", "io.open", "builtins.open", "os.open") and n.args and _same(n.args[0], path):
                return True
            if isinstance(n.func, ast.Attribute) and n.func.attr == "open" and self.is_path(n.func.value) and _same(n.func.value, path):
                return True
        return False

    # expressions

    def expression(self, n: ast.AST, loop: int) -> None:
        if isinstance(n, (ast.Constant, ast.IfExp, ast.JoinedStr, ast.NamedExpr, ast.Slice)):
            return
        scoped = isinstance(n, (ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp))
        if scoped:
            self.scopes.append(_Scope())
            own = [a.arg for a in n.args.args] if isinstance(n, ast.Lambda) else [x for g in n.generators for x in target_names(g.target)]
            self.scopes[-1].types.update(dict.fromkeys(own))
            if loop and isinstance(n, ast.ListComp):
                self.add("P001", "MEDIUM", "List built again in every round of a loop", n)
        if isinstance(n, ast.Call):
            self.call(n, loop)
        elif isinstance(n, ast.Compare):
            self.comparison(n)
        elif loop and isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Slice) and (_raw(n.value) or isinstance(n.value, ast.Name) and self.known(n.value.id, "raw")):
            self.add("P011", "LOW", "Slices of bytes in a loop copy", n)
        elif loop and isinstance(n, ast.Name) and len(n.id) > 1 and all(c.isupper() or c == "_" for c in n.id) and n.id in self.module_names and not any(n.id in s for s in self.locals):
            self.add("P010", "LOW", "Global read in a loop", n)
        for x in ast.iter_child_nodes(n):
            if isinstance(x, (ast.expr, ast.keyword)):
                self.expression(x.value if isinstance(x, ast.keyword) else x, loop)
            elif isinstance(x, ast.comprehension):
                for y in (x.iter, *x.ifs):
                    self.expression(y, loop)
        if scoped:
            self.scopes.pop()

    def call(self, n: ast.Call, loop: int) -> None:
        name = dotted(n.func)
        if name in ("list", "tuple") and n.args and isinstance(n.args[0], ast.Call) and dotted(n.args[0].func) in ("range", "map", "filter"):
            self.add("P004", "LOW", "Copy of an iterator that could be used itself", n)
        if name == "os.chmod":
            mode = n.args[1] if len(n.args) > 1 else next((k.value for k in n.keywords if k.arg == "mode"), None)
            if isinstance(mode, ast.Attribute) and mode.attr == "S_IWOTH" or isinstance(mode, ast.Constant) and mode.value == 0o777:
                self.add("D505", "HIGH", "File that everyone may write", n)
        if isinstance(n.func, ast.Attribute):
            method, owner = n.func.attr, n.func.value
            if isinstance(owner, ast.Name):
                kind = next((s.types[owner.id] for s in reversed(self.scopes) if owner.id in s.types), None)
                if kind in _METHODS and not (method.startswith("__") and method.endswith("__")) and method not in _METHODS[kind]:
                    self.add("D601", "HIGH", f"{kind} has no method {method}", n)
            place = self.search(method, owner)
            if place is not None:
                given = [k.value for k in n.keywords if k.arg in ("filterstr", "search_filter")] + n.args[place : place + 1]
                if any(not _constant(x) for x in given):
                    self.add("D106", "HIGH", "LDAP filter from dynamic text", n)
        if loop and name in _PURE and n.args and all(isinstance(x, ast.Name) or isinstance(x, ast.Constant) and isinstance(x.value, (str, int, float)) and not isinstance(x.value, bool) for x in n.args):
            moving = {x for targets, mutated in self.scopes[-1].loops for x in targets | mutated}
            if not moving & {x.id for x in n.args if isinstance(x, ast.Name)}:
                self.add("P007", "LOW", "Call with the same result in every round", n)

    def search(self, method: str, owner: ast.AST) -> int | None:
        made = self.connections.get(owner.id) if isinstance(owner, ast.Name) else self.connection(owner)
        if method in ("search_s", "search_st", "search_ext", "search_ext_s"):
            return 2 if made is not None or isinstance(owner, ast.Name) and owner.id in self.ldap["ldap"] else None
        return made if method == "search" else None

    def comparison(self, n: ast.Compare) -> None:
        if self.test_file or not any(isinstance(o, (ast.Eq, ast.NotEq)) for o in n.ops):
            return
        a, b = n.left, n.comparators[0]
        text, other = (b, a) if _type(b) == "str" else (a, b)
        name = other.id if isinstance(other, ast.Name) else other.attr if isinstance(other, ast.Attribute) else ""
        if isinstance(text, ast.Constant) and isinstance(text.value, str) and text.value.lower() in _DEFAULTS and any(c in name.lower() for c in _CREDENTIAL):
            self.add("D705", "HIGH", "Comparison with a well-known default credential", n)


def scoped_findings(tree: ast.Module, test_file: bool = False) -> list[Found]:
    walk = _Walk(test_file)
    walk.block(tree.body, 0)
    return walk.found
