"""Danger, quality and performance rules as predicates over the fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import severity_rank




def _args() -> Column:
    return F.coalesce(F.col("args"), F.lit(""))


def _is(*names: str) -> Column:
    return F.col("name").isin(*names)


def _like(pattern: str) -> Column:
    return F.col("name").rlike(pattern)


def _dynamic(place: int = 0) -> Column:
    """The positional argument is there and not a constant; a missing one counts as constant."""
    return F.substring(F.coalesce(F.col("args"), F.lit("")), place + 1, 1) == "D"


def _kw(name: str) -> Column:
    return F.col("kwargs")[name]


def _kw_is(name: str, *values: str) -> Column:
    return F.coalesce(_kw(name).isin(*values), F.lit(False))


def _kw_dynamic(*names: str) -> Column:
    """A keyword argument of one of these names that is not a JSON constant."""
    return reduce(lambda a, b: a | b, [F.coalesce(~_kw(n).rlike(r'^(".*"|-?[0-9].*|true|false|null)$'), F.lit(False)) for n in names])


def _no_kw(name: str) -> Column:
    return _kw(name).isNull()


#: id, emitted severity, message, predicate over call rows.
def danger_rules() -> list[tuple[str, str, str, Column]]:
    text = F.lower(F.coalesce(F.col("message"), F.lit("")))
    verbs = r"^(requests|httpx)[.](get|post|put|delete|head|patch|options|request)$"
    return [
        ("D001", "HIGH", "Use of eval", _is("eval")),
        ("D002", "HIGH", "Use of exec", _is("exec")),
        ("D003", "CRITICAL", "Shell command from dynamic text", _is("os.system") & _dynamic() | _like(r"^subprocess[.]") & _kw_is("shell", "true") & (_dynamic() | _kw_dynamic("args"))),
        ("D004", "CRITICAL", "Process started from dynamic text", _is("asyncio.create_subprocess_shell") & _dynamic()),
        ("D004", "HIGH", "Process started from dynamic text", (_like(r"^os[.]popen[234]?$") | _is("pty.spawn")) & _dynamic()),
        ("D005", "HIGH", "Use of input", _is("input")),
        ("D006", "HIGH", "Change of privileges", _like(r"(^|[.])set(uid|gid|euid|egid|reuid|regid|resuid|resgid|groups)$")),
        ("D101", "CRITICAL", "SQL built from dynamic text", _like(r"[.](execute|executemany)$") & _dynamic()),
        ("D102", "CRITICAL", "Raw SQL from dynamic text", _like(r"(^|[.])(raw|text|read_sql|read_sql_query|read_sql_table|prepare_query|executescript)$") & _dynamic() | _like(r"[.](substitute|safe_substitute)$") & (_dynamic() | (F.size("kwargs") > 0))),
        ("D103", "HIGH", "Markup from dynamic text", _like(r"(^|[.])(Markup|render_template_string|HTMLResponse)$") & (_dynamic() | _kw_dynamic("content", "source", "html"))),
        ("D104", "MEDIUM", "XML parser open to entity attacks", _like(r"(^|[.])(ElementTree|etree|minidom|sax|pulldom|expatbuilder)[.](parse|fromstring|parseString|iterparse|XMLParser|make_parser)$") & ~_like("^lxml") & ~_kw_is("resolve_entities", "false")),
        ("D104", "HIGH", "XML parser open to entity attacks", _like(r"^lxml[.].*(parse|fromstring|XMLParser)$") & ~_kw_is("resolve_entities", "false")),
        ("D105", "MEDIUM", "Use of mark_safe", _like(r"(^|[.])mark_safe$")),
        ("D107", "HIGH", "XPath from dynamic text", _like(r"(^|[.])(XPath|xpath)$") & _dynamic()),
        ("D201", "CRITICAL", "Unsafe deserialisation", _like(r"^(pickle|cPickle|dill|_pickle)[.](load|loads|Unpickler)$|^shelve[.]open$|^jsonpickle[.]decode$|^(pandas|pd)[.]read_pickle$")),
        ("D202", "HIGH", "yaml.load without a safe loader", _is("yaml.load") & ~F.coalesce(_kw("Loader").rlike(r"SafeLoader$"), F.lit(False))),
        ("D203", "MEDIUM", "Unsafe deserialisation", _is("marshal.load", "marshal.loads")),
        ("D204", "CRITICAL", "Model loading can run code", _is("torch.load") & ~_kw_is("weights_only", "true")),
        ("D204", "HIGH", "Model loading can run code", _is("joblib.load") | _like(r"(^|[.])load_model$") & _like("keras|^load_model") & ~_kw_is("safe_mode", "true")),
        ("D301", "MEDIUM", "Weak hash", _is("hashlib.md5") | _is("hashlib.new") & text.isin("md4", "md5") | _like(r"Hash[.]MD[245][.]|(^|[.])hashes[.]MD5$")),
        ("D302", "MEDIUM", "Weak hash", _is("hashlib.sha1") | _is("hashlib.new") & text.isin("sha1") | _like(r"(^|[.])hashes[.]SHA1$")),
        ("D304", "HIGH", "Weak cipher", _like(r"(^|[.])(ARC2|ARC4|Blowfish|DES|XOR|TripleDES)([.]new)?$")),
        ("D305", "MEDIUM", "ECB mode", _like(r"(^|[.])modes[.]ECB$")),
        ("D306", "HIGH", "Low-level cryptographic binding", _like(r"^nacl[.]bindings[.]")),
        ("D311", "LOW", "Generator isn't cryptographic", _like(r"^random[.](Random|random|randrange|randint|choice|choices|uniform|triangular|randbytes|getrandbits|sample)$")),
        ("D401", "HIGH", "Certificate check is off", _like(r"^requests[.]") & _kw_is("verify", "false")),
        ("D402", "CRITICAL", "Request to a dynamic address", _like(verbs) & ~_like("[.]request$") & (_dynamic() | _kw_dynamic("url", "uri", "address")) | _like(r"^(requests|httpx)[.]request$") & (_dynamic(1) | _kw_dynamic("url")) | _like(r"(^|[.])urlopen$") & _dynamic()),
        ("D403", "HIGH", "Debug mode", _like(r"([.]run|(^|[.])run_simple)$") & _kw_is("debug", "true")),
        ("D404", "MEDIUM", "Binds to all interfaces", _kw_is("host", '"0.0.0.0"', '"::"') | _kw_is("bind", '"0.0.0.0"', '"::"')),
        ("D405", "MEDIUM", "Request without timeout", _like(verbs) & (_no_kw("timeout") | _kw_is("timeout", "null", "false", "0"))),
        ("D406", "HIGH", "FTP is plain text", _like(r"^ftplib[.]")),
        ("D407", "MEDIUM", "HTTPSConnection without context", _like(r"(^|[.])HTTPSConnection$") & _no_kw("context")),
        ("D408", "MEDIUM", "Unverified TLS context", _is("ssl._create_unverified_context")),
        ("D409", "HIGH", "Telnet is plain text", _like(r"^telnetlib[.]")),
        ("D410", "MEDIUM", "urllib opens any scheme", _like(r"(^|[.])(urlopen|urlretrieve|URLopener|FancyURLopener)$")),
        ("D411", "MEDIUM", "ssl.wrap_socket", _is("ssl.wrap_socket")),
        ("D412", "CRITICAL", "Server command isn't literal", _like(r"(^|[.])StdioServerParameters$") & (_dynamic() | _kw_dynamic("command"))),
        ("D501", "HIGH", "Path from dynamic text", (_is("open") | _like(r"^os[.]path[.]|^shutil[.]|(^|[.])(Path|PurePath|PosixPath|WindowsPath)$")) & (_dynamic() | _kw_dynamic("path", "file", "filename", "src", "dst"))),
        ("D502", "HIGH", "Archive extraction", _like(r"(?i)tar[^.]*[.]extract(all)?$") & ~_kw_is("filter", '"data"', '"tar"')),
        ("D502", "MEDIUM", "Archive extraction", _like(r"[.]extract(all)?$") & ~_like(r"(?i)(tar|zip)[^.]*[.]extract(all)?$") & ~_kw_is("filter", '"data"', '"tar"')),
        ("D503", "HIGH", "Archive extraction", _like(r"(?i)zip[^.]*[.]extract(all)?$")),
        ("D504", "HIGH", "mktemp races", _like(r"(^|[.])mktemp$")),
        ("D506", "MEDIUM", "tempnam races", _is("os.tempnam", "os.tmpnam")),
        ("D703", "HIGH", "Autoescape is off", _like(r"(^|[.])Environment$") & _kw_is("autoescape", "false")),
        ("D904", "MEDIUM", "Log message from dynamic text", _like(r"^(logging|logger|log)[.](debug|info|warning|error|critical|exception)$") & _dynamic()),
        ("P002", "MEDIUM", "Reads a whole file into memory", _like(r"[.](read|readlines)$") & (_args() == "")),
        ("P005", "MEDIUM", "Compiled in a loop", (F.col("loop_depth") > 0) & (_is("re.compile") & (F.substring(_args(), 1, 1) == "L") | _is("ast.parse"))),
        ("P015", "LOW", "read_csv without chunksize", _like(r"(^|[.])read_csv$") & _no_kw("chunksize") & _no_kw("nrows")),
    ]


_IMPORTS = {
    "HIGH": ("telnetlib", "ftplib", "pyghmi", "Crypto", "xmlrpc", "twisted.web.twcgi", "wsgiref.handlers.CGIHandler"),
    "LOW": ( "pickle", "cPickle", "dill", "shelve", "subprocess", "xml.etree", "xml.sax", "xml.dom", "lxml"),
}


_FOUND = ("rule_id", "severity", "message")


def _finding(rule: Column | str, severity: Column | str, message: Column | str, when: Column) -> Column:
    """The finding as a struct if the predicate holds, else null."""
    values = (x if isinstance(x, Column) else F.lit(x) for x in (rule, severity, message))
    return F.when(when, F.struct(*(v.alias(n) for v, n in zip(values, _FOUND, strict=True))))


def _found(table: DataFrame, *kinds: tuple[str, list[Column]]) -> DataFrame:
    """``(path, line, rule_id, severity, message)``: every finding that a fact of a kind gives.

    One pass: a union of filters would run the parse behind the table once a filter. Each kind tests its own rules alone.
    """
    found = F.array().cast("array<struct<rule_id:string,severity:string,message:string>>")
    for where, tests in kinds:
        found = F.when(F.expr(where), F.filter(F.array(*tests), lambda x: x.isNotNull())).otherwise(found)
    return table.where(" or ".join(f"({w})" for w, _ in kinds)).select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.*")


_CALLS = "kind = 'call' and name is not null"


def _call_tests(first: str) -> list[Column]:
    return [_finding(i, s, m, p) for i, s, m, p in danger_rules() if i[0] in first]


def _import_tests() -> list[Column]:
    risky = F.lit(None).cast("string")
    for severity, modules in _IMPORTS.items():
        pattern = "^(" + "|".join(m.replace(".", "[.]") for m in modules) + ")([.]|$)"
        risky = F.coalesce(F.when(F.col("name").rlike(pattern), severity), risky)
    return [
        _finding("D702", risky, "Import of a risky module", risky.isNotNull()),
        _finding("D306", "HIGH", "Low-level cryptographic binding", F.col("name").rlike(r"^nacl[.]bindings([.]|$)")),
    ]


def _stated(first: str) -> list[Column]:
    return [_finding(*map(F.col, _FOUND), F.substring("rule_id", 1, 1).isin(*first))]


def _threshold_tests(n_args: int, length: int, mccabe: int, cognitive: int, cohesion: int) -> list[Column]:
    m = lambda k: F.col("metrics")[k]
    complexity = m("mccabe")
    return [
        _finding("Q301", F.when(complexity > 25, "CRITICAL").when(complexity > 15, "HIGH").otherwise("MEDIUM"), "McCabe complexity", complexity > mccabe),
        _finding("Q304", F.when(m("cognitive") > 25, "CRITICAL").otherwise("HIGH"), "Cognitive complexity", m("cognitive") > cognitive),
        _finding("Q305", "HIGH", "Lack of cohesion", (m("lcom4") > cohesion) & ~F.coalesce(F.col("args").rlike(r"(^|[ .])(dataclass|attrs|attr[.]s|define|frozen|Protocol|TypedDict|NamedTuple|Struct|BaseModel)( |$)"), F.lit(False))),
        _finding("C303", "LOW", "Too many arguments", m("n_args") > n_args),
        _finding("C304", "LOW", "Function is too long", m("length") > length),
    ]


#: First letters of the ids of a category.
_DANGER, _QUALITY = "DX", "QLCP"


def danger_findings(table: DataFrame) -> DataFrame:
    """``(path, line, rule_id, severity, message)`` of call, import and statement facts."""
    return _found(table, (_CALLS, _call_tests(_DANGER)), ("kind = 'import'", _import_tests()), ("kind = 'finding'", _stated(_DANGER)))


def quality_findings(table: DataFrame, n_args: int = 5, length: int = 50, mccabe: int = 10, cognitive: int = 15, cohesion: int = 6) -> DataFrame:
    """Threshold rules on functions and classes, the P rules that are predicates over calls, and the statement findings."""
    own = _threshold_tests(n_args, length, mccabe, cognitive, cohesion)
    return _found(table, (_CALLS, _call_tests(_QUALITY)), ("kind in ('function', 'class')", own), ("kind = 'finding'", _stated(_QUALITY)))


def all_findings(table: DataFrame, n_args: int = 5, length: int = 50, mccabe: int = 10, cognitive: int = 15, cohesion: int = 6) -> DataFrame:
    """``danger_findings`` and ``quality_findings`` together, in one pass over the facts."""
    own, both = _threshold_tests(n_args, length, mccabe, cognitive, cohesion), _DANGER + _QUALITY
    return _found(table, (_CALLS, _call_tests(both)), ("kind = 'import'", _import_tests()), ("kind in ('function', 'class')", own), ("kind = 'finding'", _stated(both)))


def maintainability_findings(file_metrics: DataFrame, least: float) -> DataFrame:
    """Q303: files whose MI is below ``least``; file_metrics is ``(path, mi, ...)``."""
    return file_metrics.where(F.col("mi") < least).select("path", F.lit(1).alias("line"), F.lit("Q303").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("Maintainability index is too low").alias("message"))


def routed(findings: DataFrame) -> DataFrame:
    """Adds the category of the id's first letter: D and X danger, Q, L, C and P quality; others are dropped."""
    first = F.substring("rule_id", 1, 1)
    return findings.withColumn("category", F.when(first.isin(*_DANGER), "danger").when(first.isin(*_QUALITY), "quality")).where("category is not null")


def at_least(findings: DataFrame, severity: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    return findings.where((severity_rank(F.col("severity")) >= severity_rank(F.lit(severity))) & ~F.col("rule_id").isin(*excluded))


def mitigated(findings: DataFrame, lines: DataFrame, marker: str, ids: tuple[str, ...] = ("D003", "D101", "D102", "D402", "D410", "D501", "D801")) -> DataFrame:
    """Drops findings of these ids if the marker occurs in their line or the six before; lines is ``(path, line, text)``."""
    near = Window.partitionBy("path").orderBy("line").rowsBetween(-6, 0)
    safe = lines.select("path", "line", F.max(F.col("text").rlike(marker)).over(near).alias("safe")).where("safe").select("path", "line")
    return findings.where(~F.col("rule_id").isin(*ids)).unionByName(findings.where(F.col("rule_id").isin(*ids)).join(safe, ["path", "line"], "left_anti"))
