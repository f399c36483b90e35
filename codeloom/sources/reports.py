"""Report sinks: findings as JSON, SARIF, GitLab, GitHub, JUnit, Markdown and text lines.

Every format is a column expression over findings ``(path, line, rule_id, severity, message)``, so rows are rendered in parallel and no report is
ever one row. ``rendered`` gives a row a finding; ``document`` puts the fixed head and tail of the format around them, with
the separators that the format needs, in order of path and line; written as text in that order it is a valid file.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "sarif", "gitlab", "github", "junit", "markdown", "text", "grouped", "html", "quiet")


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _command(c: Column, value: bool) -> Column:
    """Escapes of workflow commands; a property's value has two more."""
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if value else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _level(error: str, warning: str, note: str) -> Column:
    return F.when(F.col("severity").isin("CRITICAL", "HIGH"), error).when(F.col("severity") == "MEDIUM", warning).otherwise(note)


def _value(form: str) -> Column:
    """The row of a finding in a format, from its columns."""
    if form == "json":
        return F.to_json(F.struct("path", "line", "rule_id", "severity", "message"))
    if form == "gitlab":
        finger = F.md5(F.concat_ws(":", "path", "line", "rule_id"))
        location = F.struct(F.col("path"), F.struct(F.col("line").alias("begin")).alias("lines"))
        return F.to_json(F.struct(F.col("message").alias("description"), F.col("rule_id").alias("check_name"), finger.alias("fingerprint"), _level("critical", "major", "minor").alias("severity"), location.alias("location")))
    if form == "github":
        return F.format_string("::%s file=%s,line=%d,title=%s::%s", _level("error", "warning", "notice"), _command(F.col("path"), True), "line", _command(F.col("rule_id"), True), _command(F.col("message"), False))
    if form == "junit":
        return F.format_string('<testcase classname="%s" name="%s:%d"><failure message="%s"/></testcase>', _xml(F.col("path")), _xml(F.col("rule_id")), "line", _xml(F.col("message")))
    if form == "markdown":
        return F.format_string("| %s | %d | %s | %s | %s |", "path", "line", "rule_id", "severity", F.replace(F.replace("message", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    if form == "html":
        return F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", _xml(F.col("path")), F.col("line").cast("string"), _xml(F.col("rule_id")), _xml(F.col("severity")), _xml(F.col("message"))), F.lit("</td></tr>"))
    if form == "sarif":
        place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
        prints = F.struct(F.md5(F.concat_ws(":", "path", "line", "rule_id")).alias("primaryLocationLineHash"))
        return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), _level("error", "warning", "note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), prints.alias("partialFingerprints")))
    return F.format_string("%s:%d: %s [%s] %s", "path", "line", "rule_id", "severity", "message")


def rendered(findings: DataFrame, form: str) -> DataFrame:
    """A single column ``value``, one row a finding; one a path for grouped, and one in all, the number of findings, for quiet."""
    if form not in FORMATS:
        raise ValueError(f"{form} is none of {FORMATS}")
    f = findings.select("path", F.col("line").cast("long").alias("line"), "rule_id", "severity", "message")
    if form == "grouped":
        each = F.array_sort(F.collect_list(F.struct("line", F.format_string("  %d: %s [%s] %s", "line", "rule_id", "severity", "message").alias("text"))))
        return f.groupBy("path").agg(each.alias("rows")).select(F.concat_ws("\n", F.concat("path", F.lit(":")), F.transform("rows", lambda r: r["text"])).alias("value"))
    if form == "quiet":
        return f.agg(F.format_string("%d findings in %d files", F.count(F.lit(1)), F.count_distinct("path")).alias("value"))
    return f.select(_value(form).alias("value"))


_STYLE = "<style>body{font-family:sans-serif}td{padding:2px 8px;border-bottom:1px solid #ddd}</style>"
_ENVELOPES = {
    "json": ('{"findings": [', "]}", ","),
    "gitlab": ("[", "]", ","),
    "junit": ('<?xml version="1.0" encoding="UTF-8"?>\n<testsuites><testsuite name="codeloom">', "</testsuite></testsuites>", ""),
    "markdown": ("| File | Line | Rule | Severity | Message |\n|---|---|---|---|---|", "", ""),
    "html": (f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Findings</title>{_STYLE}</head><body><table><tr><th>File</th><th>Line</th><th>Rule</th><th>Severity</th><th>Message</th></tr>', "</table></body></html>", ""),
}


def document(findings: DataFrame, form: str) -> DataFrame:
    """``value`` lines of a whole report, head and tail included. The rules that a SARIF head lists are those with findings, some hundreds at most."""
    if form == "sarif":
        ids = sorted(r.rule_id for r in findings.select("rule_id").distinct().collect())
        rules = json.dumps([{"id": i} for i in ids])
        head = f'{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {{"driver": {{"name": "codeloom", "rules": {rules}}}}}, "results": ['
        envelope = (head, "]}]}", ",")
    else:
        envelope = _ENVELOPES.get(form, ("", "", ""))
    head, tail, comma = envelope
    spark = findings.sparkSession
    if form in ("grouped", "quiet"):
        return rendered(findings, form).orderBy("value")
    rows = findings.select("path", F.col("line").cast("long").alias("line"), "rule_id", "severity", "message").withColumn("value", _value(form))
    if comma:  # every row but the first has a separator before it; equal rows are one
        rows = rows.dropDuplicates(["path", "line", "rule_id", "value"])
        first = rows.select(F.struct("path", "line", "rule_id", "value").alias("r")).agg(F.min("r").alias("r")).first().r
        if first is not None:
            is_first = F.lit(True)
            for c in ("path", "line", "rule_id", "value"):
                is_first = is_first & F.col(c).eqNullSafe(F.lit(first[c]))
            rows = rows.withColumn("value", F.when(is_first, F.col("value")).otherwise(F.concat(F.lit(comma), "value")))
            rows = rows.withColumn("is_first", F.when(is_first, 0).otherwise(1)).orderBy("is_first", "path", "line", "rule_id", "value")
    else:
        rows = rows.orderBy("path", "line", "rule_id", "value")
    edge = lambda text: spark.createDataFrame([(text,)] if text else [], "value string")
    return edge(head).union(rows.select("value")).union(edge(tail))


def complexity_xml(functions: DataFrame) -> DataFrame:
    """Cyclomatic complexity as XML lines: one metric element a function."""
    row = F.format_string('<metric file="%s" line="%d" name="%s" complexity="%d" rank="%s"/>', _xml(F.col("path")), "line", _xml(F.col("name")), "cc", "rank")
    return functions.select(row.alias("value"))


def safe_target(root: str, target: str) -> str:
    """The absolute path of a report below root; ValueError for one outside of it, through links or dots."""
    base = os.path.realpath(root)
    path = os.path.realpath(os.path.join(base, target))
    if ".." in target.replace("\\", "/").split("/") or path != base and not path.startswith(base + os.sep):
        raise ValueError(f"{target} isn't below {root}")
    return path


def write(findings: DataFrame, form: str, path: str) -> None:
    """Writes a whole report as text files in order; one file for ``document`` forms of one partition."""
    document(findings, form).write.mode("overwrite").text(path)
