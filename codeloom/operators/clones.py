"""Clones of functions and classes by the edit distance of their syntax, candidates by MinHash.

One parse a file gives fragments with their nodes in pre-order, as written and with names numbered by first use, and the MinHash bands of
their 3-grams; they are written once. Fragments that are equal but for names are each paired with the first of them, and only that
one is compared with others, so copies make no pairs of pairs. Groups are components of the pairs.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_test_path
from .graph import _cut

#: Fragments of ``least`` to ``most`` lines are compared.
LEAST, MOST, BANDS, ROWS = 5, 500, 20, 5
FRAGMENT = "path string, name string, kind string, start_line int, end_line int, raw_hash long, normal_hash long, raw binary, normal binary, bands array<long>, flags array<string>"
_NAMES = [c.split()[0] for c in FRAGMENT.split(", ")]
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_SEEDS = np.random.Generator(np.random.PCG64(83)).integers(1, 2**63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def _signed(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def sequences(node: ast.AST) -> tuple[np.ndarray, np.ndarray]:
    """(kind, label) of all nodes in pre-order, as written and normalised: names by first use, constants alike; the fragment's own name left out."""
    raw, normal, names = [], [], {}
    todo = [node]
    while todo:
        n = todo.pop()
        kind = xxhash.xxh32_intdigest(type(n).__name__)
        label = None if n is node else getattr(n, "id", None) or getattr(n, "arg", None) or getattr(n, "attr", None) or getattr(n, "name", None)
        if isinstance(n, ast.Constant):
            raw.append((kind, xxhash.xxh32_intdigest(repr(n.value))))
            normal.append((kind, 1))
        elif isinstance(label, str):
            raw.append((kind, xxhash.xxh32_intdigest(label)))
            normal.append((kind, 2 + names.setdefault(label, len(names))))
        else:
            raw.append((kind, 0))
            normal.append((kind, 0))
        todo += reversed(list(ast.iter_child_nodes(n)))
    return np.array(raw, np.uint32), np.array(normal, np.uint32)


def bands(normal: np.ndarray) -> list[int]:
    """Hashes of the bands of the MinHash of all 3-grams of kinds (single ones of fewer than three)."""
    k = normal[:, 0].astype(np.uint64)
    grams = k if len(k) < 3 else (k[:-2] * np.uint64(0x9E3779B97F4A7C15) + k[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + k[2:]
    minima = (np.unique(grams)[None, :] * _SEEDS[:, :1] + _SEEDS[:, 1:]).min(axis=1).reshape(BANDS, ROWS)
    return [_signed(row.tobytes() + bytes([b])) for b, row in enumerate(minima)]


def _fragments(path: str, source: str, least: int, most: int) -> Iterator[tuple]:
    todo = [(n, False) for n in ast.parse(source).body]
    while todo:
        n, nested = todo.pop()
        if not isinstance(n, _SCOPES):
            continue
        todo += [(x, True) for x in n.body]
        if least <= n.end_lineno - n.lineno + 1 <= most:
            raw, normal = sequences(n)
            flow = any(isinstance(x, (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.Match)) for x in ast.walk(n))
            marks = [m for m, on in (("nested", nested), ("docstring", ast.get_docstring(n) is not None), ("decorators", bool(n.decorator_list)), ("flow", flow)) if on]
            yield path, n.name, "class" if isinstance(n, ast.ClassDef) else "function", n.lineno, n.end_lineno, _signed(raw.tobytes()), _signed(normal.tobytes()), raw.tobytes(), normal.tobytes(), bands(normal), marks


def fragments(files: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Functions, methods and classes of ``least`` to ``most`` lines; files that don't parse have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()))
        for batch in batches:
            rows = []
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                try:
                    rows += _fragments(path, source, least, most)
                except (SyntaxError, ValueError, RecursionError):
                    continue
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)

    return files.select("path", "source").where("path is not null and source is not null").mapInArrow(run, FRAGMENT)


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Of two (kind, label) sequences: 1 for an insertion, a deletion and another label, 2 for another kind. A row at a time."""
    place = np.arange(len(b) + 1)
    row = place.copy()
    for i, (kind, label) in enumerate(a, 1):
        cost = np.where(b[:, 0] == kind, (b[:, 1] != label).astype(np.int64), 2)
        best = np.empty(len(b) + 1, np.int64)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + cost, row[1:] + 1)
        row = np.minimum.accumulate(best - place) + place
    return int(row[-1])


def _beyond(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the values of a, which are sorted, are more than those of b; repeated ones count."""
    at = np.arange(len(a)) - np.searchsorted(a, a)
    return int((np.searchsorted(b, a, "right") - np.searchsorted(b, a) <= at).sum())


def distance_bounds(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """The edit distance is within these. A step takes at most one element from what either has beyond the other; place by place is one way."""
    p, q = (np.sort(np.ascontiguousarray(s).view(np.uint64).ravel()) for s in (x, y))
    most = len(x) + len(y)
    if len(x) == len(y):
        most = min(most, int(np.where(x[:, 0] == y[:, 0], x[:, 1] != y[:, 1], 2).sum()))
    return max(_beyond(p, q), _beyond(q, p)), most


def similarity(a: bytes, b: bytes, least: float | None = None) -> float:
    """1 less the edit distance by the longer length; negative for very different ones, 1 for two empty ones. One below ``least`` can be given as another below it."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(s, np.uint32).reshape(-1, 2) for s in (a, b))
    low, high = distance_bounds(x, y)
    longer = max(len(x), len(y))
    if low == high or least is not None and 1 - low / longer < least:
        return 1 - low / longer
    return 1 - edit_distance(x, y) / longer


def at_least(a: bytes, b: bytes, least: float) -> bool:
    """Whether ``similarity(a, b) >= least``; the distance is only worked out if its bounds don't tell."""
    if a == b:
        return least <= 1
    x, y = (np.frombuffer(s, np.uint32).reshape(-1, 2) for s in (a, b))
    low, high = distance_bounds(x, y)
    longer = max(len(x), len(y))
    return 1 - high / longer >= least or 1 - low / longer >= least and 1 - edit_distance(x, y) / longer >= least


#: Similarity from which a pair counts as alike as written.
AS_WRITTEN = 0.9


def clone_type(as_written: Column, normal: Column) -> Column:
    """T1 as written, T2 but for names, T3 near: by whether the pair is alike as written, and the normalised similarity."""
    return F.when(normal < 0.95, "T3").when(as_written, "T1").otherwise("T2")


def clone_type_by_normal(normal: Column) -> Column:
    """The classes of snippets held in memory, by the normalised similarity alone."""
    return F.when(normal >= 0.99, "T1").when(normal >= 0.9, "T2").otherwise("T3")


_PLACE = ("path", "start_line", "end_line")
_SCORED = "a_path string, a_start int, a_end int, b_path string, b_start int, b_end int, as_written boolean, similarity double"
#: Copies of one fragment beyond which it is sent to all tasks; fragments of so many copies are few.
MANY = 10_000


def _copies(table: DataFrame, heads: DataFrame) -> DataFrame:
    """``(a, b, ra, na, rb, nb)``: the first of fragments that are equal but for names, and each other. A key that very many share is not shuffled."""
    first = _cut(heads.where("n > 1").join(table.select(F.col("place").alias("head"), F.col("raw").alias("ra"), F.col("normal").alias("na")), "head"))
    rows = table.select("normal_hash", F.col("place").alias("b"), F.col("raw").alias("rb"), F.col("normal").alias("nb"))
    large = F.broadcast(first.where(F.col("n") > MANY))
    small = rows.join(large.select("normal_hash"), "normal_hash", "left_anti").join(first.where(F.col("n") <= MANY), "normal_hash")
    columns = (F.col("head").alias("a"), "b", "ra", "na", "rb", "nb")
    return rows.join(large, "normal_hash").select(*columns).union(small.select(*columns)).where("a <> b")


def clone_pairs(found: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(a, b, similarity, clone_type)``, a before b by path and line, of a normalised similarity of ``threshold`` or more."""
    table = _cut(found.select(F.struct(*_PLACE).alias("place"), "normal_hash", "raw", "normal", "bands"))
    heads = _cut(table.groupBy("normal_hash").agg(F.min("place").alias("head"), F.count(F.lit(1)).alias("n")))
    banded = table.select("place", F.explode("bands").alias("key")).join(heads.select(F.col("head").alias("place")), "place", "left_semi")
    left, right = banded.select(F.col("place").alias("a"), "key"), banded.select(F.col("place").alias("b"), "key")
    near = _cut(left.join(right, "key").where("a < b").select("a", "b").distinct())
    codes = table.select("place", "raw", "normal")
    sides = _copies(table, heads).unionByName(near.join(codes.toDF("a", "ra", "na"), "a").join(codes.toDF("b", "rb", "nb"), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, na, rb, nb = (batch.column(c).to_pylist() for c in ("ra", "na", "rb", "nb"))
            normal = [similarity(x, y, threshold) for x, y in zip(na, nb, strict=True)]
            written = [n >= threshold and at_least(x, y, AS_WRITTEN) for x, y, n in zip(ra, rb, normal, strict=True)]
            places = [batch.column(c) for c in ("a_path", "a_start", "a_end", "b_path", "b_start", "b_end")]
            yield pa.RecordBatch.from_arrays([*places, pa.array(written, pa.bool_()), pa.array(normal, pa.float64())], [c.split()[0] for c in _SCORED.split(", ")])

    different = F.col("na") != F.col("nb")
    normals = (F.when(different, F.col(c)).alias(c) for c in ("na", "nb"))
    flat = sides.select(*(F.col(f"{s}.{c}").alias(f"{s}_{n}") for s in "ab" for c, n in zip(_PLACE, ("path", "start", "end"), strict=True)), "ra", "rb", *normals)
    scored = flat.mapInArrow(run, _SCORED).where(F.col("similarity") >= threshold)
    place = lambda s: F.struct(*(F.col(f"{s}_{n}").alias(c) for c, n in zip(_PLACE, ("path", "start", "end"), strict=True)))
    return scored.select(place("a").alias("a"), place("b").alias("b"), "similarity", clone_type(F.col("as_written"), F.col("similarity")).alias("clone_type"))


def clone_groups(pairs: DataFrame) -> DataFrame:
    """``(place, group_place)``: each fragment of a pair and the first of its group, by repeated least labels."""
    edges = _cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")).distinct())
    label = _cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")))
    while True:
        near = edges.join(label.select(F.col("u").alias("v"), F.col("low").alias("there")), "v").groupBy("u").agg(F.min("there").alias("there"))
        after = _cut(label.join(near, "u").select("u", F.least("low", "there").alias("low"), (F.col("there") < F.col("low")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select(F.col("u").alias("place"), F.col("low").alias("group_place"))
        label = after.select("u", "low")


def clone_findings(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Two rows a pair: INFO at the first fragment, WARNING at its duplicate; C100, C200 and C300 for T1, T2 and T3."""
    names = found.select(F.struct(*_PLACE).alias("place"), F.col("name"))
    both = pairs.join(names.toDF("a", "a_name"), "a").join(names.toDF("b", "b_name"), "b")
    kind = F.when(F.col("clone_type") == "T1", "exact").when(F.col("clone_type") == "T2", "renamed").otherwise("near-miss")
    rule = F.when(F.col("clone_type") == "T1", "C100").when(F.col("clone_type") == "T2", "C200").otherwise("C300")

    def row(at: str, other: str, severity: str, words: str, tail: str) -> Column:
        text = F.format_string(f"{words} %s at %s:%d (%s clone, %.0f%% {tail})", f"{other}_name", F.substring_index(f"{other}.path", "/", -1), f"{other}.start_line", kind, F.col("similarity") * 100)
        return F.struct(F.col(f"{at}.path").alias("path"), F.col(f"{at}.start_line").alias("line"), rule.alias("rule_id"), F.lit(severity).alias("severity"), text.alias("message"), F.col("similarity").alias("similarity"))

    rows = F.explode(F.array(row("a", "b", "INFO", "Similar to", "match"), row("b", "a", "WARNING", "Duplicate of", "similar")))
    return both.select(rows.alias("f")).select("f.*")


def fix_confidence(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``confidence`` (0 to 100) and ``decision``: autofix from 90, suggest from 60, else suppress."""
    flags = found.select(F.struct(*_PLACE).alias("b"), "flags")
    rows = pairs.join(flags, "b", "left")
    has = lambda x: F.coalesce(F.array_contains("flags", x), F.lit(False))
    s, near = F.col("similarity"), F.col("a.path") == F.col("b.path")
    distance = F.abs(F.col("a.start_line") - F.col("b.start_line"))
    score = F.lit(50) + F.when(s >= 0.99, 30).when(s >= 0.95, 20).when(s >= 0.9, 10).when(s < 0.8, -30).otherwise(0)
    score = score + F.when(F.col("clone_type") == "T1", 25).when(F.col("clone_type") == "T2", 15).otherwise(-10)
    score = score + F.when(is_test_path(F.col("b.path")), -20).otherwise(0) + F.when(near, 10).otherwise(0) + F.when(near & (distance <= 2), 15).when(near & (distance >= 10), -20).otherwise(0)
    for mark, points in (("docstring", 10), ("flow", -40), ("decorators", -20), ("nested", -10)):
        score = score + F.when(has(mark), points).otherwise(0)
    bounded = F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int")
    return rows.withColumn("confidence", bounded).withColumn("decision", F.when(F.col("confidence") >= 90, "autofix").when(F.col("confidence") >= 60, "suggest").otherwise("suppress")).drop("flags")


def same_flow(pairs: DataFrame, prints: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of functions whose control flow is alike; pairs without a fingerprint stay. prints: ``(place, blocks, depth, branches, loops, kinds)`` of ``cfg.fingerprints``."""
    cols = ("blocks", "depth", "branches", "loops")
    side = lambda s: prints.select(F.col("place").alias(s), F.struct(*cols, "kinds").alias(f"{s}_print"))
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    alike = lambda c: 1 - F.abs(F.col(f"a_print.{c}") - F.col(f"b_print.{c}")) / F.greatest(F.col(f"a_print.{c}"), F.col(f"b_print.{c}"), F.lit(1))
    shared = F.size(F.array_intersect("a_print.kinds", "b_print.kinds")) / F.greatest(F.size(F.array_union("a_print.kinds", "b_print.kinds")), F.lit(1))
    score = (sum((alike(c) for c in cols), F.lit(0.0)) + shared) / (len(cols) + 1)
    return rows.where(F.coalesce(score >= least, F.lit(True))).drop("a_print", "b_print")
