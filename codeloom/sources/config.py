"""Configuration in TOML and whitelists, read on the driver: they are small files."""

from __future__ import annotations

import ast
import os
import tomllib
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    confidence: int = 60
    max_complexity: int = 10
    max_nesting: int = 3
    max_args: int = 5
    max_lines: int = 50
    min_mi: float | None = None
    exclude_folders: tuple[str, ...] = ()
    include_folders: tuple[str, ...] = ()
    include_tests: bool = False
    ignore: tuple[str, ...] = ()
    per_file_ignores: dict[str, tuple[str, ...]] = field(default_factory=dict)
    custom_secrets: tuple[tuple[str, str, str], ...] = ()
    suspicious_names: tuple[str, ...] = ()
    whitelist: tuple[tuple[str, str, str | None], ...] = ()


def load(folder: str, table: str = "codeloom") -> Config:
    """The nearest ``.codeloom.toml``, or ``[tool.codeloom]`` of a pyproject.toml, from folder upwards; defaults without any. Unknown keys are an error."""
    at = os.path.abspath(folder)
    while True:
        for name, keys in ((f".{table}.toml", (table,)), ("pyproject.toml", ("tool", table))):
            path = os.path.join(at, name)
            if os.path.isfile(path):
                with open(path, "rb") as f:
                    found = tomllib.load(f)
                for k in keys:
                    found = found.get(k, {})
                if found:
                    return parsed(found)
        up = os.path.dirname(at)
        if up == at:
            return Config()
        at = up


def parsed(values: dict) -> Config:
    made = {}
    for key, value in values.items():
        if key == "per_file_ignores":
            value = {glob: tuple(ids) for glob, ids in value.items()}
        elif key == "custom_secrets":
            value = tuple((x["name"], x["regex"], x.get("severity", "HIGH")) for x in value)
        elif key == "whitelist":
            value = tuple((x, "exact", None) if isinstance(x, str) else (x["name"], x.get("pattern", "exact"), x.get("file")) for x in value)
        elif isinstance(value, list):
            value = tuple(value)
        if key not in Config.__dataclass_fields__:
            raise ValueError(f"unknown setting {key}")
        made[key] = value
    return Config(**made)


def whitelist_file(path: str) -> list[tuple[str, str, str | None]]:
    """Entries of a whitelist: a TOML file, or Python whose names and attributes are the names to keep."""
    with open(path, "rb") as f:
        text = f.read()
    if path.endswith(".toml"):
        return list(parsed({"whitelist": tomllib.loads(text.decode()).get("whitelist", [])}).whitelist)
    names = {n.attr if isinstance(n, ast.Attribute) else n.id for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Attribute) or isinstance(n, ast.Name) and n.id != "_"}
    return [(n, "exact", None) for n in sorted(names)]
