"""Ignore patterns and excluded folders as predicates on relative paths."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that a scan never enters.
EXCLUDED = (".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "venv", "env", ".venv", ".vscode", ".idea", "build", "dist", "_build", ".eggs", ".tox", "htmlcov", ".coverage", "node_modules")
EXCLUDED_PATTERN = "(^|/)(" + "|".join(d.replace(".", "\\.") for d in EXCLUDED) + "|[^/]*\\.egg-info)/"


def to_regex(pattern: str) -> str | None:
    """A line of an ignore file as a regular expression on paths; None for comments and empty lines."""
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    p = p[1:] if p.startswith("\\") else p
    folder, p = p.endswith("/"), p.strip("/") if p != "/" else p
    anchored = pattern.lstrip("!").startswith("/") or "/" in p
    out, k = "", 0
    while k < len(p):
        if p.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif p.startswith("/**", k) and k + 3 == len(p):
            out, k = out + "/.*", k + 3
        elif p.startswith("**", k):
            out, k = out + ".*", k + 2
        elif p[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif p[k] == "?":
            out, k = out + "[^/]", k + 1
        elif p[k] == "[" and "]" in p[k + 1 :]:
            end = p.index("]", k + 1)
            out, k = out + "[" + ("^" if p[k + 1] == "!" else "") + p[k + 1 + (p[k + 1] == "!") : end] + "]", end + 1
        else:
            out, k = out + re.escape(p[k]), k + 1
    return ("^" if anchored else "(^|/)") + out + ("/" if folder else "(/|$)")


def rules(patterns: Sequence[str]) -> list[tuple[str, bool]]:
    """(regular expression, whether it ignores) of each pattern in order; ``!`` takes back."""
    out = []
    for p in patterns:
        back = p.startswith("!")
        r = to_regex(p[1:] if back else p)
        if r:
            out.append((r, not back))
    return out


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the last pattern that matches ignores the path."""
    found = F.lit(False)
    for r, value in rules(patterns):
        found = F.when(path.rlike(r), F.lit(value)).otherwise(found)
    return found


def sql(path: str, patterns: Sequence[str]) -> str:
    """The same as a SQL expression."""
    cases = "".join(f" WHEN regexp_matches({path}, '{r}') THEN {str(v).lower()}" for r, v in reversed(rules(patterns)))
    return f"CASE{cases} ELSE false END"


def is_ignored(path: str, patterns: Sequence[str]) -> bool:
    """The same on the driver or in a reader."""
    found = False
    for r, value in rules(patterns):
        if re.search(r, path):
            found = value
    return found


def excluded(path: Column) -> Column:
    return path.rlike(EXCLUDED_PATTERN)


def in_venv(path: Column, roots: Sequence[str]) -> Column:
    """Whether a path lies under one of the few virtual environments found."""
    found = F.lit(False)
    for r in roots:
        found = found | path.startswith(r.rstrip("/") + "/")
    return found
