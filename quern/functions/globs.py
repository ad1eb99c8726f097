"""Glob patterns as one regular expression, so that exclusion is a single pushed-down predicate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A shell pattern over the whole string; `*` also spans slashes, [seq] and [!seq] are classes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")) + (pattern[i : i + 2] == "!]"))
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[i:end].replace("\\", r"\\")
                out.append("[" + ("^" + body[1:] if body.startswith("!") else re.sub(r"^\^", r"\^", body)) + "]")
                i = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def exclude_regex(patterns: list[str]) -> str | None:
    """One alternation for all patterns; a pattern without * and ? also matches anywhere in the path."""
    parts = []
    for p in patterns:
        parts.append(glob_regex(p))
        if "*" not in p and "?" not in p:
            parts.append(glob_regex(f"*{p}*"))
    return "(?s)^(?:" + "|".join(parts) + ")$" if parts else None


def excluded(path: Column, patterns: list[str]) -> Column:
    regex = exclude_regex(patterns)
    return F.lit(False) if regex is None else path.rlike(regex)


def load_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: stripped lines that are neither blank nor comments."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]
