"""Session filters: include and exclude patterns over paths."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_of(pattern: str) -> str:
    """A glob (* any run, ? one character) as a regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def fits(path: Column, pattern: str) -> Column:
    """base/** fits the base itself and all below it by its folder name; /path patterns are slugified; others are globs."""
    if pattern.endswith("/**"):
        base = slugify(pattern[:-3])
        return (path == base) | path.startswith(base + "-")
    return path == slugify(pattern) if pattern.startswith("/") else path.rlike(regex_of(pattern))


def slugify(path: str) -> str:
    return path.translate(str.maketrans("/. ", "---"))


def matches(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a path is included (all are, without patterns) and not excluded."""

    def any_of(patterns: Sequence[str]) -> Column:
        found = F.lit(False)
        for p in patterns:
            found |= fits(path, p)
        return found

    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)
