"""Attribute paths: predicates from a record to a value, written with U+001E between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import PATH_SEP


def parse(path: Column) -> Column:
    """Array of the predicates; an empty path has none."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, PATH_SEP))


def relative(path: Column, to: Column) -> Column:
    """What follows the first part of an array path, null if to isn't that part."""
    n = F.size(to)
    return F.when(F.slice(path, F.lit(1), n) == to, F.slice(path, n + 1, F.greatest(F.size(path) - n, F.lit(0))))


def common(a: Column, b: Column) -> Column:
    """The longest first part that two array paths share."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    differs = F.array_position(same, False)
    return F.slice(a, F.lit(1), F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs.cast("int") - 1))


def split_path(path: str | tuple[str, ...]) -> tuple[str, ...]:
    return tuple(path) if not isinstance(path, str) else tuple(p for p in path.split(PATH_SEP) if p)


def common_of(paths: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The longest first part of all paths that leaves something of each."""
    out = []
    for parts in zip(*[p[:-1] for p in paths], strict=False):
        if len(set(parts)) > 1:
            break
        out.append(parts[0])
    return tuple(out)
