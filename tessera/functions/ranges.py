"""Ranges of whole numbers, from inclusive and to exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(start: Column, end: Column, point: Column) -> Column:
    return (start <= point) & (point < end)


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether [a, b) and [c, d) overlap or touch."""
    return (a <= d) & (c <= b)


def intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct (start, end) of what both ranges cover, null where they neither overlap nor touch."""
    return F.when(overlaps(a, b, c, d), F.struct(F.greatest(a, c).alias("start"), F.least(b, d).alias("end")))


def union(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct (start, end) of the range that covers both, null where they neither overlap nor touch."""
    return F.when(overlaps(a, b, c, d), F.struct(F.least(a, c).alias("start"), F.greatest(b, d).alias("end")))


def compact(rows: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The fewest ranges that cover those of each group; ranges that touch become one. Equal ranges are reduced before
    the shuffle, as many rows of a group may share one."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = rows.select(*group, start, end).dropna(subset=[start, end]).distinct().withColumn("_new", fresh)
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
