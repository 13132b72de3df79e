"""Paths from records through blank nodes, and digests of what hangs from a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..model import BNODE, DEPTH, HOME, homed
from ..session import asked, kept, stored
from . import delta_home

STEP = "array<struct<p:string,o:bigint>>"


def blank_paths(statements: DataFrame, extra: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """Blank nodes (extra, model, record_id, node, level, chain, path, places): chain holds the blank nodes from the
    record to this one, path the predicates with their orders (1 if missing), places the orders and positions.

    The columns extra keep several sets of statements apart. One join per level, of links only, until a level is
    empty; a longer chain than depth, as a cycle makes, is an error. A node that is reached by several ways has a row
    for each.
    """
    own = [*homed(statements), *(extra or []), "model"]
    # record_id is the same along a chain, and a part of the join's key it keeps shared nodes apart.
    step = F.struct(F.col("predicate").alias("p"), F.coalesce("ord", F.lit(1).cast("bigint")).alias("o"))
    place = F.struct(F.coalesce("ord", F.lit(1).cast("bigint")).alias("o"), F.col("idx").alias("i"))
    links = statements.filter((F.col("object_kind") == BNODE) & F.col("object_id").isNotNull()).select(
        *own, "record_id", F.col("subject_id").alias("over"), F.col("object_id").alias("node"), step.alias("step"), place.alias("place")
    )
    links = kept(links)
    level = links.filter(F.col("over") == F.col("record_id")).select(
        *own, "record_id", "node", F.lit(1).alias("level"), F.array("node").alias("chain"), F.array("step").alias("path"), F.array("place").alias("places")
    )
    inner = links.filter(F.col("over") != F.col("record_id"))
    out = level
    for k in range(2, depth + 2):
        up = level.withColumnRenamed("node", "over").drop("level")
        level = inner.join(up, [*own, "record_id", "over"]).select(
            *own, "record_id", "node", F.lit(k).alias("level"), F.concat("chain", F.array("node")).alias("chain"),
            F.concat("path", F.array("step")).alias("path"), F.concat("places", F.array("place")).alias("places"),
        )
        level = kept(level)
        if asked(level, DataFrame.isEmpty):
            return out
        out = out.unionByName(level)
    raise ValueError(f"a chain of more than {depth} blank nodes")


def located(statements: DataFrame, extra: list[str] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """statements with the chain, path and places of their subject, empty for a record's own, and those of blank nodes
    that hang from no record."""
    own = [*(extra or []), "model", "record_id"]
    paths = blank_paths(statements, extra) if paths is None else paths
    own = [*homed(statements, paths), *own]
    at = paths.select(*own, F.col("node").alias("subject_id"), "chain", "path", "places")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    flat = statements.filter("subject_id = record_id")
    empty = {"chain": F.array().cast("array<string>"), "path": F.array().cast(STEP), "places": F.array().cast("array<struct<o:bigint,i:bigint>>")}
    deep = statements.filter("subject_id <> record_id").join(at, [*own, "subject_id"], "left")
    deep = deep.select(*statements.columns, none("chain", "array<string>"), none("path", STEP), none("places", "array<struct<o:bigint,i:bigint>>"))
    return flat.withColumns(empty).unionByName(deep)


def located_at_home(statements: DataFrame, set_: str, large: tuple[int, ...] = ()) -> DataFrame:
    """As located() for statements with HOME, with the path alone, in one pass over whole homes; set_ is a number that keeps
    several sets of statements apart. Homes in large, which memory may not hold, are joined by level, and lose HOME."""
    usual = statements.filter(~F.col(HOME).isin(list(large))) if large else statements
    paths = F.arrow_udf(delta_home.pather, delta_home.PATHS, ArrowUDFType.SCALAR_ITER).asNondeterministic()
    rows = usual.sortWithinPartitions(HOME).withColumn("_l", paths(HOME, set_, *delta_home.PATH_TYPES))
    rows = rows.withColumn("path", F.explode("_l")).select(*statements.columns, "path")
    if not large:
        return rows
    far = located(statements.filter(F.col(HOME).isin(list(large))).drop(HOME), [set_]).withColumn(HOME, F.lit(None).cast("bigint"))
    return rows.unionByName(far.select(rows.columns))


def path_text(path, predicate=None, order=None):  # noqa: ANN001, ANN201
    """Text of a path with its orders, and of a further step, as p~o/p~o."""
    steps = F.transform(path, lambda s: F.concat_ws("~", s["p"], s["o"].cast("string")))
    if predicate is not None:
        steps = F.concat(steps, F.array(F.concat_ws("~", predicate, F.coalesce(order, F.lit(1)).cast("string"))))
    return F.array_join(steps, "/")


def resource_paths(statements: DataFrame) -> DataFrame:
    """Every edge from a record on (model, record_id, level, path, object_kind, node): path as an array of predicates,
    node the value or the node at its end. Edges to blank nodes are paths too, and lead on."""
    rows = located(statements)
    preds = F.concat(F.transform("path", lambda s: s["p"]), F.array("predicate"))
    return rows.select(*homed(rows), "model", "record_id", (F.size("chain") + 1).alias("level"), preds.alias("path"), "object_kind", F.coalesce("object_value", "object_id").alias("node"), "idx")


def entity_paths(statements: DataFrame, path: tuple[str, ...] | None = None) -> DataFrame:
    """The paths that end at a leaf, which is anything but a blank node; with path those of its predicates alone."""
    out = resource_paths(statements).filter(F.col("object_kind") != BNODE)
    return out if path is None else out.filter(F.col("path") == F.array(*map(F.lit, path)))


def leaves(statements: DataFrame) -> DataFrame:
    """The leaves below each record (model, record_id, leaf), with their URIs or values."""
    return entity_paths(statements).select("model", "record_id", F.col("node").alias("leaf"))


def level_nodes(statements: DataFrame, level: int) -> DataFrame:
    """Nodes that are level steps below their record."""
    return resource_paths(statements).filter(F.col("level") == level).select(*homed(statements), "model", "record_id", "node", "object_kind")


def unmatched_paths(statements: DataFrame, matched: DataFrame) -> DataFrame:
    """Paths of the statements whose stmt_key is not in matched."""
    keys = [*homed(statements, matched), "stmt_key"]
    return located(statements).join(matched.select(keys).distinct(), keys, "left_anti")


def subtree_hashes(statements: DataFrame, extra: list[str] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """A digest (extra, model, record_id, node, hash) of all that hangs from each blank node, bottom up, one aggregate
    per level. Children enter sorted, so the order of rows does not matter; orders count, positions don't."""
    own = [*(extra or []), "model", "record_id"]
    paths = blank_paths(statements, extra) if paths is None else paths
    levels = stored(paths.select(*own, "node", "level").distinct())
    deepest = levels.agg(F.max("level")).first()[0] or 0
    rows = statements.filter("subject_id <> record_id").select(
        *own, F.col("subject_id").alias("node"), F.concat_ws("|", "predicate", F.coalesce("ord", F.lit(1)).cast("string"), "object_kind").alias("edge"),
        F.when(F.col("object_kind") == BNODE, F.col("object_id")).alias("child"), F.coalesce("object_value", "object_id").alias("value"),
    )
    rows = rows.join(levels, [*own, "node"])
    out = None
    for k in range(deepest, 0, -1):
        here = rows.filter(F.col("level") == k)
        if out is None:
            parts = here.withColumn("h", F.when(F.col("child").isNull(), F.col("value")))
        else:
            parts = here.join(out.select(*own, F.col("node").alias("child"), F.col("hash").alias("h0")), [*own, "child"], "left").withColumn("h", F.when(F.col("child").isNull(), F.col("value")).otherwise(F.col("h0")))
        made = parts.groupBy(*own, "node").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("|", "edge", F.coalesce("h", F.lit("")))))), 256).alias("hash"))
        # A level's digests are read by the next one and by the caller.
        out = stored(made) if out is None else stored(made.unionByName(out))
    return out if out is not None else levels.select(*own, "node", F.lit("").alias("hash"))
