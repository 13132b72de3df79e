"""Reading statements: as of a version, of a record class or a record, as nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import split_path
from ..model import BNODE, DEPTH, HOME, LITERAL, OPEN_END, RDF_TYPE, RESOURCE, homed
from ..session import asked, stored

#: So many values are searched by a condition.
FEW = 1000


def as_of(statements: DataFrame, version: int | Column) -> DataFrame:
    """Statements that hold at version; those without bounds always do."""
    v = F.lit(version) if isinstance(version, int) else version
    return statements.filter(F.col("valid_from").isNull() | F.col("valid_to").isNull() | ((F.col("valid_from") <= v) & (v < F.col("valid_to"))))


def current(statements: DataFrame) -> DataFrame:
    return statements.filter(F.col("valid_to") == OPEN_END)


def as_of_default(statements: DataFrame, versions: DataFrame) -> DataFrame:
    """Statements that hold at the latest version of their model, or at 1 where it has none."""
    latest = versions.select(F.col("model").alias("_model"), "latest_version")
    joined = statements.join(F.broadcast(latest), F.col("model") == F.col("_model"), "left").withColumn("_v", F.coalesce("latest_version", F.lit(1)))
    return as_of(joined, F.col("_v")).drop("_model", "latest_version", "_v")


def class_records(types: DataFrame, type_uri: str, model: str | None = None, at_most: int | None = None) -> DataFrame:
    """Records (model, record_id) of a class; with at_most the first ones in the order of their URIs."""
    rows = types.filter((F.col("type_uri") == type_uri) & (F.col("node_kind") == RESOURCE))
    if model is not None:
        rows = rows.filter(F.col("model") == model)
    rows = rows.select(*homed(rows), "model", F.col("node_id").alias("record_id")).distinct()
    return rows if at_most is None else rows.orderBy("record_id", "model").limit(at_most)


def described(statements: DataFrame, records: DataFrame) -> DataFrame:
    """All statements of the records, blank nodes included, by the record that they are stored with."""
    keys = [*homed(statements, records), "model", "record_id"]
    return statements.join(records.select(keys).distinct(), keys, "left_semi")


def described_by_links(statements: DataFrame, records: DataFrame, depth: int = DEPTH) -> DataFrame:
    """As described(), but found by following blank nodes from each record: rows of statements with root and level.

    A blank node is followed once for each root, so that a cycle ends. One join per level, over links alone; the
    statements are joined once, at the end. A longer chain than depth is an error.
    """
    links = statements.filter((F.col("object_kind") == BNODE) & F.col("object_id").isNotNull()).select("model", F.col("subject_id").alias("over"), F.col("object_id").alias("node")).distinct()
    links = stored(links)
    level = stored(records.select("model", F.col("record_id").alias("root"), F.col("record_id").alias("node")).distinct())
    found = level.withColumn("level", F.lit(0))
    for k in range(1, depth + 2):
        below = level.withColumnRenamed("node", "over").join(links, ["model", "over"]).select("model", "root", "node").distinct()
        level = stored(below.join(found.select("model", "root", "node"), ["model", "root", "node"], "left_anti"))
        if level.isEmpty():
            break
        if k > depth:
            raise ValueError(f"a chain of more than {depth} blank nodes")
        found = found.unionByName(level.withColumn("level", F.lit(k)))
    at = found.select("model", F.col("node").alias("subject_id"), "root", "level")
    return statements.join(at, ["model", "subject_id"])


def with_types(statements: DataFrame, types: DataFrame, records: DataFrame) -> DataFrame:
    """statements of records and a statement for each of their nodes' types, which are not versioned: at the place of the
    first statement that has the node, before it as subject and after it as object. The columns sub_pos (0 for a
    subject's type, 1 for a statement, 2 for an object's type) and is_type are new."""
    own = types.join(records.select("model", "record_id").distinct(), ["model", "record_id"], "left_semi")
    side = lambda node, sub: statements.filter(F.col(node).isNotNull()).groupBy("model", "record_id", F.col(node).alias("node_id")).agg(F.min(F.struct("idx", F.lit(sub).alias("sub"))).alias("at"))
    places = side("subject_id", 0).unionByName(side("object_id", 2)).groupBy("model", "record_id", "node_id").agg(F.min("at").alias("at"))
    placed = own.join(places, ["model", "record_id", "node_id"])
    none = {c: F.lit(None).cast(dict(statements.dtypes)[c]) for c in statements.columns}
    made = placed.select(*[
        {"model": F.col("model"), "record_id": F.col("record_id"), "idx": F.col("at.idx"), "subject_kind": F.col("node_kind"), "subject_id": F.col("node_id"), "predicate": F.lit(RDF_TYPE),
         "object_kind": F.lit(RESOURCE), "object_id": F.col("type_uri")}.get(c, none[c]).alias(c)
        for c in statements.columns
    ], F.col("at.sub").alias("sub_pos"), F.lit(True).alias("is_type"))
    return statements.withColumn("sub_pos", F.lit(1)).withColumn("is_type", F.lit(False)).unionByName(made)


def nested(statements: DataFrame, parts: Column, order: list[str], to: str = "statements") -> DataFrame:
    """One row (model, record_id, to) per record with its statements as an array, in order.

    A record is one row in the result, so its statements meet in one task, whatever their number.
    """
    keyed = F.struct(*[F.col(c).alias(f"_{c}") for c in order], parts.alias("_s"))
    rows = statements.groupBy("model", "record_id").agg(F.array_sort(F.collect_list(keyed)).alias("_all"))
    return rows.select("model", "record_id", F.transform("_all", lambda x: x["_s"]).alias(to))


def counters(statements: DataFrame) -> DataFrame:
    """One row (records, statements) of what was read."""
    return statements.agg(F.countDistinct("model", "record_id").alias("records"), F.count("*").alias("statements"))


# --- Search -----------------------------------------------------------------------------------------------------------


def _led(statements: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """statements, without HOME if one of the steps leads to a resource, whose statements are spread by its own record."""
    away = F.col("predicate").isin(*steps) & (F.col("object_kind") == RESOURCE)
    return statements.drop(HOME) if steps and homed(statements) and not asked(statements.filter(away), DataFrame.isEmpty) else statements


def _edges(statements: DataFrame, predicate: str) -> DataFrame:
    return statements.filter(F.col("predicate") == predicate)


def search(statements: DataFrame, path: str | tuple[str, ...], values: DataFrame, model: str | None = None) -> DataFrame:
    """Records (value, model, record_id) at which path begins that leads to one of the values (column value), exactly.

    Begins at the values, which are the smallest side, and follows the path backwards, one join per step.
    """
    steps = split_path(path)
    rows = statements if model is None else statements.filter(F.col("model") == model)
    rows = _led(rows, steps[:-1])
    own = homed(rows)
    hits = _edges(rows, steps[-1]).filter(F.col("object_kind") == LITERAL)
    few = values.select("value").distinct().take(FEW + 1)
    # A few values are told to each task; else the statements go where the values are.
    hits = hits.filter(F.col("object_value").isin([r[0] for r in few if r[0] is not None])) if len(few) <= FEW else hits.join(values.select(F.col("value").alias("object_value")).distinct(), "object_value")
    at = hits.select(*own, F.col("object_value").alias("value"), "model", F.col("subject_id").alias("node"), F.col("subject_kind").alias("kind"))
    for p in reversed(steps[:-1]):
        up = _edges(rows, p).filter(F.col("object_kind") != LITERAL).select(*own, "model", F.col("object_id").alias("node"), F.col("subject_id").alias("next"), F.col("subject_kind").alias("next_kind"))
        at = at.join(up, [*own, "model", "node"]).select(*own, "value", "model", F.col("next").alias("node"), F.col("next_kind").alias("kind")).distinct()
    return at.filter(F.col("kind") == RESOURCE).select(*own, "value", "model", F.col("node").alias("record_id")).distinct()


def identifiers(statements: DataFrame, path: str | tuple[str, ...], records: DataFrame | None = None) -> DataFrame:
    """The literal (model, record_id, identifier) at the end of path for each record, the first of several in the order
    of places, then of values. Follows the path forwards from the records."""
    steps = split_path(path)
    statements = _led(statements, steps[:-1])
    own = homed(statements)
    start = statements if records is None else described(statements, records)
    at = start.filter(F.col("subject_kind") == RESOURCE).select(*own, "model", F.col("subject_id").alias("record_id"), F.col("subject_id").alias("node")).distinct()
    for p in steps[:-1]:
        down = _edges(statements, p).filter(F.col("object_kind") != LITERAL).select(*own, "model", F.col("subject_id").alias("node"), F.col("object_id").alias("next"))
        at = at.join(down, [*own, "model", "node"]).select(*own, "model", "record_id", F.col("next").alias("node"))
    ends = _edges(statements, steps[-1]).filter(F.col("object_kind") == LITERAL).select(*own, "model", F.col("subject_id").alias("node"), "idx", "object_value")
    best = at.join(ends, [*own, "model", "node"]).groupBy(*own, "model", "record_id").agg(F.min(F.struct("idx", "object_value")).alias("x"))
    return best.select("model", "record_id", F.col("x.object_value").alias("identifier"))


def same_records(new: DataFrame, old: DataFrame, path: str | tuple[str, ...] | None = None) -> DataFrame:
    """Pairs (model, record_id, stored_id) of the records of new and those of old that they are: by the identifier at
    path, or without path by URI. Of several stored records with one identifier the first counts."""
    if path is None:
        mine = new.select("model", "record_id").distinct()
        return mine.join(old.select("model", "record_id").distinct(), ["model", "record_id"]).withColumn("stored_id", F.col("record_id"))
    theirs = identifiers(old, path).groupBy("model", "identifier").agg(F.min("record_id").alias("stored_id"))
    return identifiers(new, path).join(theirs, ["model", "identifier"]).select("model", "record_id", "stored_id")


def by_uuid(statements: DataFrame, wanted: DataFrame) -> DataFrame:
    """Statements whose number is among wanted (stmt_uuid)."""
    return statements.join(wanted.select("stmt_uuid").distinct(), "stmt_uuid", "left_semi")
