"""Records as statement JSON: an object with the record's URI and the array of its statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BNODE, LITERAL
from ..operators.reads import nested, with_types


def records(statements: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Rows (model, record_id, value): the JSON text of each record, its statements by position and, with types, a
    statement for each type. Absent qualifiers are left out."""
    rows = statements.withColumn("sub_pos", F.lit(1)).withColumn("is_type", F.lit(False))
    if types is not None:
        rows = with_types(statements, types, statements.select("model", "record_id").distinct())
    blank = lambda kind, node: F.struct(F.when(F.col(kind) == BNODE, F.col(node)).alias("id"), F.when(F.col(kind) != BNODE, F.col(node)).alias("uri"))
    literal = F.when(F.col("object_kind") == LITERAL, F.col("object_value"))
    node = blank("object_kind", "object_id")
    part = F.struct(
        F.when(~F.col("is_type"), F.col("stmt_uuid").cast("string")).alias("uuid"), blank("subject_kind", "subject_id").alias("s"), F.col("predicate").alias("p"),
        F.struct(node["id"].alias("id"), node["uri"].alias("uri"), literal.alias("v")).alias("o"),
        F.col("ord").alias("order"), "evidence", "confidence",
    )
    made = nested(rows, part, ["idx", "sub_pos", "predicate"], "all")
    return made.select("model", "record_id", F.to_json(F.create_map("record_id", "all")).alias("value"))


def one_record(statements: DataFrame, types: DataFrame, model: str, record_id: str) -> str | None:
    """JSON text of one record, None where it has no statement."""
    pick = (F.col("model") == model) & (F.col("record_id") == record_id)
    row = records(statements.filter(pick), types.filter(pick)).first()
    return None if row is None else row["value"]


def lines(statements: DataFrame, types: DataFrame | None = None):  # noqa: ANN201
    """The records one after the other, for a response that is streamed: a task's result at a time is on the driver."""
    for row in records(statements, types).select("value").toLocalIterator():
        yield row[0]
