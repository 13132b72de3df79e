"""Ending, deleting and counting statements, and the versions of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DEFAULT_MODEL, LITERAL, OPEN_END, homed
from .normalize import nodes


def allocate(versions: DataFrame, models: DataFrame, versioning: bool = True) -> DataFrame:
    """The version (model, version) at which a write to each model takes place: one after its latest, or without
    versioning the latest itself; a model without any starts at 1, or 0."""
    latest = models.select("model").distinct().join(versions, "model", "left")
    return latest.select("model", (F.coalesce("latest_version", F.lit(0)) + (1 if versioning else 0)).cast("int").alias("version"))


def publish(versions: DataFrame, written: DataFrame) -> DataFrame:
    """versions after writes (model, version, n): models in which anything changed, ended or moved rows included, have
    the new version, others keep theirs; a model's first write makes its row."""
    new = written.filter((F.col("n") > 0) | (F.col("version") == 0)).select("model", F.col("version").alias("latest_version"))
    return versions.select("model", "latest_version").unionByName(new).groupBy("model").agg(F.max("latest_version").alias("latest_version"))


def end(statements: DataFrame, which: Column, version: int | Column) -> DataFrame:
    """statements with valid_to = version for the open ones of which the condition holds."""
    v = F.lit(version) if isinstance(version, int) else version
    return statements.withColumn("valid_to", F.when(which & (F.col("valid_to") == OPEN_END), v.cast("int")).otherwise(F.col("valid_to")))


def deprecate_statements(statements: DataFrame, keys: DataFrame, version: int) -> DataFrame:
    """Ends the statements with one of the keys (stmt_key); they can be written again, as only open rows count as known."""
    by = [*homed(statements, keys), "stmt_key"]
    marked = statements.join(keys.select(by).distinct().withColumn("_hit", F.lit(True)), by, "left")
    return end(marked, F.coalesce("_hit", F.lit(False)), version).drop("_hit")


def deprecate_model(statements: DataFrame, model: str, version: int) -> DataFrame:
    return end(statements, F.col("model") == model, version)


def deprecate_records(statements: DataFrame, records: DataFrame, version: int | Column) -> DataFrame:
    """Ends all of the listed records (model, record_id); unknown ones are skipped."""
    keys = [*homed(statements, records), "model", "record_id"]
    listed = records.select(keys).distinct().withColumn("_hit", F.lit(True))
    return end(statements.join(listed, keys, "left"), F.coalesce("_hit", F.lit(False)), version).drop("_hit")


def missing_records(statements: DataFrame, types: DataFrame, incoming: DataFrame, type_uri: str, models: DataFrame) -> DataFrame:
    """Records of a class with open statements, in the models (model) written to, that the delivery lacks."""
    own = homed(statements, types, incoming)
    keys = [*own, "model", "record_id"]
    of_class = types.filter(F.col("type_uri") == type_uri).select(*own, "model", F.col("node_id").alias("record_id")).distinct()
    stored = statements.filter(F.col("valid_to") == OPEN_END).select(keys).distinct()
    stored = stored.join(of_class, keys, "left_semi").join(incoming.select(keys).distinct(), keys, "left_anti")
    return stored.join(F.broadcast(models.select("model").distinct()), "model", "left_semi")


def deprecated(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (deprecated) with the number of rows that ended."""
    count = lambda df: df.filter(F.col("valid_to") == OPEN_END).agg(F.count("*").alias("n"))
    return count(before).withColumnRenamed("n", "b").join(count(after)).select((F.col("b") - F.col("n")).alias("deprecated"))


def write_counters(statements: DataFrame, types: DataFrame) -> DataFrame:
    """One row (statements, relationships, literals, nodes) of what a write stores: types are statements but no
    relationships, and each literal is a node of its own."""
    own = statements.agg(F.count("*").alias("relationships"), F.coalesce(F.sum((F.col("object_kind") == LITERAL).cast("bigint")), F.lit(0)).alias("literals"))
    kinds = types.agg(F.count("*").alias("types"))
    others = nodes(statements, types).agg(F.count("*").alias("others"))
    return own.join(kinds).join(others).select(
        (F.col("relationships") + F.col("types")).alias("statements"), "relationships", "literals", (F.col("others") + F.col("literals")).alias("nodes")
    )


def deletion_rows(statements: DataFrame, types: DataFrame, prefixes: DataFrame) -> DataFrame:
    """One row (deleted): a row for each end of each statement, and one for each type and prefix, which have none."""
    ends = statements.agg((F.count("*") * 2).alias("a"))
    kinds = types.select("type_uri").distinct().agg(F.count("*").alias("b"))
    return ends.join(kinds).join(prefixes.agg(F.count("*").alias("c"))).select((F.col("a") + F.col("b") + F.col("c")).alias("deleted"))


def model_or_default(model: str | None) -> str:
    return DEFAULT_MODEL if model is None else model
