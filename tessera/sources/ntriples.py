"""N-Triples as raw statements, one per line, so that files of any size are split among tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BNODE, LITERAL, RAW_COLUMNS, RESOURCE

# Subject, predicate and object of a line; not strict about what stands in URIs and behind the full stop.
LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s.]+(?:\.+[^\s.]+)*|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.?\s*(?:#.*)?$'


def unescaped(value: Column) -> Column:
    """Text of a literal: \\t, \\n, \\r, \\", \\\\ and \\u escapes become what they stand for. Doubled backslashes are set
    aside first, so that one before a letter is no escape of it. Escapes of no character stay as they are."""
    v = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'"), ("\\b", "\b"), ("\\f", "\f")):
        v = F.replace(v, F.lit(a), F.lit(b))
    parts = F.split(v, r"(?=\\u[0-9A-Fa-f]{4})|(?=\\U[0-9A-Fa-f]{8})")
    point = lambda h: F.decode(F.unhex(h), "UTF-32")
    one = lambda p: F.when(p.rlike(r"^\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}"), F.concat(point(F.concat(F.lit("0000"), F.substring(p, 3, 4))), F.substring(p, 7, 1 << 30))).when(
        p.rlike(r"^\\U(?!0000[dD][89a-fA-F])00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"), F.concat(point(F.substring(p, 3, 8)), F.substring(p, 11, 1 << 30))
    ).otherwise(p)
    v = F.when(v.contains("\\u") | v.contains("\\U"), F.array_join(F.transform(parts, one), "")).otherwise(v)
    return F.replace(v, F.lit("\x00"), F.lit("\\"))


def parse(lines: DataFrame, column: str, model: str | None) -> DataFrame:
    """Raw statements of lines (with RAW's columns, record_id and pos null). Comments and lines that are no triple give
    none; datatypes and languages of literals are not kept."""
    g = lambda k: F.regexp_extract(column, LINE, k)
    rows = lines.select(g(1).alias("s"), g(2).alias("p"), g(3).alias("o")).filter("s <> ''")
    blank = lambda c: F.col(c).startswith("_:")
    node = lambda c: F.when(blank(c), F.substring(c, 3, 1 << 30)).otherwise(F.expr(f"substring({c}, 2, length({c}) - 2)"))
    literal = F.col("o").startswith('"')
    text = F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)
    cols = {
        "model": F.lit(model).cast("string"), "record_id": F.lit(None).cast("string"), "pos": F.lit(None).cast("bigint"),
        "subject_kind": F.when(blank("s"), BNODE).otherwise(RESOURCE), "subject_id": node("s"), "predicate": F.col("p"),
        "object_kind": F.when(literal, LITERAL).when(blank("o"), BNODE).otherwise(RESOURCE), "object_id": F.when(~literal, node("o")),
        "object_value": F.when(literal, unescaped(text)), "ord": F.lit(None).cast("bigint"),
    }
    none = F.lit(None).cast("string")
    return rows.select(*[cols.get(c, none).alias(c) for c in RAW_COLUMNS])


def read(spark: SparkSession, path: str, model: str | None) -> DataFrame:
    return parse(spark.read.text(path), "value", model)
