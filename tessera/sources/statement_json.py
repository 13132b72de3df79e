"""Statement JSON as raw statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RAW_COLUMNS
from ..operators.normalize import object_kind, subject_kind

NODE = "struct<id:bigint,uri:string,data_model:string"
STATEMENT = f"struct<id:bigint,uuid:string,order:bigint,evidence:string,confidence:string,s:{NODE}>,p:string,o:{NODE},v:string>>"
RECORD = f"map<string,array<{STATEMENT}>>"


def parse(texts: DataFrame, column: str, model: str | None, one_record: bool = False) -> DataFrame:
    """Raw statements of JSON texts, each an array of objects {record: [statement, ...]}, or one such object. Positions
    count from 1 in each record; an object without value and URI is a blank node. A text that is no JSON gives none."""
    if one_record:
        rows = texts.select(F.from_json(F.col(column), RECORD).alias("r"))
    else:
        rows = texts.select(F.explode(F.from_json(F.col(column), f"array<{RECORD}>")).alias("r"))
    rows = rows.select(F.explode("r").alias("record_id", "all")).select("record_id", F.posexplode("all").alias("pos", "s"))
    name = lambda n, kind: F.when(kind == "BNODE", n["id"].cast("string")).otherwise(n["uri"])
    s, o = F.col("s.s"), F.col("s.o")
    sk, ok = subject_kind(s["uri"]), object_kind(o["v"], o["uri"])
    own = F.lit(model) if model is not None else F.coalesce(s["data_model"], F.lit(None).cast("string"))
    return rows.select(
        own.alias("model"), "record_id", (F.col("pos") + 1).cast("bigint").alias("pos"), sk.alias("subject_kind"), name(s, sk).alias("subject_id"),
        F.col("s.p").alias("predicate"), ok.alias("object_kind"), name(o, ok).alias("object_id"), o["v"].alias("object_value"),
        F.col("s.order").alias("ord"), F.col("s.evidence").alias("evidence"), F.col("s.confidence").alias("confidence"), F.col("s.uuid").alias("uuid"),
    ).select(RAW_COLUMNS)


def read(spark: SparkSession, path: str, model: str | None, lines: bool = False) -> DataFrame:
    """Raw statements of files. A file that is one array is read by one task, which limits its size to what a task
    holds; with lines each line is a record, and files of any size are split."""
    texts = spark.read.text(path, wholetext=not lines)
    return parse(texts.filter(F.trim("value") != ""), "value", model, lines)


def one(raw: DataFrame, record_id: str) -> DataFrame:
    """The statements of a single record."""
    return raw.filter(F.col("record_id") == record_id)
