"""Queries of the operators on texts for training data. Their results come from no SQL; tests hold them instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, garble, mix

Query = Callable[[SparkSession, str], DataFrame]


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every row of documents; empty and null texts have none."""
    return bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.repair(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with the text as far as it can be restored, and whether all of it could be."""
    return _repaired(spark, sf_dir)


QUERIES: dict[str, Query] = {"p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}

ORACLE: dict[str, str] = {}
