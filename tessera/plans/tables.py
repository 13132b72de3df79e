"""Queries of the table-cleaning operators (p1 to p5) and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, ledger, rejects, snapdiff, wide
from ..session import table
from .tables_sql import ORACLE  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

LISTS = (("lic_dmp_v1", "c0", rejects.LICENCE_LIST, 6), ("title_report_01", "raw_line", rejects.TITLE_REPORT, 2))


def _lines(spark: SparkSession, sf_dir: str, name: str, first: int) -> DataFrame:
    return table(spark, sf_dir, name).filter((F.col("line_no") >= first) | F.col("line_no").isNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        rejects.parse_records(_lines(spark, sf_dir, name, first), text, fmt, ["line_id"], rejects_only=True).select(F.lit(name).alias("src"), "line_id", "reason")
        for name, text, fmt, first in LISTS
    ]
    return parts[0].unionByName(parts[1])


def _loaded(k: int) -> Query:
    name, text, fmt, first = LISTS[k]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rejects.load_records(rejects.parse_records(_lines(spark, sf_dir, name, first), text, fmt, ["line_id"]), fmt, ["line_id"])

    return run


def _ledger(spark: SparkSession, sf_dir: str, unit: str | None = None) -> DataFrame:
    return ledger.ledger(ledger.title_points(table(spark, sf_dir, "title_update")), unit)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ledger.versions(_ledger(spark, sf_dir, "day"), ["owned", "renewal_date"])
    return held.select(F.col("entity").alias("ebl_id"), F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ledger.versions(_ledger(spark, sf_dir, "day"), ["owned", "renewal_date"])
    return held.select(F.col("entity").alias("ebl_id"), "owned", "renewal_date", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


# The SQL names the same time.
AS_OF = "2021-07-01 00:00:00"


def p2_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as it was held at the start of AS_OF, when updates received later were not known."""
    held = ledger.versions(_ledger(spark, sf_dir), ["owned", "renewal_date"], AS_OF)
    return held.select(F.col("entity").alias("ebl_id"), "owned", "renewal_date", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


def p2_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).withColumnRenamed("entity", "ebl_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapdiff.differences(snapdiff.title_elements(table(spark, sf_dir, "title_snapshot")))
    return changes.select(F.col("diff").alias("snap_no"), F.col("key").alias("ebl_id"), F.col("kind").alias("change_kind"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.filled_cells(table(spark, sf_dir, "gdm_statement"))


P4_COLUMNS = ["title", "ebl_id", "copies", "owned", "renewal_date", "purchase_price", "category", "publisher", "pubdate", "ezb_id", "titel"]


def p4_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, with all attributes: those named have columns, all else comes in others, a line of name=value
    for each in the order of the names."""
    rows = wide.wide(table(spark, sf_dir, "gdm_statement"), columns=P4_COLUMNS)
    entries = F.transform(F.array_sort(F.map_entries("more")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("record_id", *P4_COLUMNS, F.array_join(entries, "\n").alias("others"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.wide(table(spark, sf_dir, "gdm_statement"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.field_changes(table(spark, sf_dir, "title_feed"), table(spark, sf_dir, "field_names"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf_dir, "title_feed"), table(spark, sf_dir, "field_names"))


def p5_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.suggestions(table(spark, sf_dir, "title_feed"), table(spark, sf_dir, "field_names"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_licences": _loaded(0), "p1_report": _loaded(1),
    "p2_found": p2_found, "p2_history": p2_history, "p2_as_of": p2_as_of, "p2_ledger": p2_ledger,
    "p3_found": p3_found,
    "p4_found": p4_found, "p4_wide": p4_wide, "p4_table": p4_table,
    "p5_found": p5_found, "p5_table": p5_table, "p5_suggestions": p5_suggestions,
}
