"""Problems 1 to 5: their queries against SQL at the smallest scale, and what SQL can't show on small fixtures."""

from __future__ import annotations

from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import drift, rejects, snapdiff, wide


@pytest.mark.parametrize("name", ["p1_found", "p1_report", "p2_found", "p3_found", "p4_wide", "p5_found"])
def test_query_agrees_with_its_sql(spark, name) -> None:  # noqa: ANN001
    from oracle import compare

    assert compare(spark, name, "/root/testdata/sf0.001") == ""


def test_values_beyond_their_type_are_kept(spark) -> None:  # noqa: ANN001
    cells = ["1", "T"] + [""] * 20
    lines = [(1, "\t".join(["9" * 30, *cells[1:]])), (2, "\t".join(cells)), (3, None), (4, "x" * 100_000), (2, "\t".join(cells))]
    rows = rejects.load_records(rejects.parse_records(spark.createDataFrame(lines, "line_id bigint, c0 string"), "c0", rejects.LICENCE_LIST, ["line_id"]), rejects.LICENCE_LIST, ["line_id"]).collect()
    assert sorted((r.line_id, r.ezb_id, r.unheld) for r in rows if r.line_id == 1) == [(1, None, "ezb_id=" + "9" * 30)]
    assert [r.ezb_id for r in rows if r.line_id == 2] == [1, 1] and len(rows) == 3


def test_quotes_and_line_breaks_of_a_record() -> None:
    fmt = rejects.LineFormat((rejects.Field("a"), rejects.Field("b")), ",", '"')
    texts = ['x,"a ""b"", c\nd"', 'x,"a"b', 'x,y,z', None, "", 'x, "y"']
    reason, columns, shaped = rejects.classify(pa.array(texts, pa.string()), fmt)
    assert list(reason) == ["", "quoting", "columns", "columns", "columns", "quoting"]
    assert columns[1].to_pylist() == ['a "b", c\nd']


def _elements(spark, rows):  # noqa: ANN001, ANN202
    df = spark.createDataFrame(rows, "snap int, k bigint, at int, v string")
    return snapdiff.elements(df, F.col("snap"), F.col("k"), [F.col("at")], [F.col("v")])


def test_differences_of_snapshots_with_tiny_tables(spark) -> None:  # noqa: ANN001
    rows = [(1, k, 0, "a") for k in range(300)] + [(2, k, 0, "b" if k % 3 == 0 else "a") for k in range(30, 400)] + [(2, 31, 1, "late"), (None, 1, 0, "x"), (2, None, 0, "x")] + [(4, 1, 0, "z")] * 3
    got = {(r["diff"], r["key"]): r["kind"] for r in snapdiff.differences(_elements(spark, rows), bucket_items=50, cells=6).collect()}
    want = {(2, k): "removed" for k in range(30)} | {(2, k): "added" for k in range(300, 400)} | {(2, k): "changed" for k in range(30, 300) if k % 3 == 0} | {(2, 31): "changed"}
    want |= {(3, k): "removed" for k in range(30, 400)} | {(4, 1): "added"}
    assert got == want


GDM = "row_id bigint, loaded_at timestamp, record_id string, subject_kind string, subject_id string, predicate string, object_kind string, object_value string, ord bigint, uuid string, extra string"


def test_cells_of_odd_statements(spark) -> None:  # noqa: ANN001
    at = datetime(2020, 1, 1)
    row = lambda i, p, v, order=1, uuid=None, rec="r": (i, at, rec, "RESOURCE", rec, p, "LITERAL", v, order, uuid, "x")
    rows = [
        row(1, "http://a#EBL+ID", "7", uuid="U1"), row(2, "http://a#EBL+ID", "8", uuid="u1"), row(None, "a:Title", "t"), row(None, "a:Title", "t"), row(3, "a:Copies", "9" * 5000),
        row(4, "a:More", "m"), row(5, None, "m"), row(6, "a:50%", "p"), row(7, "a:Title", None), row(8, "a:Title", "late", order=2), row(9, "a:record_id", "own"), row(10, "x", "y", rec=None),
    ]
    df = spark.createDataFrame(rows, GDM)
    got = wide.wide(df, columns=["ebl_id", "title", "copies"]).collect()
    assert [(r.record_id, r.ebl_id, r.title, r.copies) for r in got] == [("r", 8, "t", None)]
    assert got[0].more == {"copies": "9" * 5000, "more": "m", "50": "p", "record_id": "own"}
    assert wide.filled_cells(df.limit(0)).count() == 0


FEED = "row_id bigint, feed_no int, file_no int, report_date date, delivered_at timestamp, payload string"


def _feed(spark, files):  # noqa: ANN001, ANN202
    rows = [(10 * f + k, 1, f, date(2020, 1, f), datetime(2020, 1, f), p) for f, payloads in files.items() for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, FEED)


def _names(spark):  # noqa: ANN001, ANN202
    return spark.createDataFrame([("ausleihen", "loans")], "name_key string, field_key string")


DRIFTING = {
    1: ['{"Owned Loans": 5, "Total Owned Loan Days": 7, "Zeta": true}', "broken", None, "[1]"],
    2: ['{"Owned Loans": 5.5, "Total Owned Loans Day": 8, "zeta": true}'],
    3: ['{"Owned Loans": 99999999999999999999, "owned loans": 6, "Ausleihen": 1}'],
}


def test_flooding_joins_fields_that_the_keys_leave_open(spark, monkeypatch) -> None:  # noqa: ANN001
    feed, names = _feed(spark, DRIFTING), _names(spark)
    changes = {(r.file_no, r.field_key, r.change_kind) for r in drift.field_changes(feed, names).collect()}
    assert (2, "zeta", "renamed") in changes and (2, "ownedloans", "retyped") in changes and (3, "loans", "added") in changes
    assert (2, "totalownedloansday", "added") in changes and (2, "totalownedloandays", "removed") in changes
    assert [(r.old_key, r.new_key) for r in drift.suggestions(feed, names).collect()] == [("totalownedloandays", "totalownedloansday")]
    table = {r.row_id: r for r in drift.consistent_table(feed, names).collect()}
    assert len(table) == 3 and (table[10].f_totalownedloandays, table[20].f_totalownedloandays) == (7, 8)
    assert table[30].f_ownedloans == 6 and table[30].more == {"Owned Loans": "99999999999999999999"} and table[30].f_loans == 1
    # Without scores nothing joins the two fields.
    a, b = (("x", "totalownedloandays", 2),), (("y", "totalownedloansday", 2),)
    assert drift.correspondences(a, b) != []
    flood = drift.flood
    monkeypatch.setattr(drift, "flood", lambda *x: (*flood(*x)[:3], flood(*x)[3] * 0))
    assert drift.correspondences(a, b) == []


def test_drift_of_empty_feeds(spark) -> None:  # noqa: ANN001
    feed, names = _feed(spark, {1: [None]}), _names(spark).limit(0)
    assert drift.field_changes(feed.limit(0), names).count() == 0 and drift.field_changes(feed, names).count() == 0
    assert drift.consistent_table(feed, names).count() == 0
