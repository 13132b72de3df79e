"""A put of statements with HOME gives the same history as one without; statements are not stored, and only the lines of the digests are shuffled."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import session
from tessera.model import HOME, STATEMENT_COLUMNS
from tessera.operators import delta, normalize, traverse
from tessera.plans import graph

SF = next(p for p in (Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")) if p.exists())


@pytest.fixture(scope="module")
def deliveries(spark):  # noqa: ANN001, ANN201
    """Both deliveries of some orders, with a statement that has no record, one twice and one below a shared node."""
    some = lambda df: df.filter(F.col(HOME) % 40 < 3).localCheckpoint()
    one, two = map(some, graph._two(spark, str(SF)))
    stray = two.limit(1).withColumn("record_id", F.lit(None).cast("string"))
    shared = two.filter("object_kind = 'BNODE' and subject_id = record_id").limit(3).withColumn("predicate", F.lit("http://shop.example/vocab#also"))
    return one, two.unionByName(stray).unionByName(two.filter(F.col(HOME) % 40 == 1)).unionByName(shared).localCheckpoint()


def test_history_is_the_same(spark, deliveries) -> None:  # noqa: ANN001
    one, two = deliveries
    near, far = normalize.stamped(one, 1), normalize.stamped(one.drop(HOME), 1)
    for version, new in ((2, two), (3, one)):  # the second one finds closed rows
        near, found = delta.put(session.colocated(near, HOME), session.colocated(new, HOME), version, graph.ITEMS)
        far, _ = delta.put(far, new.drop(HOME), version, graph.ITEMS)
        near, far = near.localCheckpoint(), far.localCheckpoint()
        assert HOME in near.columns
        a, b = near.select(STATEMENT_COLUMNS), far.select(STATEMENT_COLUMNS)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert near.filter("valid_to < 3").count() > 0
    rows = session.colocated(near.filter("valid_to > 3").withColumn("version", F.lit(3)), HOME)
    cols = [*STATEMENT_COLUMNS, "version", "path"]
    a, b = traverse.located_at_home(rows, "version", found.large).select(cols), traverse.located(rows.drop(HOME), ["version"]).select(cols)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_delta_apply_stores_nothing(spark, monkeypatch) -> None:  # noqa: ANN001
    def refuse(df):  # noqa: ANN001, ANN202
        raise AssertionError("statements are written")

    for module in ("tessera.session", "tessera.plans.graph", "tessera.operators.traverse", "tessera.operators.delta"):
        monkeypatch.setattr(f"{module}.stored", refuse, raising=False)
    plan = entry.queries()["delta_apply"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in re.findall(r"Exchange hashpartitioning\((.*)", plan) if "REPARTITION_BY" not in x]
    assert len(moved) == 1, moved  # what follows an Arrow function is not known to be spread
