"""Queries over the shop's statements spread the tables' rows once and keep no statements on disk."""

from __future__ import annotations

import re
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry
from tessera import session

SF = next(p for p in (Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")) if p.exists())

#: The number of exchanges besides those of the tables' rows: counts are summed up by one, and what was matched by key is.
EXCHANGES = {
    "xml_nested_record": 0,
    "unmatched_paths": 1,
    "cs_exact": 0,
    "cs_entities": 0,
    "cs_entity_order": 1,
    "xml_attributes": 0,
    "delta_complete": 2,
    "flat_values_exact": 0,
    "changeset_counts": 1,
    "cs_value_modified": 1,
    "cs_value_exact": 1,
    "delta_states": 1,
    "record_identifier": 0,
    "level_nodes": 0,
    "new_records": 0,
    "search_records": 0,
    "deprecate_missing": 1,
    "as_of_latest": 0,
    "deprecate_model": 1,
    "default_version": 1,
    "all_versions": 0,
    "validity_stamp": 1,
}


@pytest.mark.parametrize("name", EXCHANGES)
def test_statements_are_neither_stored_nor_moved(spark, name, monkeypatch) -> None:  # noqa: ANN001
    def refuse(df):  # noqa: ANN001, ANN202
        raise AssertionError("statements are written")

    monkeypatch.setattr(session, "stored", refuse)
    monkeypatch.setattr("tessera.plans.graph.stored", refuse, raising=False)
    monkeypatch.setattr("tessera.operators.traverse.stored", refuse, raising=False)
    monkeypatch.setattr("tessera.operators.delta.stored", refuse, raising=False)
    monkeypatch.setattr("tessera.sinks.xml.stored", refuse, raising=False)
    plan = entry.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in re.findall(r"Exchange hashpartitioning\((.*)", plan) if "REPARTITION_BY" not in x]
    assert len(moved) == EXCHANGES[name], moved
    assert oracle.compare(spark, name, str(SF)) == ""
