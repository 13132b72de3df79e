"""Statements: sources, changes, store and sinks, on small fixtures and against brute force."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.ids import sip_2_4
from tessera.model import BNODE, HOME, LITERAL, OPEN_END, RAW, RDF_TYPE, RESOURCE, STATEMENT
from tessera.operators import delta, delta_home, maintain, normalize, reads, traverse
from tessera.operators.store import Store
from tessera.session import durable
from tessera.sinks import rdf, statement_json, xml
from tessera.sources import ntriples, turtle
from tessera.sources import statement_json as source

P = "http://e/"


def raw(spark, rows):  # noqa: ANN001, ANN201
    """Rows of (record, subject, predicate, object, ord); names that begin with _ are blank nodes, with : URIs."""
    out = []
    for k, (rec, s, p, o, order) in enumerate(rows):
        kind = lambda x: BNODE if x.startswith("_") else RESOURCE if ":" in x else LITERAL
        out.append(("m", rec, k + 1, kind(s), s, p if ":" in p else P + p, kind(o), None if kind(o) == LITERAL else o, o if kind(o) == LITERAL else None, order, None, None, None))
    return spark.createDataFrame(out, RAW)


def leaf_lines(statements):  # noqa: ANN001, ANN201
    """Leaves of a state by record and path, whatever the names of blank nodes."""
    rows = traverse.located(statements).filter(F.col("object_kind") != BNODE)
    return sorted((r.record_id, r.t, r.v) for r in rows.select("record_id", traverse.path_text(F.col("path"), F.col("predicate"), F.col("ord")).alias("t"), F.coalesce("object_value", "object_id").alias("v")).collect())


def test_sip_hash_of_the_published_vector() -> None:
    # Fixed value: the digest of the bytes 0 to 14 in the paper on SipHash.
    assert sip_2_4([bytes(range(15)), b"", None])[0].astype("uint64") == 0xA129CA6149BE45E5
    many = [bytes([k % 256]) * k for k in range(40)]
    assert list(sip_2_4(many)) == [sip_2_4([m])[0] for m in many]


def _record(r: random.Random, name: str) -> list[tuple]:
    rows = [(name, name, f"p{r.randrange(3)}", r.choice("abc"), r.choice([None, 1, 2])) for _ in range(r.randrange(5))]
    for k in range(r.randrange(4)):
        node = f"_{name}{k}"
        rows.append((name, name, "item", node, r.choice([None, k])))
        rows += [(name, node, "key", r.choice("xy"), None), (name, node, "val", r.choice("12"), None)][: r.randrange(3)]
        if r.random() < 0.5:
            rows.append((name, node, "sub", node + "s", None))
            rows += [(name, node + "s", f"q{r.randrange(2)}", r.choice("uv"), None) for _ in range(r.randrange(3))]
    return rows


@pytest.mark.parametrize("schema", [delta.ContentSchema(), delta.ContentSchema(keys=((P + "item", P + "key"),), value=(P + "item", P + "val"))])
def test_changes_lead_from_old_to_new_and_classify_once(spark, schema) -> None:  # noqa: ANN001
    r = random.Random(5)
    names = [f"http://r/{k}" for k in range(12)]
    old = durable(normalize.normalize(raw(spark, [x for n in names for x in _record(r, n)]), "a").statements)
    new = durable(normalize.normalize(raw(spark, [x for n in names for x in _record(r, n)]), "b").statements)
    found = delta.changes(old, new, schema)
    both = delta.sides(old, new)
    for side, name in ((0, "old"), (1, "new")):
        mine = sorted(x[0] for x in both.filter(F.col("side") == side).select("stmt_key").collect())
        seen = sorted(x[0] for x in found.rows.filter(F.col(name).isNotNull()).select(F.col(name)["stmt_key"]).collect())
        assert mine == seen
    after, _ = delta.put(normalize.stamped(old, 1), new, 2, schema)
    keep = old.join(new.select("record_id").distinct(), "record_id", "left_anti")
    assert leaf_lines(reads.as_of(after, 2)) == leaf_lines(new.unionByName(keep))
    assert leaf_lines(reads.as_of(after, 1)) == leaf_lines(old)


def change_lines(rows):  # noqa: ANN001, ANN201
    return sorted(map(repr, rows.select("model", "record_id", "step", "state", "old.stmt_key", F.col("new.stmt_key").alias("k")).collect()))


@pytest.mark.parametrize("large", [0, 10**6])
@pytest.mark.parametrize("schema", [delta.ContentSchema(), delta.ContentSchema(keys=((P + "item", P + "key"),), value=(P + "item", P + "val"))])
def test_changes_are_the_same_where_statements_are_spread_by_home(spark, schema, large, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(delta, "LARGE", large)
    r = random.Random(9)
    names = [f"http://r/{k}" for k in range(25)]
    old, new = (normalize.normalize(raw(spark, [x for n in names[:m] for x in _record(r, n)]), load).statements for load, m in (("a", 25), ("b", 22)))
    old, new = durable(old), durable(new)
    want = delta.changes(old, new, schema)
    home = lambda df: df.withColumn(HOME, F.ascii(F.substring("record_id", -1, 1)).cast("bigint")).repartition(4, HOME)
    found = delta.changes(home(old), home(new), schema)
    assert change_lines(found.rows) == change_lines(want.rows)
    assert sorted(map(repr, found.nodes.drop(HOME).collect())) == sorted(map(repr, want.nodes.select("model", "record_id", "old_node", "new_node").collect()))


@pytest.mark.parametrize("large", [0, 10**6])
def test_states_are_counted_where_the_statements_are(spark, large, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(delta, "LARGE", large)
    r = random.Random(9)
    names = [f"http://r/{k}" for k in range(25)]
    old, new = (durable(normalize.normalize(raw(spark, [x for n in names for x in _record(r, n)]), load).statements) for load in "ab")
    home = lambda df: df.withColumn(HOME, F.ascii(F.substring("record_id", -1, 1)).cast("bigint")).repartition(4, HOME)
    for side in (0, 1):
        rows = delta.unsettled(home(old), home(new), side).groupBy(HOME, "stmt_key").agg(F.sum("states").alias("n"), F.sum("settled").alias("settled")).collect()
        keys = [x for x in rows if x.stmt_key is not None]
        assert all(x.n == 1 for x in keys)
        assert len(keys) + sum(x.settled for x in rows) == delta.sides(old, new).filter(F.col("side") == side).count()
        assert large == 0 or not keys  # nothing else is shuffled
    rows = [(1, "a", 0), (1, "a", 1), (1, "b", 0), (2, "a", 0), (2, "a", 1), (2, "a", 1)]
    batch = pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), names=["home", "stmt_key", "states"])
    found = [tuple(x.values()) for cut in range(6) for b in delta_home.unsettled(iter([batch.slice(0, cut), batch.slice(cut)])) for x in b.to_pylist() if x["stmt_key"] or x["settled"]]
    assert set(found) == {(1, "b", 0, 0), (2, "a", 2, 0), (None, None, 0, 1)} and len(found) == 18


def test_blank_nodes_are_counted_at_home(spark) -> None:  # noqa: ANN001
    r = random.Random(3)
    loads = [durable(raw(spark, [x for n in names for x in _record(r, n)] + [(names[0], names[0], "see", "http://r/9", None), (names[1], names[1], "see", "http://x/1", None)])) for names in ([f"http://r/{k}" for k in ks] for ks in (range(8), range(3, 12)))]
    kinds = [normalize.normalize(x, "a", P + "see") for x in loads]
    home = lambda df: df.withColumn(HOME, F.ascii(F.substring("record_id", -1, 1)).cast("bigint")).repartition(4, HOME)
    at = [normalize.Normalized(home(n.statements), home(n.types), n.rejects) for n in kinds]
    found = normalize.fresh_counts(*at)
    want = normalize.nodes(kinds[1].statements, kinds[1].types).join(normalize.nodes(kinds[0].statements, kinds[0].types), ["model", "node_id"], "left_anti").groupBy("model", "kind").count().collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) == sorted(map(tuple, normalize.fresh_counts(*kinds).collect()))
    assert {x.kind for x in want} >= {BNODE, RESOURCE}
    # Blank nodes are not among what is shuffled by node.
    assert "blank" in next(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(model" in x and "node_id" in x)


def test_same_delivery_again_changes_nothing(spark) -> None:  # noqa: ANN001
    rows = [("http://r/1", "http://r/1", "p", "v", None), ("http://r/1", "http://r/1", "item", "_b", 1), ("http://r/1", "_b", "key", "k", None)] * 2
    one, two = (normalize.normalize(raw(spark, rows), x).statements for x in "ab")
    assert one.count() == 3
    assert not delta.has_changes(delta.changes(one, two))
    empty = one.limit(0)
    assert delta.changes(empty, two).rows.count() == 0


def test_cycles_and_links_to_nothing_are_told(spark) -> None:  # noqa: ANN001
    rows = [("http://r/1", "http://r/1", "p", "_a", None), ("http://r/1", "_a", "p", "_b", None), ("http://r/1", "_b", "p", "_a", None), ("http://r/1", "_lost", "p", "v", None)]
    n = normalize.normalize(raw(spark, rows), "x").statements
    record = spark.createDataFrame([("m", "http://r/1")], "model string, record_id string")
    assert reads.described_by_links(n, record).count() == 3
    with pytest.raises(ValueError, match="chain"):
        traverse.blank_paths(n, depth=5)
    owned = {r.subject_id: r.record_id for r in normalize.owners(n.drop("record_id")).collect()}
    assert set(owned.values()) == {"http://r/1", next(k for k in owned if k not in ("http://r/1",) and owned[k] == k)}


def test_nulls_and_unknown_kinds_are_rejected(spark) -> None:  # noqa: ANN001
    good = ("m", "http://r", 1, RESOURCE, "http://r", P + "p", LITERAL, None, "", None, None, None, None)
    bad = [good[:3] + (None,) + good[4:], good[:5] + (None,) + good[6:], good[:8] + (None,) + good[9:], good[:6] + ("THING",) + good[7:]]
    n = normalize.normalize(spark.createDataFrame([good, *bad], RAW), "x")
    assert n.statements.count() == 1
    assert sorted(r.fault for r in n.rejects.collect()) == ["object", "object", "predicate", "subject"]


def test_store_puts_reads_ends_and_wipes(spark, tmp_path) -> None:  # noqa: ANN001
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [("http://r/1", "http://r/1", RDF_TYPE, P + "T", None), ("http://r/1", "http://r/1", "p", "v", None), ("http://r/2", "http://r/2", RDF_TYPE, P + "T", None), ("http://r/2", "http://r/2", "p", "w", None)]
    put = lambda some, load, **k: store.put(normalize.normalize(raw(spark, some), load), **k)
    assert put(rows, "a") == {"m": 1}
    assert put(rows, "b") == {}
    assert put([rows[0], ("http://r/1", "http://r/1", "p", "new", None)], "c", deprecate_missing=P + "T") == {"m": 2}
    now = {(r.record_id, r.object_value) for r in reads.as_of_default(store.statements(), store.versions()).collect()}
    assert now == {("http://r/1", "new")}
    assert {r.object_value for r in reads.as_of(store.statements(), 1).collect()} == {"v", "w"}
    assert put(rows[2:], "d") == {"m": 3}  # a record that had ended comes back
    assert store.deprecate(model="m") == {"deprecated": 2}
    assert store.deprecate(model="m") == {"deprecated": 0}
    assert store.vacuum() > 0 and store.statements().count() == 4
    assert store.wipe()["deleted"] == 4 * 2 + 1 + 5
    assert store.statements().count() == 0
    assert store.put(normalize.normalize(raw(spark, []), "e")) == {}


def test_sources_and_sinks_agree(spark, tmp_path) -> None:  # noqa: ANN001
    text = """@prefix e: <http://e/> . e:r a e:T ; e:p "a \\"b\\"\\n\\\\t" , "ü"@de ; e:i [ e:key "k" ; e:n 5 ] . # end"""
    (tmp_path / "a.ttl").write_text(text)
    n = normalize.normalize(turtle.read(spark, f"file://{tmp_path}/a.ttl", "m"), "x")
    statements = durable(normalize.owners(n.statements))
    assert statements.count() == 5 and n.types.count() == 1
    assert {r[0] for r in statements.select("record_id").distinct().collect()} == {"http://e/r"}
    again = normalize.normalize(ntriples.parse(rdf.n_triples(statements), "value", "m"), "y").statements
    view = lambda df: sorted((r.predicate, r.object_kind, r.object_value or "") for r in df.collect())
    assert view(again) == view(statements)
    record = statement_json.one_record(statements, n.types, "m", "http://e/r")
    assert record and statement_json.one_record(statements, n.types, "m", "http://none") is None
    # Labels of blank nodes in statement JSON are numbers, so only the rest comes back.
    back = source.parse(spark.createDataFrame([(record.replace('"id":"', '"id":0,"_":"'),)], "value string"), "value", "m", one_record=True)
    assert back.count() == 6
    tags = spark.createDataFrame([("m", "http://e/r", "http://e/T")], "model string, record_id string, tag string")
    value = xml.records(statements, tags).first().value
    import xml.etree.ElementTree as tree

    root = tree.fromstring(value)
    assert root.tag == "{http://e/}T" and [c.tag for c in root].count("{http://e/}p") == 2
    assert root.find("{http://e/}i").find("{http://e/}key").text == "k"
    assert tree.fromstring(xml.records(statements, tags, xml_mode=True).first().value).find("{http://e/}i").attrib == {"key": "k", "n": "5"}
    with pytest.raises(LookupError):
        rdf.export(normalize.stamped(statements, 1), f"file://{tmp_path}/out", model="none")
    with pytest.raises(ValueError, match="format"):
        rdf.accepted("text/html")
    rdf.export(normalize.stamped(statements, 1), f"file://{tmp_path}/out", "application/rdf+xml")
    for part in (tmp_path / "out").glob("part*"):
        if part.stat().st_size:
            tree.parse(part)


def test_unescaped_literals(spark) -> None:  # noqa: ANN001
    lines = [r'<http://a> <http://b> "x\\ty\té\U0001F600\"" .', "# comment", "", "nonsense", "_:a.b <http://b> _:c ."]
    got = [r.object_value or r.object_id for r in ntriples.parse(spark.createDataFrame([(x,) for x in lines], "value string"), "value", None).collect()]
    assert got == ['x\\ty\té😀"', "c"]


def test_empty_tables_give_empty_results(spark) -> None:  # noqa: ANN001
    empty = spark.createDataFrame([], STATEMENT)
    assert reads.search(empty, (P + "a", P + "b"), spark.createDataFrame([("v",)], "value string")).count() == 0
    assert traverse.blank_paths(empty).count() == 0 and traverse.subtree_hashes(empty).count() == 0
    assert rdf.n_quads(empty).count() == 0 and maintain.deprecate_model(empty, "m", 2).count() == 0
    assert delta.apply(empty, delta.changes(empty, empty), 2).filter(F.col("valid_to") == OPEN_END).count() == 0
