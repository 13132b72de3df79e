"""Schemas that drift between files: one consistent table and a report of each change.

A pass over the payloads in Arrow batches gives for each file its field names with the types seen, reduced
within the batch and again with a map-side aggregate. For each two consecutive counted files of a feed, the
two schemas become graphs of a root, fields, names, types and nesting; similarity flooding propagates match
scores through the pairs of nodes until they no longer move, and a one-to-one selection turns the scores
into correspondences. Fields with the same key correspond by definition; between the others the scores decide.
Fields without a partner are added or removed. Correspondences of the second sort are suggestions: they change
nothing in the report, whose terms are keys, but the consistent table puts both fields into one column.

Scale. Names are reduced to one row per file before anything else, so work depends on the number of files and
fields. Files with the same fields as the one before need no matching; the others are spread by their pair of
schemas over all tasks, not by feed. Pairs of fields that share neither key nor any three letters are left out
of the graph, as they can't correspond. The dictionary of names is joined, whatever its size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, shuffle_width

BOOLEAN, INTEGER, DECIMAL, STRING = 1, 2, 4, 8
TYPE_NAMES = {0: None, BOOLEAN: "boolean", INTEGER: "integer", DECIMAL: "decimal", INTEGER | DECIMAL: "decimal"}


def _refuse(text: str) -> None:
    raise ValueError(text)


_READER = json.JSONDecoder(parse_int=lambda s: INTEGER, parse_float=lambda s: DECIMAL if "." in s else INTEGER, parse_constant=_refuse)


def _clean(name: str) -> str:
    return name.encode("utf-8", "replace").decode()


def type_bits(payload: str | None) -> dict[str, int] | None:
    """Field names of a payload with the bit of each value's type, 0 for null; fields of nested objects follow
    as path/name. None for what is not a JSON object."""
    try:
        value = _READER.decode(payload.strip(" \t\n\r")) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    out: dict[str, int] = {}
    stack = [("", value)]
    while stack:
        path, fields = stack.pop()
        for name, v in fields.items():
            at = path + _clean(name)
            if isinstance(v, bool):
                bit = BOOLEAN
            elif isinstance(v, int):
                bit = v
            else:
                bit = 0 if v is None else STRING
                if isinstance(v, dict):
                    stack.append((at + "\x1f", v))
            out[at] = out.get(at, 0) | bit
    return out


def profile(feed: DataFrame) -> DataFrame:
    """Rows (feed_no, file_no, report_date, delivered_at, name, bits): the fields of each file with the types
    seen, and a row with null name for the file itself, so that one without any readable payload counts too."""
    schema = "feed_no int, file_no int, report_date date, delivered_at timestamp_ntz, name string, bits int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, int] = {}
            for *file, payload in zip(*[c.to_pylist() for c in b.columns], strict=True):
                file = tuple(file)
                seen[(*file, None)] = 0
                for name, bit in (type_bits(payload) or {}).items():
                    key = (*file, name)
                    seen[key] = seen.get(key, 0) | bit
            cols = [list(x) for x in zip(*[(*k, v) for k, v in seen.items()], strict=True)] or [[]] * 6
            types = [pa.int32(), pa.int32(), pa.date32(), pa.timestamp("us"), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["feed_no", "file_no", "report_date", "delivered_at", "name", "bits"])

    rows = feed.select("feed_no", "file_no", "report_date", F.col("delivered_at").cast("timestamp_ntz").alias("delivered_at"), "payload").mapInArrow(run, schema)
    return rows.groupBy("feed_no", "file_no", "name").agg(F.max("report_date").alias("report_date"), F.max("delivered_at").alias("delivered_at"), F.bit_or("bits").alias("bits"))


def keyed(profiled: DataFrame, names: DataFrame) -> DataFrame:
    """profiled with the key of each name, null for null. Of a nested field the keys of the path are divided by U+001F.
    Of several field keys of one name key the first counts."""
    plain = F.array_join(F.transform(F.split("name", "\x1f"), field_key), "\x1f")
    other = names.select("name_key", F.col("field_key").alias("mapped")).dropna().groupBy("name_key").agg(F.min("mapped").alias("mapped"))
    return profiled.withColumn("name_key", plain).join(other, "name_key", "left").withColumn("key", F.coalesce("mapped", "name_key")).drop("mapped")


def counted_schemas(profiled: DataFrame) -> DataFrame:
    """Rows (feed_no, file_no, seq, fields) of the counted files, of a keyed profile: of those of one report date the
    latest delivered, then the largest file_no. Files without report_date can't be put in order and don't count.
    fields is an array of (name, key, bits), sorted; of several spellings of a key in a file the first counts."""
    spelled = profiled.filter(F.col("report_date").isNotNull()).groupBy("feed_no", "file_no", "key").agg(
        F.max("report_date").alias("report_date"), F.max("delivered_at").alias("delivered_at"), F.min("name").alias("name"), F.bit_or("bits").alias("bits")
    )
    field = F.when(F.col("name").isNotNull(), F.struct("name", "key", "bits"))
    files = spelled.groupBy("feed_no", "file_no").agg(
        F.max("report_date").alias("report_date"), F.max("delivered_at").alias("delivered_at"), F.sort_array(F.collect_list(field)).alias("fields")
    )
    best = files.groupBy("feed_no", "report_date").agg(F.max(F.struct("delivered_at", "file_no", "fields")).alias("x"))
    w = Window.partitionBy("feed_no").orderBy("report_date")
    return best.select("feed_no", F.col("x.file_no").alias("file_no"), F.row_number().over(w).alias("seq"), F.col("x.fields").alias("fields"))


def plain_key(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def _grams(word: str) -> set[str]:
    word = f"  {word} "
    return {word[i : i + 3] for i in range(len(word) - 2)}


def _type_likeness(a: int, b: int) -> float:
    a, b = (TYPE_NAMES.get(x, "string") for x in (a, b))
    if a is None or b is None:
        return 0.5
    return 1.0 if a == b else 0.6 if {a, b} == {"integer", "decimal"} else 0.1


Fields = tuple[tuple[str, str, int], ...]  # name, key, type bits


def _candidates(left: Fields, right: Fields) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of fields that share a key or any three letters of their keys, with the likeness of their names: 1 for the
    same key, less for others."""
    shared: dict[tuple[int, int], int] = {}
    sizes = [[], []]
    of: dict[str, list[int]] = {}
    for i, f in enumerate(left):
        grams = _grams(f[1])
        sizes[0].append(len(grams))
        for g in grams:
            of.setdefault(g, []).append(i)
    for j, f in enumerate(right):
        grams = _grams(f[1])
        sizes[1].append(len(grams))
        for g in grams:
            for i in of.get(g, ()):
                shared[i, j] = shared.get((i, j), 0) + 1
    pairs = sorted(shared)
    like = [1.0 if left[i][1] == right[j][1] else 1.4 * shared[i, j] / (sizes[0][i] + sizes[1][j]) for i, j in pairs]
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1], np.array(like)


def flood(left: Fields, right: Fields, rounds: int = 100, still: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (i, j) of fields of two schemas with the likeness of their names and their scores; a name of a
    nested field holds its parent's, divided by U+001F.

    Pairs of nodes of the same kind form the propagation graph: roots, fields, names and types, with nesting as
    an edge between a field and its parent. Each pair passes its score on in equal parts to its neighbours
    along edges of one label; scores are divided by the largest after each round.
    """
    i, j, names = _candidates(left, right)
    n = len(i)
    if not n:
        return i, j, names, names
    lt, rt = sorted({f[2] for f in left}), sorted({f[2] for f in right})
    types = np.array([[_type_likeness(a, b) for b in rt] for a in lt])
    start = np.concatenate([[0.5], 0.5 * names, names, types.ravel()])
    kind_l, kind_r = np.array([lt.index(f[2]) for f in left]), np.array([rt.index(f[2]) for f in right])
    me = 1 + np.arange(n)
    at = dict(zip(zip(i.tolist(), j.tolist(), strict=True), me.tolist(), strict=True))
    place = ({f[0]: k for k, f in enumerate(left)}, {f[0]: k for k, f in enumerate(right)})
    parent = [[place[s].get(f[0].rpartition("\x1f")[0], -1) for f in fs] for s, fs in enumerate((left, right))]
    over = np.array([0 if parent[0][a] < 0 and parent[1][b] < 0 else at.get((parent[0][a], parent[1][b]), -1) for a, b in zip(i, j, strict=True)])
    nested = over >= 0
    edges = ((me, me + n), (me, 1 + 2 * n + kind_l[i] * len(rt) + kind_r[j]), (over[nested], me[nested]))
    source, target, weight = [], [], []
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            source.append(x), target.append(y), weight.append(1 / np.bincount(x, minlength=len(start))[x])
    s, t, w = (np.concatenate(x) for x in (source, target, weight))
    score = start.copy()
    for _ in range(rounds):
        base = start + score
        after = base + np.bincount(t, base[s] * w, minlength=len(start))
        after /= after.max()
        moved = np.abs(after - score).max()
        score = after
        if moved < still:
            break
    return i, j, names, score[1 : 1 + n]


def correspondences(left: Fields, right: Fields, least: float = 0.35, near: float = 0.9) -> list[tuple[int, int, float, bool]]:
    """Pairs (i, j, score, sure) of matching fields, one to one. Two fields with the same key are a sure pair. Of the
    others a pair is taken, by falling score, if its score is the best, or near times the best, for both of its fields
    and their names are alike to least; these are suggestions."""
    i, j, names, score = flood(left, right)
    same = np.array([left[a][1] == right[b][1] for a, b in zip(i, j, strict=True)], bool)
    out = [(int(a), int(b), float(s), True) for a, b, s in zip(i[same], j[same], score[same], strict=True)]
    rows, cols = {p[0] for p in out}, {p[1] for p in out}
    free = np.array([a not in rows and b not in cols for a, b in zip(i, j, strict=True)], bool) & (score > 0)
    i, j, names, score = i[free], j[free], names[free], score[free]
    best_i, best_j = np.zeros(len(left)), np.zeros(len(right))
    np.maximum.at(best_i, i, score), np.maximum.at(best_j, j, score)
    good = (score >= near * np.maximum(best_i[i], best_j[j])) & (names >= 0.7 * least)
    for k in sorted(np.flatnonzero(good), key=lambda k: (-score[k], i[k], j[k])):
        if i[k] not in rows and j[k] not in cols:
            rows.add(i[k]), cols.add(j[k])
            out.append((int(i[k]), int(j[k]), float(score[k]), False))
    return out


MATCHED = "feed_no int, file_no int, seq int, old string, new string, old_key string, new_key string, score double, sure boolean"


def match_files(schemas: DataFrame) -> DataFrame:
    """Correspondences between each counted file and the one before, where their fields or types differ: rows (feed_no,
    file_no, seq, old, new, old_key, new_key, score, sure); old or new is null for a field without a partner. A feed's
    first file has no rows; its fields take part as the old ones of the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lru_cache(4096)(lambda a, b: correspondences(a, b))
        for b in batches:
            out: list[tuple] = []
            for feed, file, seq, before, now in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x, y = (tuple((f["name"], f["key"], f["bits"]) for f in fs) for fs in (before, now))
                pairs = match(x, y)
                left, right = {p[0] for p in pairs}, {p[1] for p in pairs}
                out += [(feed, file, seq, x[i][0], y[j][0], x[i][1], y[j][1], s, sure) for i, j, s, sure in pairs]
                out += [(feed, file, seq, f[0], None, f[1], None, None, None) for i, f in enumerate(x) if i not in left]
                out += [(feed, file, seq, None, f[0], None, f[1], None, None) for j, f in enumerate(y) if j not in right]
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 9
            types = [pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in MATCHED.split(", ")])

    before = F.lag("fields").over(Window.partitionBy("feed_no").orderBy("seq"))
    pairs = schemas.select("feed_no", "file_no", "seq", before.alias("before"), "fields").filter(F.col("before").isNotNull() & (F.col("before") != F.col("fields")))
    return pairs.repartition(shuffle_width(schemas.sparkSession), F.xxhash64("before", "fields")).mapInArrow(run, MATCHED)


def field_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def type_name(bits: Column) -> Column:
    return F.when(bits == BOOLEAN, "boolean").when(bits == INTEGER, "integer").when(bits.isin(DECIMAL, DECIMAL | INTEGER), "decimal").when(bits != 0, "string")


def field_changes(feed: DataFrame, names: DataFrame) -> DataFrame:
    """Changes (feed_no, file_no, field_key, change_kind) of the top-level fields of each counted file.

    Correspondences come from similarity flooding; an exact check keeps those of equal keys, so that a
    suggested pair of different keys counts as one field removed and another added. Repeated rows, empty
    tables and files without a readable payload are allowed; the latter have no fields.
    """
    schemas = counted_schemas(keyed(profile(feed), names))
    matched = match_files(schemas).filter(~F.coalesce("old", "new").contains("\x1f"))
    kept = F.col("sure") & (F.col("old_key") == F.col("new_key"))
    change = lambda kind, key, when: F.when(when, F.struct(key.alias("field_key"), F.lit(kind).alias("change_kind")))
    sides = F.array(
        change("renamed", F.col("new_key"), kept & (F.col("old") != F.col("new"))),
        change("removed", F.col("old_key"), F.col("old").isNotNull() & ~F.coalesce(kept, F.lit(False))),
        change("added", F.col("new_key"), F.col("new").isNotNull() & ~F.coalesce(kept, F.lit(False))),
    )
    structure = matched.select("feed_no", "file_no", F.explode(sides).alias("c")).filter(F.col("c").isNotNull()).select("feed_no", "file_no", "c.*")
    rows = schemas.select("feed_no", "file_no", "seq", F.explode("fields").alias("f")).filter(~F.col("f.name").contains("\x1f"))
    typed = rows.select("feed_no", "file_no", "seq", F.col("f.key").alias("field_key"), type_name(F.col("f.bits")).alias("type"))
    earlier = F.last("type", ignorenulls=True).over(Window.partitionBy("feed_no", "field_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    retyped = typed.withColumn("earlier", earlier).filter("type <> earlier").select("feed_no", "file_no", "field_key", F.lit("retyped").alias("change_kind"))
    return structure.unionByName(retyped).distinct()


def suggestions(feed: DataFrame, names: DataFrame) -> DataFrame:
    """Correspondences of fields whose keys differ, found by similarity flooding: names that the dictionary may lack."""
    return _suggested(counted_schemas(keyed(profile(feed), names)))


def _suggested(schemas: DataFrame) -> DataFrame:
    matched = match_files(schemas).filter(~F.col("sure") & ~F.col("old").contains("\x1f") & ~F.col("new").contains("\x1f"))
    return matched.groupBy("old_key", "new_key").agg(F.count("*").alias("files"), F.max("score").alias("score"))


def columns_of_keys(schemas: DataFrame, rounds: int = 20) -> DataFrame:
    """Rows (key, column) of the keys that the suggestions join with another one: the column is the first key of all
    that hang together. Each round doubles the length of the chains that are resolved."""
    pairs = _suggested(schemas).select(F.col("old_key").alias("a"), F.col("new_key").alias("b"))
    links = durable(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("column"))
    if links.isEmpty():
        return label.select(F.col("a").alias("key"), "column")
    for _ in range(rounds):
        near = links.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("column").alias("near"))
        jump = label.select(F.col("a").alias("column"), F.col("column").alias("far"))
        step = label.join(near, "a").join(jump, "column", "left").select("a", F.least("column", "near", "far").alias("next"), "column")
        step = durable(step)
        label = step.select("a", F.col("next").alias("column"))
        if step.filter(F.col("next") != F.col("column")).isEmpty():
            break
    return label.select(F.col("a").alias("key"), "column")


_SPARK = {"boolean": "boolean", "integer": "bigint", "decimal": "decimal(38,6)"}
# What a type holds exactly, as text.
_HELD = {"boolean": r"^(true|false)\z", "bigint": r"^-?[0-9]+\z", "decimal(38,6)": r"^-?[0-9]+(\.[0-9]{1,6}0*)?\z"}


def consistent_table(feed: DataFrame, names: DataFrame, most: int = 500) -> DataFrame:
    """All readable records as one table: feed_no, file_no, row_id, a column f_<field key> for each of the most
    frequent field keys up to most, and more, a map of all else as text.

    Fields go into columns by their key, or by the key that similarity flooding joins theirs with. A column's type
    holds all values of the field over all files: integers with decimals are decimal, any other mixture is string, only
    nulls are string too. Nested values come as JSON text. Nothing is lost: a value that the column's type can't hold
    exactly is in more under the column's key, and of several names of one column in a record the last in the order of
    the names fills it while the others are in more under the names as written.
    """
    seen = keyed(profile(feed), names)
    joined = columns_of_keys(counted_schemas(seen))
    flat = seen.filter(F.col("name").isNotNull() & ~F.col("name").contains("\x1f")).join(joined, "key", "left")
    flat = flat.withColumn("column", F.coalesce("column", "key"))
    kinds = flat.groupBy("column").agg(type_name(F.bit_or("bits")).alias("t"), F.count("*").alias("n")).orderBy(F.desc("n"), "column").limit(most).collect()
    cols = {r["column"]: _SPARK.get(r["t"], "string") for r in sorted(kinds)}
    entry = F.when(F.col("name_key") != F.col("column"), F.struct("name_key", "column"))
    other = flat.groupBy("feed_no", "file_no").agg(F.map_from_entries(F.collect_set(entry)).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for feed_no, file_no, row_id, payload, known in zip(*[c.to_pylist() for c in b.columns], strict=True):
                record = _record(payload)
                if record is None:
                    continue
                known = dict(known or ())
                values: dict[str, str] = {}
                written: dict[str, str] = {}
                lost: list[tuple[str, str]] = []
                for name in sorted(record):
                    v, key = record[name], plain_key(_clean(name))
                    if v is not None:
                        text = str(v) if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)
                        key = known.get(key, key)
                        if key in values:
                            lost.append((written[key], values[key]))
                        values[key], written[key] = text.encode("utf-8", "replace").decode(), _clean(name)
                rest: dict[str, str] = {}
                for name, text in lost:
                    while name in rest or name in values:
                        name += "'"
                    rest[name] = text
                out.append((feed_no, file_no, row_id, list(values.items()), list(rest.items())))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.map_(pa.string(), pa.string())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["feed_no", "file_no", "row_id", "v", "rest"])

    read = feed.select("feed_no", "file_no", "row_id", "payload").join(other, ["feed_no", "file_no"], "left")
    rows = read.mapInArrow(run, "feed_no int, file_no int, row_id bigint, v map<string,string>, rest map<string,string>")
    held = lambda x, t: x.rlike(_HELD[t]) & x.try_cast(t).isNotNull()
    cells = [(F.col("v")[k] if t == "string" else F.when(held(F.col("v")[k], t), F.col("v")[k].try_cast(t))).alias(f"f_{k}") for k, t in cols.items()]
    fits = F.lit(False)
    for t in {*cols.values()}:
        of = [k for k, x in cols.items() if x == t]
        fits = (lambda k, x, fits=fits, of=of, t=t: (fits(k, x) if callable(fits) else fits) | (k.isin(of) & (held(x, t) if t != "string" else F.lit(True))))
    more = F.map_concat(F.map_filter("v", lambda k, x: ~(fits(k, x) if callable(fits) else fits)), "rest")
    return rows.select("feed_no", "file_no", "row_id", *cells, more.alias("more"))


def _record(payload: str | None) -> dict | None:
    try:
        value = json.loads(payload.strip(" \t\n\r"), parse_int=_Number, parse_float=_Number, parse_constant=_refuse) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


class _Number(str):
    """A JSON number's own text."""

    __slots__ = ()
