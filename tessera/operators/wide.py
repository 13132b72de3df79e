"""Attribute-value rows into wide tables.

Statements are reduced to one per uuid, read as cells of their record (all with built-in expressions), and
then combined by record with RDD combineByKey: each record has a register with one slot per attribute, in
which an associative merge keeps the cell that comes first by (ord, row_id). Merging starts on the map side,
so a record with very many statements leaves each map task as one register of at most as many slots as
there are attributes. Typed encoders turn registers into full rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from decimal import Decimal

import xxhash
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DECIMAL, WHOLE, iso_date, trim_white
from ..session import durable, shuffle_width

Slot = tuple[int, int | None, str]  # ord, row_id, value
Register = dict[str, Slot]

# Attributes that are not strings.
TYPES: dict[str, T.DataType] = {
    **dict.fromkeys(("ebl_id", "ezb_id", "copies", "ampelfarbe", "erstes_jahr"), T.LongType()),
    "purchase_price": T.DecimalType(18, 4),
    **dict.fromkeys(("owned", "visible"), T.BooleanType()),
    **dict.fromkeys(("renewal_date", "pubdate"), T.DateType()),
}
_ENCODERS = {"bigint": int, "decimal(18,4)": Decimal, "boolean": lambda s: s.lower() == "true", "date": dt.date.fromisoformat, "string": str}


def attribute(rows: DataFrame, predicate: Column) -> DataFrame:
    """rows with the column attr: what follows the last #, / or : of a predicate, decoded, in lower case and with one _
    for each run of other characters than a-z and 0-9; null where nothing is left. A per cent sign that begins no
    escape stands for itself.

    Each step is a column of its own that the next one reads once, as Catalyst would otherwise paste the pattern
    matching into every use."""
    rows = rows.withColumn("attr", F.translate(F.regexp_extract(predicate, r"(?s)([^#/:]*)\z", 1), "+", " "))
    decoded = F.url_decode(F.regexp_replace("attr", "%(?![0-9A-Fa-f]{2})", "%25"))
    rows = rows.withColumn("attr", F.when(F.col("attr").contains("%"), decoded).otherwise(F.col("attr")))
    rows = rows.withColumn("attr", F.btrim(F.regexp_replace(F.lower("attr"), "[^a-z0-9]+", "_"), F.lit("_")))
    return rows.withColumn("attr", F.nullif("attr", F.lit("")))


def readable(attr: Column, value: Column, types: dict[str, T.DataType]) -> Column:
    """Whether a trimmed value can be read as its attribute's type."""
    of = lambda kind: [n for n, t in types.items() if isinstance(t, kind)]
    return (
        (value != "")
        & F.when(attr.isin(of(T.LongType)), value.rlike(WHOLE))
        .when(attr.isin(of(T.DecimalType)), value.rlike(DECIMAL))
        .when(attr.isin(of(T.BooleanType)), F.lower(value).isin("true", "false"))
        .when(attr.isin(of(T.DateType)), iso_date(value).isNotNull())
        .otherwise(True)
    )


def latest_statements(statements: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of one row per uuid in any case of letters: the latest loaded_at, then the largest row_id; a row
    whose uuid is null or empty stays on its own, whatever its row_id. Of rows that agree in all three, one stays.

    Only rows with a uuid are ranked; the window keeps the best of a uuid on the map side, so that copies of one
    statement, however many, don't meet in one task."""
    marked = F.coalesce(F.col("uuid"), F.lit("")) != ""
    w = Window.partitionBy("statement").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc_nulls_last())
    ranked = statements.filter(marked).withColumn("statement", F.lower("uuid")).withColumn("rank", F.row_number().over(w)).filter("rank = 1")
    return ranked.select(keep).unionByName(statements.filter(~marked).select(keep))


def cells(statements: DataFrame, types: dict[str, T.DataType] = TYPES) -> DataFrame:
    """Readable cells (record_id, attr, ord, row_id, value) of gdm statements; a missing ord is 1, and a missing row_id
    comes after all others. Everything is read off a statement before the shuffle, and what is no cell is shuffled as
    nulls: it may be the latest of its uuid, and then the statement has no cell."""
    own = (F.col("subject_kind") == "RESOURCE") & (F.col("object_kind") == "LITERAL") & (F.col("subject_id") == F.col("record_id"))
    mine = lambda c: F.when(own, c)
    cut = attribute(
        statements.select(
            "uuid", "loaded_at", "row_id", mine(F.col("record_id")).alias("record_id"), mine(F.col("predicate")).alias("predicate"),
            mine(F.coalesce("ord", F.lit(1))).alias("ord"), trim_white(mine(F.col("object_value"))).alias("value"),
        ),
        F.col("predicate"),
    )
    kept = latest_statements(cut, ["record_id", "attr", "ord", "row_id", "value"])
    return kept.filter(F.col("record_id").isNotNull() & F.col("attr").isNotNull() & readable(F.col("attr"), F.col("value"), types))


def _create(cell: tuple[str, Slot]) -> Register:
    return {cell[0]: cell[1]}


def _add(register: Register, cell: tuple[str, Slot]) -> Register:
    attr, slot = cell
    held = register.get(attr)
    if held is None or _rank(slot) < _rank(held):
        register[attr] = slot
    return register


def _rank(slot: Slot) -> tuple:
    return slot[0], slot[1] is None, slot[1] or 0, slot[2]


def _merge(a: Register, b: Register) -> Register:
    for cell in b.items():
        _add(a, cell)
    return a


def _place(record_id: str) -> int:
    return xxhash.xxh32_intdigest(record_id)


def registers(cell_rows: DataFrame) -> RDD:
    """Pairs (record_id, register) of cells. Cells with null record_id, attr or value are to be left out before."""
    pairs = cell_rows.select("record_id", "attr", "ord", "row_id", "value").rdd.map(lambda r: (r[0], (r[1], (r[2], r[3], r[4]))))
    return pairs.combineByKey(_create, _add, _merge, shuffle_width(cell_rows.sparkSession), _place)


def filled_cells(statements: DataFrame, types: dict[str, T.DataType] = TYPES) -> DataFrame:
    """Rows (record_id, attr, row_id) of the cells that wide() fills, each with the row that fills it."""
    flat = registers(durable(cells(statements, types))).flatMap(lambda kv: [(kv[0], attr, slot[1]) for attr, slot in kv[1].items()])
    return statements.sparkSession.createDataFrame(flat, "record_id string, attr string, row_id bigint", verifySchema=False)


def wide(statements: DataFrame, types: dict[str, T.DataType] = TYPES, columns: Iterable[str] | None = None, most: int = 500) -> DataFrame:
    """One row per record with any filled cell: record_id, a typed column for each attribute and more, a map
    of all attributes without a column.

    columns names the attributes to have columns; by default these are the typed ones and the most frequent
    others up to most, so that the number of columns stays bounded while no cell is lost. Whole numbers
    beyond a bigint, which no column can hold, and decimals beyond decimal(18, 4) go into more as text. An
    attribute called record_id or more has no column of its own and goes into more.

    The cells are written to the checkpoint folder first: they are read twice where columns are to be chosen, and
    executors lost during the Python stages don't cost the ranking again.
    """
    rows = durable(cells(statements, types))
    if columns is None:
        counted = rows.groupBy("attr").count().orderBy(F.desc("count"), "attr").limit(most)
        columns = sorted({r[0] for r in counted.collect()} | set(types))
    names = [c for c in dict.fromkeys(columns) if c not in ("record_id", "more")]
    kinds = {c: types.get(c, T.StringType()) for c in names}
    encoders = {c: (_ENCODERS[t.simpleString()], t.simpleString()) for c, t in kinds.items()}

    def encode(pair: tuple[str, Register]) -> tuple:
        record, register = pair
        more = {a: s[2] for a, s in register.items() if a not in encoders}
        row = []
        for name, (read, kind) in encoders.items():
            slot = register.get(name)
            if slot is not None and kind in ("bigint", "decimal(18,4)") and len(slot[2]) > 40:
                more[name], slot = slot[2], None
            value = None if slot is None else read(slot[2])
            if value is not None and (
                (kind == "bigint" and not -(2**63) <= value < 2**63)
                or (kind.startswith("decimal") and (abs(value) >= 10**14 or value != value.quantize(Decimal("0.0001"))))
            ):
                more[name], value = slot[2], None
            row.append(value)
        return (record, *row, more or None)

    schema = T.StructType([T.StructField("record_id", T.StringType()), *[T.StructField(c, t) for c, t in kinds.items()], T.StructField("more", T.MapType(T.StringType(), T.StringType()))])
    return statements.sparkSession.createDataFrame(registers(rows).map(encode), schema, verifySchema=False)
