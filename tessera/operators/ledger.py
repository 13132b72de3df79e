"""History of changing attributes: a bitemporal ledger with valid and recorded times.

Every update becomes one set point per attribute (a withdrawal sets all of them to nothing). Set points
act on a timeline of their entity and attribute; a late one splits the interval it falls into, and the
ledger row it touches is not overwritten but superseded: its recorded period ends where the period of the
rows that replace it begins.

Scale. Timelines are cut into ranges of valid dates that are swept apart, so that an entity with many updates
is not one task's work. A range needs nothing of later ones but the times at which their first date moves
nearer, of which there are no more than dates. Where only what is held now matters, recorded times can have a
resolution: of the set points of one timeline with the same valid date and recorded unit the last alone is
kept, by a map-side aggregate before the shuffle. A sweep holds the dates of one range and writes at most three
rows per set point.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flexible_date, trim_white, whole_number

ALIVE = "alive"
OPEN_DATE = "9999-12-31"
OPEN_TIME = "9999-12-31 00:00:00"
# Fixed value: the dates of a timeline that are swept together.
RANGE_DAYS = 64
LEDGER = "entity {0}, attr string, value string, valid_from date, valid_to date, recorded_from timestamp_ntz, recorded_to timestamp_ntz"


def set_points(
    updates: DataFrame, entity: Column, op: Column, valid: Column, recorded: Column, seq: Column, attrs: dict[str, tuple[Column, Column]]
) -> DataFrame:
    """Set points (entity, attr, valid, recorded, seq, value) of updates.

    attrs gives for each attribute whether an update carries it and the value, null for empty. Rows with
    null entity or valid date, or an op other than U and D, give none. Clashing names cannot arise, as
    everything is selected by expression.
    """
    point = lambda name, value: F.struct(F.lit(name).alias("attr"), value.cast("string").alias("value"))
    nothing = F.lit(None).cast("string")
    upsert = F.array(point(ALIVE, F.lit("1")), *[F.when(carried, point(n, value)) for n, (carried, value) in attrs.items()])
    ending = F.array(*[point(n, nothing) for n in (ALIVE, *attrs)])
    flat = updates.select(
        entity.alias("entity"), op.alias("op"), valid.alias("valid"), recorded.cast("timestamp_ntz").alias("recorded"), seq.alias("seq"),
        F.when(op == "U", upsert).when(op == "D", ending).alias("points"),
    )
    flat = flat.filter(F.col("entity").isNotNull() & F.col("valid").isNotNull() & F.col("points").isNotNull())
    flat = flat.withColumn("point", F.explode("points")).filter(F.col("point").isNotNull())
    return flat.select("entity", F.col("point.attr").alias("attr"), "valid", "recorded", "seq", F.col("point.value").alias("value"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ledger rows of ranges of timelines that come one after the other, each in recorded order. A row that closes
    has no value; its date is where a later range begins from then on."""
    names = ["entity", "attr", "value", "valid_from", "valid_to", "recorded_from", "recorded_to"]
    far_day, far_time = 2932896, 253402214400000000  # the two open ends, as days and microseconds
    timeline: tuple | None = None
    part, last = None, far_day
    days: list[int] = []
    values: list[str | None] = []
    since: list[int] = []
    out: list[tuple] = []
    kind = pa.int64()

    def batch() -> pa.RecordBatch:
        e, a, v, f, t, r, s = zip(*out, strict=True) if out else ((),) * 7
        out.clear()
        day = lambda x: pa.array(x, pa.int32()).cast(pa.date32())
        time = lambda x: pa.array(x, pa.int64()).cast(pa.timestamp("us"))
        return pa.RecordBatch.from_arrays([pa.array(e, kind), pa.array(a, pa.string()), pa.array(v, pa.string()), day(f), day(t), time(r), time(s)], names)

    def finish() -> None:
        ends = [*days[1:], last]
        out.extend((*timeline, v, a, b, r, far_time) for v, a, b, r in zip(values, days, ends, since, strict=True))
        days.clear(), values.clear(), since.clear()

    for b in batches:
        kind = b.schema.field(0).type
        ints = lambda k, t, w, b=b: b.column(k).cast(t).cast(w).to_pylist()
        for entity, attr, day, time, value, own, closes in zip(
            b.column(0).to_pylist(), b.column(1).to_pylist(), ints(2, pa.date32(), pa.int32()), ints(3, pa.timestamp("us"), pa.int64()), *(b.column(k).to_pylist() for k in (4, 5, 6)), strict=True
        ):
            if (entity, attr) != timeline or own != part:
                if timeline:
                    finish()
                timeline, part, last = (entity, attr), own, far_day
            if closes:
                if day < last:
                    if days:
                        if since[-1] < time:
                            out.append((*timeline, values[-1], days[-1], last, since[-1], time))
                        since[-1] = time
                    last = day
                continue
            i = bisect_left(days, day)
            if i < len(days) and days[i] == day:
                if values[i] != value:
                    if since[i] < time:
                        out.append((*timeline, values[i], day, days[i + 1] if i + 1 < len(days) else last, since[i], time))
                    values[i], since[i] = value, time
                continue
            if i:
                if since[i - 1] < time:
                    out.append((*timeline, values[i - 1], days[i - 1], days[i] if i < len(days) else last, since[i - 1], time))
                since[i - 1] = time
            days.insert(i, day), values.insert(i, value), since.insert(i, time)
        yield batch()
    if timeline:
        finish()
        yield batch()


def _closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range of a timeline, of which the dates come from the last to the first with the time at which each
    was set first: the times at which the first date set in later ranges moves nearer, with that date."""
    timeline: tuple | None = None
    part: int | None = None
    nearest: list[tuple[int, int]] = []  # time and date, times rising and dates falling
    own: list[tuple[int, int]] = []
    for b in batches:
        out: list[tuple] = []
        for entity, attr, at, day, time in zip(
            *(b.column(k).to_pylist() for k in range(3)), b.column(3).cast(pa.date32()).cast(pa.int32()).to_pylist(), b.column(4).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist(), strict=True
        ):
            if (entity, attr) != timeline:
                timeline, part = (entity, attr), None
                nearest.clear(), own.clear()
            if at != part:
                for t, d in own:
                    while nearest and nearest[-1][0] >= t:
                        nearest.pop()
                    nearest.append((t, d))
                own.clear()
                out.extend((entity, attr, at, d, t) for t, d in nearest)
                part = at
            own.append((time, day))
        e, a, p, d, t = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(e, b.schema.field(0).type), pa.array(a, pa.string()), pa.array(p, pa.int32()), pa.array(d, pa.int32()).cast(pa.date32()), pa.array(t, pa.int64()).cast(pa.timestamp("us"))],
            ["entity", "attr", "part", "valid", "at"],
        )


def ledger(points: DataFrame, unit: str | None = "day") -> DataFrame:
    """Ledger rows (entity, attr, value, valid_from, valid_to, recorded_from, recorded_to), periods half open,
    9999-12-31 for open ends, of set points (entity, attr, valid, recorded, seq, value).

    The rows with an open recorded_to are what is held now; those with recorded_from <= t < recorded_to are
    what was held at t. unit is the resolution of recorded times, a unit of date_trunc; None keeps them whole,
    and only that gives every superseded row. A missing recorded time counts as 0001-01-01. Repeated points
    change nothing; of points equal in time the one with the larger seq, then the larger value counts. No points
    give no rows.
    """
    at = F.coalesce("recorded", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00")))
    seen = at if unit is None else F.date_trunc(unit, at).cast("timestamp_ntz")
    last = points.withColumn("unit", seen).groupBy("entity", "attr", "valid", "unit").agg(F.max(F.struct(at.alias("at"), "seq", "value")).alias("last"))
    rows = last.select("entity", "attr", "valid", "unit", F.col("last.value").alias("value"))
    if unit is None:
        part = F.floor(F.unix_date("valid") / RANGE_DAYS).cast("int").alias("part")
        rows = rows.select("*", part, F.lit(False).alias("closes"))
        first = points.groupBy("entity", "attr", "valid").agg(F.min(at).alias("at")).select("entity", "attr", part, "valid", "at")
        entity = dict(points.dtypes)["entity"]
        back = first.repartition("entity", "attr").sortWithinPartitions("entity", "attr", F.desc("valid"))
        closing = back.mapInArrow(_closing, f"entity {entity}, attr string, part int, valid date, at timestamp_ntz")
        rows = rows.unionByName(closing.select("entity", "attr", "valid", F.col("at").alias("unit"), F.lit(None).cast("string").alias("value"), "part", F.lit(True).alias("closes")))
    else:
        rows = rows.select("*", F.lit(0).alias("part"), F.lit(False).alias("closes"))
    swept = rows.repartition("entity", "attr", "part").sortWithinPartitions("entity", "attr", "part", "unit", "valid")
    return swept.mapInArrow(_sweep, LEDGER.format(dict(points.dtypes)["entity"]))


def versions(rows: DataFrame, attrs: list[str], as_of: str | None = None) -> DataFrame:
    """Versions (entity, attrs..., valid_from, valid_to) held now, or at the recorded time as_of.

    The timelines of an entity are merged at their boundaries, equal states in a row are one version, and
    spans in which the entity does not live have none. An entity has one row per day at most, which bounds
    the window's group.
    """
    held = rows.filter(
        F.col("recorded_to") == F.to_timestamp_ntz(F.lit(OPEN_TIME))
        if as_of is None
        else (F.col("recorded_from") <= F.to_timestamp_ntz(F.lit(as_of))) & (F.to_timestamp_ntz(F.lit(as_of)) < F.col("recorded_to"))
    )
    set_here = [F.max(F.when(F.col("attr") == n, F.struct(F.col("value").alias("v")))).alias(f"s{k}") for k, n in enumerate((ALIVE, *attrs))]
    edges = held.groupBy("entity", "valid_from").agg(*set_here)
    w = Window.partitionBy("entity").orderBy("valid_from")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    state = edges.select("entity", "valid_from", *[F.last(f"s{k}", ignorenulls=True).over(upto).getField("v").alias(f"v{k}") for k in range(len(attrs) + 1)])
    whole = F.struct(F.col("v0").isNotNull().alias("v0"), *[F.when(F.col("v0").isNotNull(), F.col(f"v{k + 1}")).alias(f"v{k + 1}") for k in range(len(attrs))])
    state = state.select("entity", "valid_from", whole.alias("state"))
    begins = state.withColumn("before", F.lag("state").over(w)).filter(~F.col("state").eqNullSafe(F.col("before")))
    begins = begins.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(w), F.lit(OPEN_DATE).cast("date")))
    return begins.filter("state.v0").select("entity", *[F.col(f"state.v{k + 1}").alias(n) for k, n in enumerate(attrs)], "valid_from", "valid_to")


def title_points(updates: DataFrame) -> DataFrame:
    """Set points of title updates: owned as true or false, renewal_date as a date, either of them empty."""
    owned, renewal = F.lower(trim_white(F.col("owned"))), trim_white(F.col("renewal_date"))
    flag = F.when(owned.isin("true", "1"), "true").when(owned.isin("false", "0"), "false")
    day = flexible_date(renewal)
    return set_points(
        updates, whole_number(F.col("ebl_id")), F.col("op"), F.col("effective_date"), F.col("received_at"), F.col("update_id"),
        {
            "owned": (flag.isNotNull() | (owned == ""), flag),
            "renewal_date": (day.isNotNull() | (renewal == ""), day),
        },
    )
