"""What changed between full snapshots, by subtracting invertible Bloom lookup tables.

Each snapshot's rows are reduced to elements (key, two 64-bit content hashes) and hashed by key into buckets.
In each bucket a snapshot has a small table whose cells hold the number of elements and the exclusive or of
keys, hashes and checks. Tables of consecutive snapshots are subtracted cell by cell: equal elements cancel
out and the differing ones are peeled from cells that hold just one. A bucket whose table was too small
for its differences is built again, four times as large, with other positions; digests over whole buckets
verify what was peeled.

Scale. Rows of one key are reduced with a map-side aggregate, so a key given any number of times is no hot
group; then elements are shuffled once, by bucket, and tables, subtraction and peeling all run in that
partitioning. Buckets are hashes of distinct keys and hold a given number of elements on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITE_CLASS, trim_white, whole_number
from ..functions.xx import xx_chain
from ..session import durable, shuffle_width

PEELED = "diff int, bucket long, key long, sign int"


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFC")


def elements(rows: DataFrame, snap: Column, key: Column, order: list[Column], content: list[Column]) -> DataFrame:
    """Elements (snap, key, v, w): of the rows of a key in a snapshot the one that is last in order, its
    content as two hashes. Rows with null snap or key give none; null and absent content are the same only
    if the caller maps them to the same string."""
    texts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in content]
    slim = rows.select(
        snap.cast("int").alias("snap"), key.alias("key"), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"),
        F.xxhash64(*texts).alias("v"), F.xxhash64(F.lit("w"), *reversed(texts)).alias("w"),
    ).filter(F.col("snap").isNotNull() & F.col("key").isNotNull())
    last = slim.groupBy("snap", "key").agg(F.max(F.struct("o", "v", "w")).alias("x"))
    return last.select("snap", "key", F.col("x.v").alias("v"), F.col("x.w").alias("w"))


def _tables(items: DataFrame, size: int, salt: int) -> DataFrame:
    """Cells (bucket, snap, cell, n, k, v, w, c) of the tables, size cells in three parts; cell -1 has the bucket's digest."""
    part = size // 3
    check = F.xxhash64("key", "v", "w", F.lit(salt).cast("long"))
    places = [F.lit(i * part).cast("long") + F.pmod(F.shiftright("c", 20 * i), F.lit(part)) for i in range(3)]
    spread = items.withColumn("c", check).withColumn("cell", F.explode(F.array(*places, F.lit(-1).cast("long"))))
    spread = spread.withColumn("c", F.when(F.col("cell") < 0, F.xxhash64("w", "v", "key")).otherwise(F.col("c")))
    return spread.groupBy("bucket", "snap", "cell").agg(F.count("*").alias("n"), *[F.bit_xor(x).alias(x) for x in "kvwc".replace("k", "")], F.bit_xor("key").alias("k"))


def _subtract(tables: DataFrame, first: int, last: int) -> DataFrame:
    """Cells (bucket, diff, cell, ...) of each snapshot's table less that of the one before."""
    sides = F.array(F.struct(F.col("snap").alias("diff"), F.lit(1).alias("sign")), F.struct((F.col("snap") + 1).alias("diff"), F.lit(-1).alias("sign")))
    both = tables.withColumn("side", F.explode(sides)).filter((F.col("side.diff") > first) & (F.col("side.diff") <= last))
    return (
        both.groupBy("bucket", F.col("side.diff").alias("diff"), "cell")
        .agg(F.sum(F.col("n") * F.col("side.sign")).alias("n"), *[F.bit_xor(x).alias(x) for x in "kvwc"])
        .filter("n <> 0 or k <> 0 or v <> 0 or w <> 0 or c <> 0")
    )


def peel(group: np.ndarray, cell: np.ndarray, n: np.ndarray, k: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, ...]:
    """Peels tables side by side. group numbers the tables from 0; the arrays are of their cells that are not
    zero. Returns group, key and sign of the recovered elements, and for each group whether it came out
    empty and agrees with its digest."""
    groups = int(group.max()) + 1 if len(group) else 0
    part = size // 3
    total, digest = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    own = cell < 0
    total[group[own]], digest[group[own]] = n[own], c[own]
    at = group[~own] * size + cell[~own]
    count, keys, vs, ws, checks = (np.zeros(groups * size, np.int64) for _ in range(5))
    for to, values in ((count, n), (keys, k), (vs, v), (ws, w), (checks, c)):
        to[at] = values[~own]
    found: list[tuple[np.ndarray, ...]] = []
    look = at
    for _ in range(4 * size + 64):
        look = look[np.abs(count[look]) == 1]
        look = look[xx_chain(keys[look], vs[look], ws[look], salt) == checks[look]]
        if not len(look):
            break
        g = look // size
        order = np.lexsort((checks[look], g))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(g[order]) != 0) | (np.diff(checks[look][order]) != 0)
        look = look[order[fresh]]
        g, sign, item = look // size, count[look].copy(), [x[look].copy() for x in (keys, vs, ws, checks)]
        found.append((g, sign, *item))
        touched = np.concatenate([g * size + i * part + (item[3] >> (20 * i)) % part for i in range(3)])
        np.subtract.at(count, touched, np.tile(sign, 3))
        for to, values in zip((keys, vs, ws, checks), item, strict=True):
            np.bitwise_xor.at(to, touched, np.tile(values, 3))
        look = np.unique(touched)
    left = (count != 0) | (keys != 0) | (vs != 0) | (ws != 0) | (checks != 0)
    done = ~left.reshape(groups, size).any(axis=1) if groups else np.zeros(0, bool)
    g, sign, key, fv, fw, _ = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 6
    np.subtract.at(total, g, sign)
    np.bitwise_xor.at(digest, g, xx_chain(fw, fv, key))
    return g, key, sign, done & (total == 0) & (digest == 0)


def _peeler(size: int, salt: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
            edge = np.ones(len(cols[0]), bool)
            edge[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)
            group = np.cumsum(edge) - 1
            buckets, diffs = cols[0][edge], cols[1][edge]
            g, key, sign, good = peel(group, *cols[2:], size=size, salt=salt)
            keep = good[g]
            bad = np.flatnonzero(~good)
            g, key, sign = np.concatenate([g[keep], bad]), np.concatenate([key[keep], np.zeros(len(bad), np.int64)]), np.concatenate([sign[keep], np.zeros(len(bad), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(diffs[g].astype(np.int32)), pa.array(buckets[g]), pa.array(key), pa.array(sign.astype(np.int32))], ["diff", "bucket", "key", "sign"])

        for b in batches:
            cols = [x.cast(pa.int64()).to_numpy(zero_copy_only=False) for x in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) if len(cols[0]) else np.zeros(0, bool)
            held = [x[same] for x in cols]
            if not same.all():
                yield solve([x[~same] for x in cols])
        if held is not None and len(held[0]):
            yield solve(held)

    return run


def differences(items: DataFrame, bucket_items: int = 1024, cells: int = 240, rounds: int = 12) -> DataFrame:
    """Rows (diff, key, kind) of the keys that are added, removed or changed in snapshot diff against diff - 1.

    items are elements(); a snapshot number without rows between the first and the last is an empty
    snapshot. cells, a multiple of 3, is the size of a table in the first round; each round takes only the
    buckets that failed and four times the size. Raises an error, rather than leave anything out, when
    buckets still fail after the last round, in which a table has 4 ** 11 times the first size. No items or one
    snapshot give no rows.
    """
    spark = items.sparkSession
    items = durable(items)
    stats = items.groupBy("snap").count().agg(F.min("snap"), F.max("snap"), F.max("count")).first()
    first, last, most = stats[0] or 0, stats[1] or 0, stats[2] or 0
    buckets = max(1, -(-most // bucket_items))
    items = items.withColumn("bucket", F.pmod(F.xxhash64(F.lit("b"), "key"), F.lit(buckets).cast("long")))
    todo, parts = None, []
    for turn in range(rounds):
        size = cells * 4**turn
        work = items if todo is None else items.join(todo, "bucket", "left_semi")
        placed = work.repartition(min(shuffle_width(spark), buckets) if turn else shuffle_width(spark), "bucket")
        diffs = _subtract(_tables(placed, size, turn), first, last)
        if todo is not None:
            diffs = diffs.join(failed, ["bucket", "diff"], "left_semi")  # noqa: F821
            diffs = diffs.repartition(shuffle_width(spark), "bucket")
        cols = ["bucket", "diff", "cell", "n", "k", "v", "w", "c"]
        out = durable(diffs.select(cols).sortWithinPartitions("bucket", "diff").mapInArrow(_peeler(size, turn), PEELED))
        parts.append(out.filter("sign <> 0"))
        failed = out.filter("sign = 0").select("bucket", "diff")
        if failed.isEmpty():
            break
        todo = failed.select("bucket").distinct()
    else:
        raise RuntimeError(f"buckets that could not be peeled after {rounds} rounds")
    peeled = parts[0]
    for p in parts[1:]:
        peeled = peeled.unionByName(p)
    sides = peeled.groupBy("diff", "key").agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
    kind = F.when(F.col("lo") > 0, "added").when(F.col("hi") < 0, "removed").otherwise("changed")
    return sides.select("diff", "key", kind.alias("kind"))


def title_elements(snapshots: DataFrame) -> DataFrame:
    """Elements of title snapshots: the content is the title, canonically composed with single blanks, and the
    number of copies; null and empty titles are the same, unreadable copies are null."""
    title = F.coalesce(nfc(F.regexp_replace(trim_white(F.col("title")), f"{WHITE_CLASS}+", " ")), F.lit(""))
    return elements(snapshots, F.col("snap_no"), whole_number(F.col("ebl_id")), [F.col("loaded_at"), F.col("row_id")], [title, whole_number(F.col("copies"))])
