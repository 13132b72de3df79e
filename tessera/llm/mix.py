"""A mix of speeches in which every source holds its target share of the tokens, by a curriculum that varies over time.

At time t of the mix, 0 to 1, a source has the weight g + b (1 - 2 t): g is its target share, and b moves the mix
in a line from the shares that the sources have by nature to as far beyond the targets, or less where a weight
would fall below 0. The integral of the schedule over the whole mix is the target share. The speeches of a source
stand in a fixed shuffled order, repeated in the same order, so that repeats are as far apart as they can be; the
time at which the schedule has asked for as many tokens as lie before the middle of a speech is its position.

The mix is the largest in which no speech is needed more often than its source allows. A source that has a target
but no tokens can't be held; the others keep their proportions and the report says so. Speeches are whole, so a
source misses its share by half a speech at most.

Scale. Sums up to a speech come from sums over a fixed number of buckets of each source and a window within a
bucket; the driver gets one row for each source. Positions are sorted by range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import bpe

# The order of speeches within a source, and of its buckets' number the power of 2.
SEED, BUCKET_BITS = 7, 12

PLAN = "source string, target_share double, planned_share double, max_repeat int, available bigint, tokens_available bigint, demand double, bend double"


def speeches(docs: DataFrame) -> DataFrame:
    """One row (doc_id, source, n_tokens) for each speech of documents, whose deliveries share sitting_no and speech_no.

    Of several deliveries one with tokens goes before one without, then a reissue before what it corrects, then the
    latest counts. Without one of the numbers a row is a speech of its own. Texts aren't shuffled.
    """
    keep = ["doc_id", "source", "sitting_no", "speech_no", "reissue_of", "published_at"]
    counted = bpe.token_counts(docs, keep, "text")
    own = F.when(F.col("sitting_no").isNull() | F.col("speech_no").isNull(), F.col("doc_id"))
    rank = F.struct((F.col("n_tokens") > 0).alias("a"), F.col("reissue_of").isNotNull().alias("b"), F.col("published_at").alias("c"), F.col("doc_id").alias("d"))
    best = counted.groupBy("sitting_no", "speech_no", own.alias("own")).agg(F.max_by(F.struct("doc_id", "source", "n_tokens"), rank).alias("s"))
    return best.select("s.doc_id", "s.source", "s.n_tokens")


def plan(counted: DataFrame, targets: DataFrame) -> list[dict]:
    """A row of PLAN for each source of the speeches or the targets; demand and bend are null for those left out."""
    have = {r.source: r for r in counted.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).collect()}
    want = {r.source: r for r in targets.filter("source is not null").collect()}
    rows = [
        {
            "source": s, "target_share": w.target_share if (w := want.get(s)) else None, "planned_share": 0.0, "max_repeat": w.max_repeat if w else None,
            "available": have[s].n if s in have else 0, "tokens_available": have[s].tokens if s in have else 0, "demand": None, "bend": None,
        }
        for s in {**want, **have}
    ]
    used = [r for r in rows if (r["target_share"] or 0) > 0 and (r["max_repeat"] or 0) > 0 and r["tokens_available"] > 0]
    if not used:
        return rows
    shares, tokens = math.fsum(r["target_share"] for r in used), sum(r["tokens_available"] for r in used)
    for r in used:
        r["planned_share"] = r["target_share"] / shares
        r["bend"] = r["tokens_available"] / tokens - r["planned_share"]
    total = min(r["max_repeat"] * r["tokens_available"] / r["planned_share"] for r in used)
    part = min(1.0, *(r["planned_share"] / abs(r["bend"]) for r in used if r["bend"]), 1.0)
    for r in used:
        r["demand"], r["bend"] = r["planned_share"] * total, part * r["bend"]
    return rows


def picks(counted: DataFrame, planned: list[dict]) -> DataFrame:
    """The taken speeches (doc_id, source, n_tokens, middle, copies, and the plan's columns): middle is the tokens of
    the source before the middle of the speech in its first pass."""
    of = counted.sparkSession.createDataFrame([r for r in planned if r["demand"] is not None], PLAN)
    order = F.xxhash64("doc_id", F.lit(SEED))
    rows = counted.filter("source is not null and n_tokens > 0").withColumn("h", order).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(within)).join(sums, ["source", "bucket"]).join(F.broadcast(of), "source")
    placed = placed.withColumn("middle", F.col("base") + F.col("upto") - F.col("n_tokens") / 2)
    passes = F.ceil((F.col("demand") - F.col("middle")) / F.col("tokens_available"))
    placed = placed.withColumn("copies", F.least(passes, F.col("max_repeat")).cast("int")).filter("copies > 0")
    return placed.select("doc_id", "source", "n_tokens", "middle", "copies", "planned_share", "tokens_available", "demand", "bend")


def _speeches_and_plan(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[dict]]:
    counted = durable(speeches(docs))
    return counted, plan(counted, targets)


def mixed(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The mix (position, doc_id, source, copy, n_tokens) in order; copy counts the times a speech was taken, from 1."""
    taken = picks(*_speeches_and_plan(docs, targets)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    g, b = F.col("planned_share"), F.col("bend")
    # Inverse of g t + b (t - t^2), the schedule's integral, in a form that holds for b = 0 too.
    y = (F.col("middle") + (F.col("copy") - 1) * F.col("tokens_available")) * g / F.col("demand")
    position = 2 * y / (g + b + F.sqrt(F.greatest((g + b) * (g + b) - 4 * b * y, F.lit(0.0))))
    return taken.select(position.alias("position"), "doc_id", "source", "copy", "n_tokens").orderBy("position", "source", "doc_id", "copy")


def shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """For every source of the documents or the targets: the shares asked for, planned and reached, the speeches and
    tokens there are and were taken, and the most times that a speech was taken."""
    counted, planned = _speeches_and_plan(docs, targets)
    own = picks(counted, planned).groupBy("source").agg(
        F.sum("copies").alias("taken"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_taken")
    )
    rows = counted.sparkSession.createDataFrame(planned, PLAN).join(own, "source", "left").fillna(0, ["taken", "tokens", "most_taken"])
    total = rows.agg(F.sum("tokens").alias("total"))
    share = F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "planned_share", share.alias("share"), "max_repeat", "most_taken", "available", "taken", "tokens_available", "tokens"
    )
