"""Mixing of sources to target weights by capped water-filling.

A mix has as many words as its input. Sources, in code-point order with null last, get weights by rotation. A
source may be repeated ``max_epochs`` times at most: targets above that are clamped, and what they leave is shared
among the others in proportion to their weights, again and again until no target is too high. Documents are then
repeated: all of a source ``whole`` times, and once more those in the first buckets of a seeded hash, up to the
bucket at which the source's words come nearest to its target.

Cases: a null or empty text has size 0 and is taken 0 words (as a row it follows its bucket). A null source is a
source. A null doc_id has a bucket of its own; rows with equal ids share a bucket, so they are taken alike. An empty
table gives an empty mix. Other columns are not looked at.

Scale: one pass over the texts gives (source, bucket, words), with at most 65,536 rows a source after map-side sums.
No step collects more than one number for each shuffle partition. A hot source is only ever summed, and windows see
256 rows of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Staged, tidy, word_count

BUCKETS = 65_536
SEED = "mix-1"
_SLOT = 33  # monotonically_increasing_id: partition above, position in it below


def bucket(doc_id: Column, seed: str = SEED) -> Column:
    """0 to 65535 from the leading hex digits of a seeded MD5."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0, by code point of ``source`` with null last, without a single task that sorts all."""
    key = F.col("source").asc_nulls_last()
    placed = Staged(sources.repartitionByRange(key).sortWithinPartitions(key).withColumn("slot", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("slot", _SLOT)
    counts = {r["part"]: r["n"] for r in placed.df.groupBy(part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.array(*map(F.lit, starts or [0])), part.cast("int") + 1)
    return placed.df.withColumn("rank", start + F.col("slot").bitwiseAND((1 << _SLOT) - 1)).drop("slot")


def water_fill(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target); sizes are whole numbers, so sums don't depend on order."""
    weighted = _ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1).cast("long"))
    cap = F.col("source_size") * max_epochs
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    clamped, rest, seen = 0, None, None
    at_cap = F.lit(False)
    while True:
        sums = weighted.agg(F.sum(F.when(at_cap, cap)).alias("c"), F.sum(F.when(~at_cap, F.col("weight"))).alias("w")).first()
        clamped, rest = sums["c"] or 0, sums["w"] or 0
        if (clamped, rest) == seen or not rest:
            break
        seen = (clamped, rest)
        share = F.lit(float(total - clamped)) * F.col("weight") / F.lit(float(rest))
        at_cap = cap <= share
    share = F.lit(float(total - clamped)) * F.col("weight") / F.lit(float(rest or 1))
    return weighted.select("source", "source_size", F.when(at_cap, cap.cast("double")).otherwise(share).alias("target"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: str = SEED, sized: DataFrame | None = None) -> DataFrame:
    """A row for each source: source, source_size, target, whole, cut. A document is taken ``whole`` times, and once
    more if its bucket is below ``cut``. sized: (source, bucket, size), if the caller has it."""
    return _plan(docs, weights, max_epochs, seed, sized).df


@tidy
def _plan(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: str, sized: DataFrame | None) -> Staged:
    if sized is None:
        sized = docs.select("source", bucket(F.col("doc_id"), seed).alias("bucket"), word_count(F.col("text")).alias("size"))
    hist = Staged(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix").df
    filled = Staged(water_fill(hist.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "filled").df
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    filled = filled.withColumn("whole", F.floor(ratio).cast("long")).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    known = filled.select(F.col("source").alias("s"), "want")

    def below(rows: DataFrame, order: str) -> DataFrame:
        """Adds before: the words in earlier rows of the same source."""
        w = W.partitionBy("source").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))

    coarse = hist.groupBy("source", F.shiftright("bucket", 8).alias("c")).agg(F.sum("size").alias("size"))
    coarse = below(coarse, "c").join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cut = coarse.where("before <= want and want < before + size").select(F.col("source").alias("s"), F.col("c").alias("cc"), F.col("before").alias("base"), "want")
    fine = hist.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", 8) == F.col("cc")))
    fine = below(fine, "bucket").where("base + before + size / 2 <= want")
    cuts = cut.select("s", (F.col("cc") * 256).alias("cut")).unionByName(fine.select("s", (F.col("bucket") + 1).alias("cut"))).groupBy("s").agg(F.max("cut").alias("cut"))
    out = filled.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    # As a written table it needs an exchange of its own in a join, so that a hot source's rows can be split there.
    return Staged(out.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")), "plan")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``."""
    sized = Staged(docs.select("doc_id", "source", bucket(F.col("doc_id"), seed).alias("bucket"), word_count(F.col("text")).alias("size")), "sized").df
    plan = plan_mix(docs, weights, max_epochs, seed, sized).withColumnRenamed("source", "s")
    times = F.col("whole") + (F.col("bucket") < F.col("cut")).cast("long")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with their own columns only."""
    plan = plan_mix(docs, weights, max_epochs, seed).select(F.col("source").alias("__mix_source"), F.col("whole").alias("__mix_whole"), F.col("cut").alias("__mix_cut"))
    times = F.least(F.col("__mix_whole") + (bucket(docs["doc_id"], seed) < F.col("__mix_cut")).cast("long"), F.lit(max_epochs))
    joined = docs.join(plan, docs["source"].eqNullSafe(F.col("__mix_source"))).withColumn("__mix_times", times).where("__mix_times > 0")
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
