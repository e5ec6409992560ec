"""Mix sources to target weights by capped water-filling and seeded repetition.

``water_fill`` shares the whole size by weight; a source is never asked for more than
``max_epochs`` times its size, and what it cannot give is shared again by weight.  The shares
follow from one sort of the sources by cap over weight: the sources before the water level are
full, the others get the level times their weight.

``repetitions`` then gives every document its number of copies: the whole part of the rate for
all of them and one more for a seeded part of the source whose sizes add up to the rest.  That
part is cut by a running total over ``BUCKETS`` hash ranges; only documents of the one range the
cut falls in are ordered, so no source is ever sorted as a whole.

Nulls: a null text or size counts 0 words; null is a source like any other, sorted last.  A
document of size 0 follows the whole part of the rate (and its draw, outside the range of the cut).  Repeated rows are separate documents with
the same draw.  An empty table gives an empty result.  Only columns starting with ``__mix_`` are
reserved; all others pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossrank.llm.common import word_count
from crossrank.staging import stage

BUCKETS = 4096  # hash ranges of a source: three hexadecimal digits


def cyclic_weights(totals: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1..cycle, repeating over the sources by code point, null last.

    The window sees one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return totals.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))


def water_fill(totals: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``, the words the mix should hold.

    The windows see one row per source.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (
        totals.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("position", F.row_number().over(order))
    )
    water = level.withColumn(
        "water", F.min(F.when(~F.col("full"), F.struct("position", "level"))).over(everything)["level"]
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    return water.select("source", "source_size", "weight", target.alias("target"))


def _drawn(docs: DataFrame, seed: str) -> DataFrame:
    """The document's place in its source: a digest and the hash range that starts it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.withColumn("__mix_digest", digest).withColumn(
        "__mix_bucket", F.conv(F.substring("__mix_digest", 1, 3), 16, 10).cast("int")
    )


def cuts(sized: DataFrame, weigh=cyclic_weights, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row per source: size, target, whole repetitions, and where its last part one ends."""
    buckets = stage(
        _drawn(sized, seed)
        .groupBy("source", F.col("__mix_bucket").alias("bucket"))
        .agg(F.sum("size").alias("bucket_size")),
        "mix_buckets",
    )
    totals = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = (
        water_fill(weigh(totals), max_epochs)
        .withColumn("whole", F.floor(rate))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "plan_source")
    )
    running = Window.partitionBy("source").orderBy("bucket")
    ends = buckets.withColumn("end", F.sum("bucket_size").over(running)).withColumn(
        "start", F.col("end") - F.col("bucket_size")
    )
    joined = plan.join(ends, F.col("source").eqNullSafe(F.col("plan_source")))
    hit = (F.col("start") <= F.col("need")) & (F.col("need") < F.col("end"))
    return joined.groupBy("plan_source", "source_size", "target", "whole").agg(
        F.max(F.when(hit, F.col("bucket"))).alias("cut_bucket"),
        F.max(F.when(hit, F.col("need") - F.col("start"))).alias("room"),
    )


def repetitions(sized: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows that have doc_id, source and size."""
    plan = plan.select(
        F.col("plan_source").alias("__mix_source"), "source_size", "target",
        F.col("whole").alias("__mix_whole"), F.col("cut_bucket").alias("__mix_cut"), F.col("room").alias("__mix_room"),
    )
    rows = _drawn(sized, seed).join(plan, F.col("source").eqNullSafe(F.col("__mix_source")))
    at_cut = F.coalesce(F.col("__mix_bucket") == F.col("__mix_cut"), F.lit(False))
    below = F.coalesce(F.col("__mix_bucket") < F.col("__mix_cut"), F.lit(False))
    clear = rows.where(~at_cut).withColumn("copies", F.col("__mix_whole") + below.cast("long"))
    order = Window.partitionBy("source").orderBy("__mix_digest", F.col("doc_id").asc_nulls_first(), "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = rows.where(at_cut).withColumn(
        "copies",
        F.col("__mix_whole") + ((F.col("size") > 0) & (2 * before + F.col("size") <= 2 * F.col("__mix_room"))).cast("long"),
    )
    both = clear.unionByName(edge)
    return both.drop(*[c for c in both.columns if c.startswith("__mix_")])


def mix_plan(docs: DataFrame, weigh=cyclic_weights, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix_sizes")
    plan = stage(cuts(sized, weigh, max_epochs, seed), "mix_cuts")
    return repetitions(sized, plan, seed).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weigh=cyclic_weights, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: every document as often as it was drawn, numbered by ``copy`` (in place of a column of that name)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    plan = stage(cuts(sized, weigh, max_epochs, seed), "mix_cuts")
    kept = [c for c in docs.columns if c != "copy"]
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*kept).alias("__row")
    )
    drawn = repetitions(rows, plan, seed).where("copies > 0")
    return drawn.select(
        F.col("__row"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")
    ).select("__row.*", F.col("__copy").alias("copy"))
