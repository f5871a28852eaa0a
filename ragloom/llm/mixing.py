"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies, the source's rate. With a running sum of the
rates and one random offset a source, a document is emitted once for every integer boundary that its stretch of
the sum crosses, so its copies differ from the rate by less than one. Documents are ordered by size, so that the
emitted copies have the sizes of the source.

Defined results: documents with null or unlisted source, and texts without tokens, are left out; a listed source
without rows gets share 0 and the others share its weight in proportion.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.llm.tokens import token_count
from ragloom.operators.durable import durable

#: Documents of one source and size class are ordered in at least so many slots, and in more above this many documents a slot.
BUCKETS, SLOT_ROWS = 64, 5_000_000


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("tokens")).where(
        F.col("source").isNotNull() & (F.col("tokens") > 0))


def rates(items: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, rate, goal, share, available): copies a document and target tokens of each source.

    The size of the mix is `total` tokens, at most what the scarcest source allows under its cap of repeats.
    """
    have = items.groupBy("source").agg(F.sum("tokens").alias("available"))
    wanted = F.broadcast(targets.select("source", "target_share", "max_repeats"))  # the fixed table of targets
    known = have.join(wanted, "source").where("target_share > 0 and max_repeats > 0")
    everything = Window.partitionBy(F.lit(1))  # one row a target source
    known = known.withColumn("share", F.col("target_share") / F.sum("target_share").over(everything))
    most = F.min(F.col("available") * F.col("max_repeats") / F.col("share")).over(everything)
    size = F.least(most, F.lit(float(total))) if total is not None else most
    return known.withColumn("goal", size * F.col("share")).select(
        "source", "share", "available", "goal", "max_repeats",
        F.least(F.col("goal") / F.col("available"), F.col("max_repeats").cast("double")).alias("rate"))


def mix(df: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str = "source",
        total: float | None = None, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(id, source, tokens, copies): the mix, one row a document that is used.

    Prefix sums are taken in two levels: within buckets of a source (size class, then hash), then over the few
    bucket totals, so no source is ever ordered in one task.
    """
    items = durable(sized(df, id_col, text_col, source_col))
    plan = durable(rates(items, targets, total))
    buckets = max(buckets, items.count() // SLOT_ROWS)
    place = items.join(F.broadcast(plan.select("source", "rate")), "source").withColumn(
        "class", F.floor(F.log2(F.col("tokens").cast("double")) * 4).cast("int")).withColumn(
        "slot", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    # Whole documents are counted, so that bucket totals are exact and the running sum is rate times a count.
    totals = place.groupBy("source", "class", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("source").orderBy("class", "slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("source", "class", "slot").orderBy("tokens", "id"))
    offset = random.Random(seed).random()
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0) + F.lit(offset)
    start = start - F.floor(start)
    rank = F.col("before") + F.col("nth")
    return place.withColumn("nth", nth).join(before, ["source", "class", "slot"]).select(
        "id", "source", "tokens",
        (F.floor(rank * F.col("rate") + start) - F.floor((rank - 1) * F.col("rate") + start)).cast("int").alias("copies")
    ).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target share, documents, tokens and the share of all tokens reached."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"),
        F.max("copies").alias("most_copies"))
    everything = Window.partitionBy(F.lit(1))
    out = F.broadcast(targets).join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    return out.withColumn("actual_share", F.round(F.try_divide(F.col("mixed_tokens").cast("double"), F.sum("mixed_tokens").over(everything)), 6))
