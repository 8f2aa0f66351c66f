"""Mixing sources to target weights.

Source token shares are raised to an exponent between 0 and 1 and normalised. The
exponent is bisected until the mixture's entropy meets its target, then raised until no
source is repeated more often than allowed. Each source's part of the token budget is
realised as epochs over its blocks, each epoch in a permutation of its own; the last
epoch ends where the budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import discard, stored

#: Blocks of a source; a block of the largest source is what one task orders at most.
BLOCKS = 8192
MAX_SOURCES = 100_000
ENTROPY = 0.95
MAX_EPOCHS = 2.0
SEED = 17


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares of ``tokens`` to the power of ``exponent``, normalised; sources without a token get 0."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    mass = sum(raw.values())
    return {s: x / mass if mass else 0.0 for s, x in raw.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in shares.values() if x > 0)


def solve(tokens: dict[str, int], budget: float, target: float, max_epochs: float) -> float:
    """The greatest exponent in 0..1 whose entropy is at least ``target`` times that of equal
    shares, raised as far as is needed for no source to be repeated over ``max_epochs`` times."""
    live = {s: n for s, n in tokens.items() if n}
    if len(live) < 2:
        return 1.0

    def bisect(holds) -> float:
        """The greatest exponent for which ``holds``, which is true at 0 and falls once."""
        low, high = 0.0, 1.0
        if holds(high):
            return high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    flat = bisect(lambda a: entropy(weights(live, a)) >= target * math.log(len(live)))

    def repeats(a: float) -> float:
        shares = weights(live, a)
        return max(shares[s] * budget / n for s, n in live.items())

    if repeats(flat) <= max_epochs:
        return flat
    low, high = flat, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if repeats(mid) <= max_epochs else (mid, high)
    return high


def _count(text: Column) -> Column:
    """Words between white space; a null or blank text has none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def mix(docs: DataFrame, budget: int | None = None, target: float = ENTROPY, max_epochs: float = MAX_EPOCHS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, any others), each row once for every epoch it is in.

    Added columns: mix_epoch (from 0), mix_block and mix_order; a source's epoch is read by
    mix_block, then mix_order. Columns of these names are replaced. ``budget`` counts words;
    by default as many as the table has. A null source is a source of its own, named "".
    Sources without a word get no share. Repeated rows share one place in the order and go
    in or stay out together. The result does not depend on partitions.

    The driver receives one row for each source, ``MAX_SOURCES`` at most.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks))
    keyed = docs.drop("mix_epoch", "mix_block", "mix_order").withColumns({"_mix_source": source, "_mix_b": block})
    per_block = stored(keyed.groupBy("_mix_source", "_mix_b").agg(F.sum(_count(F.col("text"))).alias("tokens")), "blocks")
    rows = per_block.groupBy("_mix_source").agg(F.sum("tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    tokens = {r["_mix_source"]: r["tokens"] for r in rows}
    total = sum(tokens.values())
    budget = total if budget is None else budget
    if budget > max_epochs * total:
        raise ValueError(f"a budget of {budget} words needs more than {max_epochs} epochs of {total}")
    shares = weights(tokens, solve(tokens, budget, target, max_epochs)) if total else dict.fromkeys(tokens, 0.0)
    plan = []
    for s, n in sorted(tokens.items()):
        own = round(shares[s] * budget)
        plan.append((s, own // n if n else 0, own % n if n else 0))
    plan = spark.createDataFrame(plan, "_mix_source string, _mix_full long, _mix_rest long")
    block_key = lambda epoch: F.xxhash64(F.lit(seed), epoch, F.col("_mix_source"), F.col("_mix_b"))
    doc_key = lambda epoch: F.xxhash64(F.lit(seed + 1), epoch, F.col("doc_id"))
    # The block in which each source's last epoch ends, and the words left for that block.
    along = Window.partitionBy("_mix_source").orderBy("key", "_mix_b").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        per_block.join(F.broadcast(plan), "_mix_source").withColumn("key", block_key(F.col("_mix_full")))
        .withColumn("upto", F.sum("tokens").over(along)).where(F.col("upto") > F.col("_mix_rest"))
        .groupBy("_mix_source").agg(F.min(F.struct("upto", "key", "_mix_b", "tokens")).alias("e"))
        .select("_mix_source", F.col("e.key").alias("_mix_end_key"), F.col("e._mix_b").alias("_mix_end_block"), F.col("e.tokens").alias("_mix_end_tokens"), F.col("e.upto").alias("_mix_end_upto"))
    )
    ends = plan.join(ends, "_mix_source", "left").withColumn("_mix_room", F.col("_mix_rest") - (F.col("_mix_end_upto") - F.col("_mix_end_tokens")))
    ends = spark.createDataFrame(ends.collect(), ends.schema)  # a row for each source
    discard(per_block)
    # Within that block, the last place in the order that still fits; equal places stand together.
    inside = Window.partitionBy("_mix_source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        keyed.select("_mix_source", "_mix_b", "doc_id", "text")
        .join(F.broadcast(ends.select("_mix_source", F.col("_mix_end_block").alias("_mix_b"), "_mix_full", "_mix_room")), ["_mix_source", "_mix_b"])
        .select("_mix_source", "_mix_room", doc_key(F.col("_mix_full")).alias("place"), _count(F.col("text")).alias("n"))
        .withColumn("upto", F.sum("n").over(inside)).where(F.col("upto") <= F.col("_mix_room"))
        .groupBy("_mix_source").agg(F.max("place").alias("_mix_end_place"))
    )
    ends = ends.join(last, "_mix_source", "left").select("_mix_source", "_mix_full", "_mix_rest", "_mix_end_key", "_mix_end_block", "_mix_end_place")
    ends = spark.createDataFrame(ends.collect(), ends.schema)
    out = keyed.join(F.broadcast(ends), "_mix_source")
    key, end_key = block_key(F.col("_mix_full")), F.col("_mix_end_key")
    before = (key < end_key) | ((key == end_key) & (F.col("_mix_b") < F.col("_mix_end_block")))
    within = (F.col("_mix_b") == F.col("_mix_end_block")) & (doc_key(F.col("_mix_full")) <= F.col("_mix_end_place"))
    partial = F.when(F.col("_mix_rest") <= 0, False).when(end_key.isNull(), True).otherwise(before | F.coalesce(within, F.lit(False)))
    epochs = F.col("_mix_full") + partial.cast("long")
    out = out.withColumn("_mix_n", epochs).where(F.col("_mix_n") > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_n") - 1)))
    out = out.withColumns({"mix_block": block_key(F.col("mix_epoch")), "mix_order": doc_key(F.col("mix_epoch"))})
    return out.drop("_mix_source", "_mix_b", "_mix_full", "_mix_rest", "_mix_end_key", "_mix_end_block", "_mix_end_place", "_mix_n")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: which row is read in which epoch, and where."""
    from webloom.llm.common import table

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_order")
