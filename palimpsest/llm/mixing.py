"""Mixing sources to target weights: temperature, then budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.checkpoints import Tables

BROADCAST_SOURCES = 20_000
SPACE = r"[\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def _measures(sources: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """(entropy, highest repetition) of the weights at each exponent: one small aggregate."""
    a = F.col("a")
    rows = sources.select("share", "tokens", F.explode(F.lit(exponents)).alias("a"))
    power = F.exp(a * F.log("share"))
    got = rows.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s"), F.max(power / F.col("tokens")).alias("most")).collect()
    by = {r["a"]: (math.log(r["z"]) - r["a"] * r["s"] / r["z"], budget * r["most"] / r["z"]) for r in got}
    return [by[x] for x in exponents]


def bisect_exponent(sources: DataFrame, budget: float, target_entropy: float | None, max_repetition: float | None, rounds: int = 8, steps: int = 4) -> float:
    """The exponent in 0..1 that comes nearest to the target; 1 keeps the shares, 0 makes them equal.

    Entropy and highest repetition both fall as the exponent grows, so either is met by bisection: the largest
    exponent whose entropy is still at least the target (a fraction of the log of the number of sources), or the
    smallest whose highest repetition is at most the limit. A round decides so many bisection steps at once.
    """
    low, high = 0.0, 1.0
    goal = None if target_entropy is None else target_entropy * math.log(max(1, sources.count()))
    for _ in range(rounds):
        grid = [low + (high - low) * i / (1 << steps) for i in range((1 << steps) + 1)]
        found = _measures(sources, grid, budget)
        good = [h >= goal - 1e-12 if goal is not None else r > max_repetition for h, r in found]
        k = max((i for i, ok in enumerate(good) if ok), default=-1)
        if k == len(grid) - 1:
            return high
        if k < 0:
            return low
        low, high = grid[k], grid[k + 1]
    return low if goal is not None else high


def mix_sources(docs: DataFrame, target_entropy: float | None = 0.95, max_repetition: float | None = None, budget: int | None = None, block_docs: int = 1024, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block, position: one row for each time a document is used.

    A source's weight is its share of the tokens to the power of the bisected exponent, normalised. Its quota is that
    part of the budget (default: all tokens). Documents are dealt by hash into blocks of about block_docs; in each epoch
    the source's blocks are permuted, and the documents in each block. Whole epochs are used while they fit in
    the quota; of the last one, blocks up to the quota, and of the block that it cuts, documents up to the quota. So a
    source never exceeds its quota and misses it by less than one document. position (0 to 1) interleaves the sources.

    Null source counts as the source ''. Null text has no tokens. A source without tokens has no weight and no rows.
    Ties of a permutation fall to doc_id, then n_tokens. Equal rows are counted, so that however many there are, none of a
    block's tasks grows with them; each is used as often as it would be by itself. An empty table gives no rows.
    Other columns are ignored.
    """
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("one of target_entropy and max_repetition is needed")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_count(F.col("text").cast("string")).alias("n_tokens"))
    with Tables(docs.sparkSession) as tables:
        rows = tables.write(rows.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("copies")))
        totals = rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")
        sums = tables.write(totals)
        total, n = sums.agg(F.sum("tokens"), F.count("*")).first()
        total = total or 0
        aim = int(total if budget is None else budget)
        sources = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
        exponent = bisect_exponent(sources, float(aim), target_entropy, max_repetition) if total else 1.0
        power = F.exp(F.lit(exponent) * F.log("share"))
        z = sources.agg(F.sum(power)).first()[0] or 1.0
        weight = power / F.lit(z)
        quota = F.floor(F.lit(aim) * weight).cast("long")
        plan = tables.write(sources.select("source", "tokens", weight.alias("weight"), quota.alias("quota"), F.floor(quota / F.col("tokens")).alias("full"), F.ceil(F.col("docs") / F.lit(block_docs)).cast("long").alias("blocks")))

        blocks = plan.select("source", "blocks")
        if n <= BROADCAST_SOURCES:  # else the join shuffles, and skewed sources are split at run time
            blocks = F.broadcast(blocks)
        dealt = rows.join(blocks, "source").select("doc_id", "source", "n_tokens", "copies", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "n_tokens"), "blocks").alias("block"))
        sizes = dealt.groupBy("source", "block").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("block_tokens"))
        order = F.xxhash64(F.lit(seed), "source", "block", "epoch")
        epochs = sizes.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))).withColumn("order_", order).withColumn("range_", F.shiftright("order_", 54))
        epochs = tables.write(epochs)

    # A source's blocks are in order of a hash: sums over 1,024 ranges of it are run up first, then the blocks within each range.
    ranges = epochs.groupBy("source", "epoch", "range_").agg(F.sum("block_tokens").alias("range_tokens"))
    ranges = ranges.select("source", "epoch", "range_", (F.sum("range_tokens").over(Window.partitionBy("source", "epoch").orderBy("range_")) - F.col("range_tokens")).alias("base"))
    in_range = Window.partitionBy("source", "epoch", "range_").orderBy("order_", "block")
    left = F.when(F.col("epoch") < F.col("full"), F.col("tokens")).otherwise(F.col("quota") - F.col("full") * F.col("tokens"))
    used = (
        epochs.join(ranges, ["source", "epoch", "range_"])
        .withColumn("before", F.col("base") + F.sum("block_tokens").over(in_range) - F.col("block_tokens"))
        .withColumn("left", left)
        .where("before < left OR (epoch < full AND before <= left)")
        .select("source", "block", "epoch", "before", "left", "tokens", "quota", "weight")
    )
    within = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64(F.lit(seed), "doc_id", "epoch"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(used, ["source", "block"]).withColumn("from_", F.col("before") + F.sum(F.col("n_tokens") * F.col("copies")).over(within) - F.col("n_tokens") * F.col("copies"))
    # Of equal rows so many are used as fit.
    fit = F.when(F.col("n_tokens") == 0, F.when(F.col("from_") <= F.col("left"), F.col("copies"))).otherwise(F.least("copies", F.floor((F.col("left") - F.col("from_")) / F.greatest("n_tokens", F.lit(1)))))
    out = out.withColumn("fit_", fit).where("fit_ > 0").withColumn("nth_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fit_") - 1)))
    start = F.col("epoch") * F.col("tokens") + F.col("from_") + F.col("nth_") * F.col("n_tokens")
    return out.select("doc_id", "source", "n_tokens", "weight", F.col("epoch").cast("int").alias("epoch"), F.col("block").cast("int").alias("block"), (start / F.greatest("quota", F.lit(1))).alias("position"))
