"""Reproducible workloads: every operation follows from its index and the seed alone, so any partitioning gives the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.codec import format_key


@dataclass(frozen=True)
class Workload:
    operations: int
    keys: int
    reads: int = 80
    writes: int = 15
    deletes: int = 5
    distribution: str = "uniform"
    theta: float = 0.99
    min_value: int = 4
    max_value: int = 12
    seed: int = 42

    def __post_init__(self) -> None:
        if self.operations <= 0 or self.keys <= 0 or self.reads + self.writes + self.deletes != 100 or min(self.reads, self.writes, self.deletes) < 0:
            raise ValueError("operations, keys and percentages must add up")
        if self.min_value > self.max_value or self.theta < 0 or self.distribution not in ("uniform", "sequential", "zipfian"):
            raise ValueError("sizes, theta or distribution")


def uniform(seed: int, salt: str, index: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), index.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def zipf_cdf(spark: SparkSession, keys: int, theta: float) -> DataFrame:
    """(rank from 0, low, high): each key's part of [0, 1) under weights 1 / (rank + 1) ** theta.

    The running sum is taken in blocks, then in each block, so that no one task sees all keys.
    """
    rows = spark.range(keys).select(F.col("id").alias("rank"), (1.0 / F.pow(F.col("id") + 1.0, F.lit(theta))).alias("w"), F.floor(F.col("id") / 65536).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("w").alias("bw"))
    blocks = blocks.select("block", F.sum("bw").over(Window.orderBy("block")).alias("upto"), "bw").join(F.broadcast(blocks.agg(F.sum("bw").alias("total"))))
    inner = F.sum("w").over(Window.partitionBy("block").orderBy("rank"))
    summed = rows.join(blocks, "block").select("rank", "block", ((F.col("upto") - F.col("bw") + inner) / F.col("total")).alias("high"), "w", "total")
    high = F.when(F.col("rank") == keys - 1, 1.0).otherwise(F.col("high"))
    return summed.select("rank", high.alias("high"), (F.col("w") / F.col("total")).alias("part"))


def operations(spark: SparkSession, w: Workload) -> DataFrame:
    """(op_index, type, key, value) of a workload."""
    rows = spark.range(w.operations).withColumnRenamed("id", "op_index")
    u = uniform(w.seed, "op", F.col("op_index")) * 100
    kind = F.when(u < w.reads, "read").when(u < w.reads + w.writes, "write").otherwise("delete")
    rows = rows.withColumn("type", kind)
    if w.distribution == "sequential":
        rows = rows.withColumn("key_index", F.col("op_index") % w.keys)
    elif w.distribution == "uniform":
        rows = rows.withColumn("key_index", F.floor(uniform(w.seed, "key", F.col("op_index")) * w.keys).cast("long"))
    else:
        rows = zipf_keys(spark, rows.withColumn("u", uniform(w.seed, "key", F.col("op_index"))), w.keys, w.theta).drop("u")
    size = w.min_value + F.floor(uniform(w.seed, "size", F.col("op_index")) * (w.max_value - w.min_value + 1)).cast("int")
    letter = F.char((97 + F.col("op_index") % 26).cast("long"))
    value = F.when(F.col("type") == "write", F.expr("repeat(letter_, size_)")).otherwise("")
    return rows.withColumn("letter_", letter).withColumn("size_", size).select("op_index", "type", format_key(F.col("key_index")).alias("key"), value.alias("value"))


def zipf_keys(spark: SparkSession, rows: DataFrame, keys: int, theta: float, cells: int = 4096) -> DataFrame:
    """rows with key_index, the first rank whose cumulative weight is at least u.

    The unit interval is cut into cells; a row meets only the ranks whose part reaches into its own cell.
    """
    cdf = zipf_cdf(spark, keys, theta)
    cdf = cdf.select(F.col("rank").alias("key_index"), "high", F.greatest(F.lit(0.0), F.col("high") - F.col("part")).alias("low_"))
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    spread = cdf.select("key_index", "high", F.explode(F.sequence(F.greatest(cell(F.col("low_")) - 1, F.lit(0)), cell(F.col("high")))).alias("cell"))
    first = Window.partitionBy("cell").orderBy("key_index")
    spread = spread.withColumn("from_", F.lag("high").over(first))
    met = rows.withColumn("cell", cell(F.col("u"))).join(spread, "cell").where("u <= high AND (from_ IS NULL OR u > from_)")
    return met.drop("cell", "high", "from_")
