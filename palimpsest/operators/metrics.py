"""Percentiles, ratios and medians of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_rank(samples: DataFrame, group: list[str], value: str, percents: tuple[float, ...] = (0.5, 0.99, 0.999)) -> DataFrame:
    """Nearest-rank percentiles p50, p99 and so on: the smallest value that so large a part does not exceed; 0 without samples.

    Equal values are counted before the shuffle. The distinct ones are cut into ranges by size; how many lie below a range follows from
    the sums of the ranges, so a group's values are never in one task.
    """
    name = lambda p: "p" + f"{p * 100:g}".replace(".", "")
    counts = samples.groupBy(*group, F.col(value).alias("value_")).agg(F.count("*").alias("count_"))
    groups = counts.groupBy(*group).agg(F.sum(F.when(F.col("value_").isNotNull(), F.col("count_")).otherwise(0)).alias("samples"), F.min("value_").alias("low_"), F.max("value_").alias("high_"))
    same = F.lit(True)
    for c in group:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"g.{c}"))
    wide = (F.col("high_") - F.col("low_")).cast("double")
    ranged = counts.where("value_ IS NOT NULL").alias("c").join(groups.alias("g"), same).select(*(F.col(f"c.{c}").alias(c) for c in group), "value_", "count_", "samples", F.when(wide > 0, F.least(F.floor((F.col("value_") - F.col("low_")) / wide * 1024), F.lit(1023))).otherwise(0).alias("range_"))
    sums = ranged.groupBy(*group, "range_").agg(F.sum("count_").alias("sum_"))
    sums = sums.select(*group, "range_", (F.sum("sum_").over(Window.partitionBy(*group).orderBy("range_")) - F.col("sum_")).alias("below_"))
    for c in group:
        sums = sums.withColumnRenamed(c, f"{c}_r")
    placed = ranged.join(sums.withColumnRenamed("range_", "range_r"), (F.col("range_") == F.col("range_r")) & F.expr(" AND ".join(f"{c} <=> {c}_r" for c in group) or "true"))
    upto = F.col("below_") + F.sum("count_").over(Window.partitionBy(*group, "range_").orderBy("value_"))
    found = placed.withColumn("upto_", upto).groupBy(*group).agg(*(F.min(F.when(F.col("upto_") >= F.ceil(F.lit(p) * F.col("samples")), F.col("value_"))).alias(name(p)) for p in percents))
    same = F.expr(" AND ".join(f"g.{c} <=> f.{c}" for c in group) or "true")
    return groups.alias("g").join(found.alias("f"), same, "left").select(*(F.col(f"g.{c}").alias(c) for c in group), "samples", *(F.coalesce(name(p), F.lit(0)).alias(name(p)) for p in percents))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, 0 where there is nothing to divide by."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def write_amplification(wal: Column, tables: Column, user: Column) -> Column:
    return ratio(wal, user) + ratio(tables, user)


def space_amplification(tables: Column, live: Column) -> Column:
    return ratio(tables, live)


def hit_rate(hits: Column, misses: Column) -> Column:
    return ratio(hits, hits + misses)


def throughput(operations: Column, elapsed_ns: Column) -> Column:
    return ratio(operations * F.lit(1e9), elapsed_ns)


def medians(results: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    return results.groupBy(*group).agg(*(F.median(v).alias(f"median_{v}") for v in values))
