"""Which version of a key counts: newest by (seq, op), whatever the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def newest_first() -> tuple[Column, Column]:
    return F.desc("seq"), F.desc("op")


def newest(log: DataFrame) -> DataFrame:
    """The newest version of every key, deletes included. The rank limit prunes to one row a key before the shuffle, so a hot key is no hot task."""
    order = Window.partitionBy("user_key").orderBy(*newest_first())
    return log.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def visible(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a put. Deletes are filtered after the merge, never before."""
    return newest(log).where("op = 1")


def scan(log: DataFrame) -> DataFrame:
    """The visible keys and values in byte order of the key."""
    return visible(log).select("user_key", "value").orderBy("user_key")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The newest versions among those up to a sequence number; the filter reaches the scan."""
    return newest(log.where(F.col("seq") <= seq))


def multi_get(keys: DataFrame, log: DataFrame) -> DataFrame:
    """(user_key, status, value): FOUND, DELETED or NOT_FOUND for each asked key. Only asked keys are merged."""
    asked = keys.select("user_key").distinct()
    held = newest(log.join(asked, "user_key", "left_semi"))
    status = F.when(F.col("op").isNull(), "NOT_FOUND").when(F.col("op") == 0, "DELETED").otherwise("FOUND")
    return asked.join(held, "user_key", "left").select("user_key", status.alias("status"), "value")


def first_source(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """(user_key, file_id, level, status): which run answers a point read when runs are asked by level, then newest file first."""
    order = Window.partitionBy("user_key").orderBy("level", F.desc("file_id"), *newest_first())
    found = runs.join(keys.select("user_key").distinct(), "user_key", "left_semi").withColumn("rank_", F.row_number().over(order)).where("rank_ = 1")
    return keys.select("user_key").distinct().join(found, "user_key", "left").select("user_key", "file_id", "level", F.when(F.col("op").isNull(), "NOT_FOUND").when(F.col("op") == 0, "DELETED").otherwise("FOUND").alias("status"))


def version_chain(log: DataFrame) -> DataFrame:
    """Each version with its age (1 is the newest), the one it replaced and the one that replaced it."""
    order = Window.partitionBy("user_key").orderBy(*newest_first())
    return log.select("user_key", "seq", "op", F.row_number().over(order).alias("age"), F.lead("seq").over(order).alias("older_seq"), F.lag("seq").over(order).alias("newer_seq"), F.lead("value").over(order).alias("older_value"))


def order_violations(rows: DataFrame) -> DataFrame:
    """One row: how many rows of each run do not follow the one before them at position pos."""
    order = Window.partitionBy("file_id").orderBy("pos")
    before = F.lag(F.struct("user_key", -F.col("seq"), -F.col("op"))).over(order)
    return rows.select((before >= F.struct("user_key", -F.col("seq"), -F.col("op"))).alias("bad")).agg(F.count_if("bad").alias("violations"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: keys missing, keys too many, and values that differ."""
    e, a = expected.select("user_key", F.col("value").alias("e"), F.lit(1).alias("in_e")), actual.select("user_key", F.col("value").alias("a"), F.lit(1).alias("in_a"))
    both = e.join(a, "user_key", "full_outer")
    return both.agg(F.count_if(F.expr("in_a IS NULL")).alias("missing"), F.count_if(F.expr("in_e IS NULL")).alias("extra"), F.count_if(F.expr("in_a = 1 AND in_e = 1 AND NOT e <=> a")).alias("different"), F.count_if(F.expr("in_a = 1 AND in_e = 1 AND e <=> a")).alias("equal"))
