"""The change log: (user_key, seq, op, value), op 1 a put and op 0 a delete, whose value is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1
MAX_SEQ = 2**56 - 1
SCHEMA = T.StructType([T.StructField("user_key", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.IntegerType(), False), T.StructField("value", T.StringType())])


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is one operation on its user's key: an error deletes it, all else puts the properties."""
    return events_as_oplog(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_as_oplog(events: DataFrame) -> DataFrame:
    gone = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("user_key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, DELETE).otherwise(PUT).alias("op"),
        F.when(~gone, F.col("props")).alias("value"),
    )


def dedupe(log: DataFrame) -> DataFrame:
    """One row for each version (user_key, seq, op); of conflicting ones the least value stays."""
    return log.groupBy("user_key", "seq", "op").agg(F.min("value").alias("value"))


def audit(log: DataFrame) -> DataFrame:
    """One row of counts that are all 0 in a sound log."""
    versions = log.groupBy("user_key", "seq", "op").agg(F.count("*").alias("n"))
    bad = log.agg(
        F.count_if(F.expr("user_key IS NULL")).alias("null_keys"),
        F.count_if(F.expr(f"seq IS NULL OR seq < 0 OR seq > {MAX_SEQ}")).alias("bad_seqs"),
        F.count_if(F.expr("op IS NULL OR op NOT IN (0, 1)")).alias("bad_ops"),
        F.count_if(F.expr("op = 0 AND value IS NOT NULL OR op = 1 AND value IS NULL")).alias("bad_values"),
    )
    twice = versions.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))
    return bad.join(F.broadcast(twice))
