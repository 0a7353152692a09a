"""The change log as a stream: the newest version of each key is the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.oplog import events_as_oplog
from palimpsest.sources import scratch


def newest(log: DataFrame) -> DataFrame:
    """Streaming or batch: an aggregate per key, so versions may come late and in any order.

    No watermark: a key's newest version, a delete too, is kept for good.
    """
    best = F.max_by(F.struct("seq", "op", "value"), F.struct("seq", "op")).alias("best")
    return log.groupBy("user_key").agg(best).select("user_key", "best.seq", "best.op", "best.value")


def batches_into(folder: str):
    """Writes each trigger's changed keys under its number, so that a repeated batch replaces itself."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return commit


def run(log: DataFrame, folder: str, commit=None) -> None:
    """Runs the stream over what there is. Started again on the same folder, after a stop at any point, it goes on from there."""
    writer = newest(log).writeStream.outputMode("update").foreachBatch(commit or batches_into(folder))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def result(spark: SparkSession, folder: str) -> DataFrame:
    return newest(spark.read.parquet(f"{folder}/out").select("user_key", "seq", "op", "value"))


def newest_by_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Runs the stream over the files there are, then reads what it left: every trigger appends the keys it changed, under its number."""
    folder = scratch.folder(spark, "stream")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parquet*")
    run(events_as_oplog(events), folder)
    return result(spark, folder)
