"""From raw documents to a training mixture: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, jaccard_join, language_id, mixing, secret_scan
from palimpsest.llm.checkpoints import Tables

#: Rows of whole documents in one Arrow batch. Spark's default of 10,000 makes batches of tens of MB, which each task holds
#: several times: in the JVM beside its heap, and in its Python worker. Batches bear on memory alone.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Stages are lazy, so the setting stays; a smaller one of the caller's is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def keep_recognised_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go."""
    small_batches(spark)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return language_id.recognised(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links, the one with the smallest id stays."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to weights of 95 % of the highest entropy, over as many tokens as there are."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", keep_recognised_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix),
]

#: The stages have no equivalent in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; each is written as Parquet in the shared folder and read again by the next.

    A stage's input goes when its output is written, all of it if a stage fails; what the result still reads goes at the end of the driver.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark) as tables:
        for k, (_, stage) in enumerate(STAGES):
            before, docs = docs, stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = tables.write(docs)
                tables.drop(before)
    return docs
