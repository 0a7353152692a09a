"""Lineage is cut by tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of the driver's own only where that is unset and one process does all, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return _own_folder()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Tables written as Parquet into a folder of their own in the shared one.

    Used as `with Tables(spark) as t`: if the body fails, all of them are deleted; else those that were not dropped
    stay, since lazy results may read them, until sweep() or the end of the driver.
    """

    left: list[Tables] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []
        self.n = 0

    def __enter__(self) -> Tables:
        Tables.left.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.drop_all()

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for held in [x for x in self.paths if x[0] is table]:
                delete(self.spark, held[1])
                self.paths.remove(held)

    def drop_all(self) -> None:
        delete(self.spark, self.folder)
        self.paths.clear()
        if self in Tables.left:
            Tables.left.remove(self)


@atexit.register
def sweep() -> None:
    """Deletes what is left; results that were not written or collected yet can no longer be."""
    for tables in list(Tables.left):
        try:
            tables.drop_all()
        except Exception:  # noqa: BLE001 - the session may have ended before
            Tables.left.remove(tables)
