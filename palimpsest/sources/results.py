"""Result tables as CSV with a header, or as JSON lines; doubles keep 17 significant digits, so that they come back the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact_doubles(df: DataFrame) -> DataFrame:
    """Floating-point columns as text of 17 significant digits."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*(F.format_string("%.16e", F.col(f.name).cast("double")).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV parts, each with one header line; null and the empty text differ."""
    exact_doubles(df).write.mode(mode).option("header", True).option("nullValue", "\\N").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What write_csv() wrote, under the given schema; rows that do not fit it are an error, as is another header."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("nullValue", "\\N").option("escape", '"').option("multiLine", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON lines, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
