"""A sample of rows to fit a model on, of bounded size and the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, key: str, most: int, partitions: int = 24) -> DataFrame:
    """About so many rows (all, if there are fewer), one for each key chosen by hash; of rows that share a key the least stays.

    The share of hashes to take follows from a count, so nothing is sorted and no task sees more than its part. So few
    rows need few partitions, whatever the shuffle has. Rows with a null key count as one key.
    """
    n = rows.count()
    at = F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1))
    share = min(1.0, most / max(1, n))
    rest = [c for c in rows.columns if c != key]
    taken = rows.where(at < int(share * (1 << 62))) if share < 1 else rows
    return taken.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*").coalesce(partitions)
