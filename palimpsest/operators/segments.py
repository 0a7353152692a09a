"""Cutting an ordered log where a running size reaches a limit, in parallel.

What a chunk of the log does depends on the bytes carried into it only through its first cut; after that cut all others are
fixed. So every chunk is summarised alone, as a step function from the bytes still missing on entry to those missing
on exit. Functions of neighbours are composed in a tree of bounded fan-in, entry states are handed down it again, and
each chunk then cuts itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cuts(sums: np.ndarray, missing: int, limit: int) -> tuple[list[int], int]:
    """Rows after which a segment ends, and the bytes missing at the end."""
    cuts, target = [], missing
    while True:
        at = int(np.searchsorted(sums, target, "left"))
        if at >= len(sums):
            return cuts, target - (int(sums[-1]) if len(sums) else 0)
        cuts.append(at)
        target = int(sums[at]) + limit


STEPS = "node long, upto long, exit long, cuts long"  # for up to so many bytes missing on entry: those missing on exit, and the cuts; upto -1: all bytes of the node


def _merged(upto: np.ndarray, exits: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A step function without steps that change nothing: after a few cuts most entries have met."""
    last = np.append((exits[1:] != exits[:-1]) | (cuts[1:] != cuts[:-1]), True) if len(upto) else np.zeros(0, bool)
    return upto[last], exits[last], cuts[last]


def _frame(node: int, steps: tuple, total: int) -> pd.DataFrame:
    upto, exits, cuts = _merged(*steps)
    return pd.DataFrame({"node": node, "upto": np.append(upto, -1), "exit": np.append(exits, total), "cuts": np.append(cuts, 0)}).astype("int64")


def _function(part: pd.DataFrame) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    steps = part[part["upto"] >= 0].sort_values("upto")
    return tuple(steps[c].to_numpy(np.int64) for c in ("upto", "exit", "cuts")), int(part.loc[part["upto"] < 0, "exit"].iloc[0])


def _apply(f: tuple, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(missing on exit, cuts) for each of some entries."""
    (upto, exits, cuts), total = f
    at = np.searchsorted(upto, missing, "left")
    inside = at < len(upto)
    at = np.minimum(at, max(0, len(upto) - 1))
    return (np.where(inside, exits[at], missing - total), np.where(inside, cuts[at], 0)) if len(upto) else (missing - total, np.zeros_like(missing))


def compose(f: tuple, g: tuple) -> tuple:
    """First f, then g."""
    (upto, exits, cuts), total = f
    after, more = _apply(g, exits)
    (g_upto, g_exits, g_cuts), g_total = g
    return _merged(np.append(upto, g_upto + total), np.append(after, g_exits), np.append(cuts + more, g_cuts)), total + g_total


def _summary(limit: int):
    def f(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.cumsum(pdf.sort_values(["seq", "bytes"])["bytes"].to_numpy(np.int64))
        n = len(sums)
        # exit[i], count[i]: state at the end of the chunk if a segment starts after row i
        exits, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        after = np.searchsorted(sums, sums + limit, "left")
        for i in range(n - 1, -1, -1):
            j = int(after[i])
            exits[i], counts[i] = (exits[j], counts[j] + 1) if j < n else (sums[i] + limit - sums[-1], 0)
        first = np.flatnonzero(np.concatenate([[True], sums[:-1] < limit]))
        return _frame(int(key[0]), (sums[first], exits[first], counts[first] + 1), int(sums[-1]))

    return f


def _composed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The function of a node out of those of its children, in order."""
    whole = None
    for _, part in pdf.groupby("node", sort=True):
        f = _function(part)
        whole = f if whole is None else compose(whole, f)
    return _frame(int(key[0]), *whole)


def _handed_down(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The entry states of a node's children, out of its own."""
    missing, segment, rows = np.array([pdf["missing"].iloc[0]], np.int64), int(pdf["segment"].iloc[0]), []
    for node, part in pdf.groupby("node", sort=True):
        rows.append((node, int(missing[0]), segment))
        missing, cuts = _apply(_function(part), missing)
        segment += int(cuts[0])
    return pd.DataFrame(rows, columns=["node", "missing", "segment"])


def entries(steps: DataFrame, top: int | None, limit: int, fan_in: int = 256) -> DataFrame:
    """(node, missing, segment): what each chunk's function is entered with, chunks being numbered up to top. No task gets more than fan_in functions."""
    levels = [steps]
    while top is not None and top > 0:
        parent = F.floor(F.col("node") / fan_in).cast("long")
        levels.append(levels[-1].withColumn("parent", parent).groupBy("parent").applyInPandas(_composed, STEPS))
        top //= fan_in
    state = levels.pop().select("node").distinct().select("node", F.lit(limit).cast("long").alias("missing"), F.lit(0).cast("long").alias("segment"))
    for level in reversed(levels):
        parents = state.withColumnRenamed("node", "parent")
        state = level.withColumn("parent", F.floor(F.col("node") / fan_in).cast("long")).join(parents, "parent").groupBy("parent").applyInPandas(_handed_down, "node long, missing long, segment long")
    return state


def reset_sum(log: DataFrame, size, limit: int, chunk_rows: int = 500_000, fan_in: int = 256) -> DataFrame:
    """log with file_id (from 1): rows in order of seq, a file ends with the row that brings its size to the limit.

    A chunk holds the rows of so many consecutive sequence numbers, so a task is bounded; rows stay in their chunk. Rows that
    share a seq are in order of size, then key and op, and each is one row of the result.
    """
    rows = log.withColumn("bytes", size.cast("long")).withColumn("node", F.floor(F.col("seq") / chunk_rows).cast("long"))
    steps = rows.select("node", "seq", "bytes").groupBy("node").applyInPandas(_summary(limit), STEPS)
    columns = log.columns
    ties = [c for c in ("user_key", "op") if c in columns]

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "bytes", *ties])
        cuts, _ = _cuts(np.cumsum(pdf["bytes"].to_numpy(np.int64)), int(pdf["missing"].iloc[0]), limit)
        ended = np.zeros(len(pdf) + 1, np.int64)
        ended[np.array(cuts, np.int64) + 1] = 1
        return pdf[columns].assign(file_id=int(pdf["segment"].iloc[0]) + 1 + np.cumsum(ended[:-1]))

    schema = T.StructType([*log.schema.fields, T.StructField("file_id", T.LongType())])
    top = rows.agg(F.max("node")).first()[0]
    return rows.join(entries(steps, top, limit, fan_in), "node").groupBy("node").applyInPandas(assign, schema)


def pack_blocks(rows: DataFrame, target: int) -> DataFrame:
    """rows (file_id, pos, bytes) with block_no and offset: a block ends before the row that would pass the target size."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        block, filled, blocks = 0, 0, []
        for n in pdf["bytes"].tolist():
            if filled and filled + n > target:
                block, filled = block + 1, 0
            filled += n
            blocks.append(block)
        sizes = pdf["bytes"].cumsum() - pdf["bytes"]
        return pdf.assign(block_no=blocks, offset=sizes)[["file_id", "pos", "block_no", "offset"]]

    return rows.select("file_id", "pos", "bytes").groupBy("file_id").applyInPandas(f, "file_id long, pos long, block_no long, offset long")
