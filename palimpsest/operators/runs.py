"""Sorted runs: their versions, bounds, sizes, block indexes, and which of them a lookup can skip."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import codec
from palimpsest.operators import segments
from palimpsest.sources import scratch

ROWS = 1 << 16  # of a result, made at once in a Python worker


def form_runs(log: DataFrame, limit: int, chunk_rows: int = 500_000) -> DataFrame:
    """log with file_id and level 0: each run holds the versions that filled one memtable."""
    size = codec.memtable_bytes(F.col("user_key"), F.col("value"))
    return segments.reset_sum(log, size, limit, chunk_rows).withColumn("level", F.lit(0))


def sorted_position(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("file_id").orderBy("user_key", F.desc("seq"), F.desc("op"))
    return runs.withColumn("pos", F.row_number().over(order).cast("long"))


def manifest(runs: DataFrame) -> DataFrame:
    """One row for each run: entries, distinct keys, data bytes, and its smallest and largest internal key.

    Newer versions sort first within a key, so the bounds are taken over (key, -seq, -op).
    """
    key = F.struct("user_key", (-F.col("seq")).alias("nseq"), (-F.col("op")).alias("nop"))
    out = runs.groupBy("file_id", "level").agg(
        F.count("*").alias("entries"),
        F.count_distinct("user_key").alias("distinct_keys"),
        F.sum(codec.entry_bytes(F.col("user_key"), F.col("value"))).cast("long").alias("data_bytes"),
        F.min(key).alias("low"),
        F.max(key).alias("high"),
    )
    bound = lambda c, n: (F.col(f"{c}.user_key").alias(f"{n}_key"), (-F.col(f"{c}.nseq")).alias(f"{n}_seq"), (-F.col(f"{c}.nop")).alias(f"{n}_op"))
    return out.select("file_id", "level", "entries", "distinct_keys", "data_bytes", *bound("low", "smallest"), *bound("high", "largest"))


def manifest_violations(files: DataFrame, next_file_id: int, last_seq: int) -> DataFrame:
    """One row of counts that are all 0 in a valid manifest."""
    twice = files.groupBy("file_id").agg(F.count("*").alias("n")).agg(F.count_if(F.expr("n > 1")).alias("repeated_ids"))
    bad = files.agg(
        F.count_if((F.col("file_id") < 1) | (F.col("file_id") >= next_file_id)).alias("bad_ids"),
        F.count_if(F.expr("data_bytes <= 0")).alias("bad_sizes"),
        F.count_if(F.expr("smallest_key > largest_key OR smallest_key = largest_key AND smallest_seq < largest_seq")).alias("bad_bounds"),
        F.count_if(F.greatest("smallest_seq", "largest_seq") > last_seq).alias("bad_seqs"),
    )
    return bad.join(F.broadcast(twice))


def block_index(runs: DataFrame, target: int) -> DataFrame:
    """One row for each data block: its offset, size and last internal key."""
    rows = sorted_position(runs).withColumn("bytes", codec.entry_bytes(F.col("user_key"), F.col("value")))
    blocks = segments.pack_blocks(rows, target)
    key = F.struct("user_key", (-F.col("seq")).alias("nseq"), (-F.col("op")).alias("nop"))
    out = rows.join(blocks, ["file_id", "pos"]).groupBy("file_id", "block_no").agg(F.min("offset").alias("offset"), F.sum("bytes").cast("long").alias("size"), F.count("*").alias("entries"), F.max(key).alias("last"))
    return out.select("file_id", "block_no", "offset", "size", "entries", F.col("last.user_key").alias("last_key"), (-F.col("last.nseq")).alias("last_seq"), (-F.col("last.nop")).alias("last_op"))


def file_sizes(runs: DataFrame, target: int, bits_per_key: int) -> DataFrame:
    """Bytes of each run on disk: data, block index, filter and footer."""
    index = block_index(runs, target).groupBy("file_id").agg(F.sum("size").cast("long").alias("data_bytes"), F.count("*").alias("blocks"), F.sum(codec.index_bytes(F.col("last_key"))).cast("long").alias("index_bytes"))
    keys = runs.groupBy("file_id").agg(F.count_distinct("user_key").alias("keys"))
    filter_bytes = codec.bloom_bytes(F.col("keys"), bits_per_key) + 12
    return index.join(keys, "file_id").select("file_id", "blocks", "data_bytes", "index_bytes", filter_bytes.alias("filter_bytes"), (F.col("data_bytes") + F.col("index_bytes") + filter_bytes + 40).alias("file_bytes"))


def range_pruning(keys: DataFrame, files: DataFrame) -> DataFrame:
    """For each asked key, how many runs there are and how many its range cannot rule out; a bound that is not known rules nothing out.

    No pair of a key and a run is made: keys and bounds are sorted together, and a key's candidates are the ranges opened
    up to it less those closed before it. Running counts are per partition of that order, which is written once, since two runs of
    a range sort need not cut at the same keys. A null key is in no range.
    """
    low, high = F.col("smallest_key"), F.col("largest_key")
    sound = (~F.coalesce(low > high, F.lit(False))).cast("long")  # a range that ends before it begins holds no key
    mark = lambda key, opens, closes, held, asked: F.struct(key.alias("user_key"), opens.alias("opens"), closes.alias("closes"), F.lit(held).cast("long").alias("runs"), F.lit(asked).alias("asked"))
    none = F.lit(0).cast("long")
    bounds = files.select(F.explode(F.array(mark(low, sound, none, 1, False), mark(high, none, F.when(high.isNull(), 0).otherwise(sound).cast("long"), 0, False))).alias("m")).select("m.*")
    marks = bounds.unionByName(keys.select(mark(F.col("user_key"), none, none, 0, True).alias("m")).select("m.*"))
    marks = marks.groupBy("user_key").agg(*(F.sum(c).alias(c) for c in ("opens", "closes", "runs")), F.max("asked").alias("asked"))
    folder = scratch.folder(files.sparkSession, "bounds")
    marks.orderBy(F.asc_nulls_first("user_key")).withColumn("part_", F.spark_partition_id()).write.parquet(folder)
    ordered = files.sparkSession.read.parquet(folder)
    parts = ordered.groupBy("part_").agg((F.sum("opens") - F.sum("closes")).alias("n"))
    before = parts.select("part_", (F.sum("n").over(Window.orderBy("part_")) - F.col("n")).alias("before_"))
    so_far = Window.partitionBy("part_").orderBy(F.asc_nulls_first("user_key")).rowsBetween(Window.unboundedPreceding, 0)
    here = ordered.withColumn("open_", F.sum(F.col("opens") - F.col("closes")).over(so_far) + F.col("closes")).where("asked").join(F.broadcast(before), "part_")
    candidates = F.when(F.col("user_key").isNull(), 0).otherwise(F.col("before_") + F.col("open_")).cast("long")
    return here.select("user_key", candidates.alias("candidates")).join(F.broadcast(ordered.agg(F.coalesce(F.sum("runs"), F.lit(0)).cast("long").alias("runs"))))


def _filter_bits(m: int, positions: np.ndarray) -> bytes:
    bits = np.zeros(m, np.uint8)
    bits[positions.ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bloom_filters(runs: DataFrame, bits_per_key: int, hashes: int) -> DataFrame:
    """(file_id, m, bits): a packed bit array of each run's distinct keys. A run holds what filled one memtable, so it fits in a task."""
    keys = runs.select("file_id", "user_key").distinct()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        m = codec.bloom_size(len(pdf), bits_per_key)
        bits = _filter_bits(m, codec.bloom_positions(pdf["user_key"], m, hashes))
        return pd.DataFrame({"file_id": pdf["file_id"].iloc[:1], "m": [m], "bits": [bits]})

    return keys.groupBy("file_id").applyInPandas(build, "file_id long, m long, bits binary")


def _slices(weights: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows in a row of about so much weight together; at least one row each."""
    first, total = 0, 0
    for i, w in enumerate(weights):
        if i > first and total + w > most:
            yield first, i
            first, total = i, 0
        total += w
    if first < len(weights):
        yield first, len(weights)


def _asked(keys: DataFrame, block_keys: int) -> DataFrame:
    """Distinct keys in rows of up to so many: sorted, with the two hashes that filters take. Null keys are not asked for."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, block_keys):
                names = b.column(0).slice(i, block_keys).cast(pa.string())
                names = names.take(pc.array_sort_indices(names))
                one, two = codec.double_hashes(names.to_pylist())
                yield pa.record_batch([pa.array([x], pa.list_(t)) for x, t in ((names, pa.string()), (one.view(np.int64), pa.int64()), (two.view(np.int64), pa.int64()))], ["keys", "one", "two"])

    return keys.select("user_key").where("user_key IS NOT NULL").distinct().mapInArrow(block, "keys array<string>, one array<long>, two array<long>")


def _met(packs: DataFrame, asked: DataFrame) -> DataFrame:
    """Every row of packs with every row of asked, in a few tasks for each core, however few bytes these rows are."""
    side = math.isqrt(8 * packs.sparkSession.sparkContext.defaultParallelism - 1) + 1
    return packs.repartition(side).hint("shuffle_replicate_nl").crossJoin(asked.repartition(side))


def bloom_prune(keys: DataFrame, runs: DataFrame, bits_per_key: int = 10, hashes: int = 7, block_keys: int = 4096) -> DataFrame:
    """(user_key, file_id, maybe, present): whether a run's filter lets a key pass, and whether the run has it.

    Asked keys in blocks of up to so many meet filters in packs of runs of about twice as many keys. A run's keys come with its filter, so
    pairs of a key and a run are made once, as rows of the result, and are in no join or exchange. Null keys are not asked for.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_pylist()
            for i, j in _slices(sizes, 2 * block_keys):
                held = b.column(1).slice(i, j - i)
                m = [codec.bloom_size(n, bits_per_key) for n in sizes[i:j]]
                at = codec.bloom_positions(held.flatten().to_pylist(), np.repeat(m, sizes[i:j]), hashes)
                ends = np.cumsum(sizes[i:j])
                bits = [_filter_bits(k, at[e - n : e]) for k, n, e in zip(m, sizes[i:j], ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array([x], pa.list_(t)) for x, t in ((b.column(0).slice(i, j - i), pa.int64()), (m, pa.int64()), (bits, pa.binary()), (ends, pa.int64()), (held.flatten(), pa.string()))], ["file_id", "m", "bits", "ends", "held"])

    def passed(bits: bytes, m: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Each bit is looked up only for keys that all bits before let pass."""
        ones, left, out = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool), np.arange(len(one)), np.zeros(len(one), bool)
        for i in range(hashes):
            at = (one[left] + np.uint64(i) * two[left]) % np.uint64(m)
            left = left[ones[at.astype(np.int64)]]
        out[left] = True
        return out

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                files, m, bits, ends, held, names, one, two = (b.column(c)[r].values for c in range(8))
                n, one, two = len(names), one.to_numpy().view(np.uint64), two.to_numpy().view(np.uint64)
                ends, place = ends.to_numpy(), pc.fill_null(pc.index_in(held, value_set=names), -1).to_numpy()
                for i, j in _slices([n] * len(files), ROWS):
                    maybe, present = np.zeros((j - i, n), bool), np.zeros((j - i, n), bool)
                    for k in range(i, j):
                        maybe[k - i] = passed(bits[k].as_py(), m[k].as_py(), one, two)
                        own = place[ends[k - 1] if k else 0 : ends[k]]
                        present[k - i, own[own >= 0]] = True
                    yield pa.record_batch([pa.concat_arrays([names] * (j - i)), pa.array(np.repeat(files.slice(i, j - i).to_numpy(), n)), pa.array(maybe.ravel()), pa.array(present.ravel())], ["user_key", "file_id", "maybe", "present"])

    packs = runs.groupBy("file_id").agg(F.collect_set("user_key").alias("held")).mapInArrow(pack, "file_id array<long>, m array<long>, bits array<binary>, ends array<long>, held array<string>")
    return _met(packs, _asked(keys, block_keys)).mapInArrow(probe, "user_key string, file_id long, maybe boolean, present boolean")


def block_of_key(keys: DataFrame, blocks: DataFrame, block_keys: int = 4096) -> DataFrame:
    """(user_key, file_id, block_no): for each asked key and run, the first block whose last key is not below it; none if the key is beyond the run.

    Asked keys, sorted in blocks of up to so many, meet the block bounds of packs of runs; each bound is looked up among the keys,
    and those between two bounds are given out as they lie. Null keys are not asked for.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_pylist()
            for i, j in _slices(sizes, block_keys):
                numbers = [np.minimum.accumulate(b.column(2)[k].values.to_numpy()[::-1])[::-1] for k in range(i, j)]
                yield pa.record_batch([pa.array([x], pa.list_(t)) for x, t in ((b.column(0).slice(i, j - i), pa.int64()), (np.cumsum(sizes[i:j]), pa.int64()), (b.column(1).slice(i, j - i).flatten(), pa.string()), (np.concatenate(numbers), pa.int64()))], ["file_id", "ends", "last", "block_no"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                files, ends, last, numbers, names = (b.column(c)[r].values for c in range(5))
                at = np.searchsorted(np.array(names.to_pylist(), object), np.array(last.to_pylist(), object), "right")
                ends, numbers = ends.to_numpy(), numbers.to_numpy()
                starts = np.append(0, ends[:-1])
                counts = np.diff(at, prepend=0)
                counts[starts] = at[starts]
                reached = at[ends - 1]
                for i, j in _slices(reached.tolist(), ROWS):
                    own = slice(starts[i], ends[j - 1])
                    yield pa.record_batch([pa.concat_arrays([names.slice(0, n) for n in reached[i:j].tolist()]), pa.array(np.repeat(files.slice(i, j - i).to_numpy(), reached[i:j])), pa.array(np.repeat(numbers[own], counts[own]))], ["user_key", "file_id", "block_no"])

    bound = F.sort_array(F.collect_list(F.struct(F.col("last_key"), F.col("block_no").cast("long").alias("block_no"))))
    files = blocks.where("last_key IS NOT NULL").groupBy("file_id").agg(bound.alias("b")).select("file_id", "b.last_key", "b.block_no")
    packs = files.mapInArrow(pack, "file_id array<long>, ends array<long>, last array<string>, block_no array<long>")
    return _met(packs, _asked(keys, block_keys).select("keys")).mapInArrow(look_up, "user_key string, file_id long, block_no long")
