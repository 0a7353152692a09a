"""Texts compressed for a shuffle by document, and rows of one long key with its document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.checkpoints import Tables


def pack_column(text: pa.Array) -> pa.Array:
    packer = zstandard.ZstdCompressor(level=1)
    return pa.array([packer.compress(x.as_buffer()) if x.is_valid else None for x in text.cast(pa.binary())], pa.binary())


def pack_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, packed): the text's 64-bit hash, and the text compressed, so that a shuffle moves fewer bytes. Null stays null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pack_column(b.column(2))], ["doc_id", "tag", "packed"])

    return _tagged(docs).mapInArrow(pack, "doc_id long, tag long, packed binary")


def _tagged(docs: DataFrame, *more) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), *more, text.alias("text"))


def text_groups(docs: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, tag, least, n): of every text under an id that more than one row holds, the least id and the number of rows.

    The groups are a table before they are joined, so that Spark sees both sides of that join as they are: it
    broadcasts few groups, and splits a text that very many rows hold.
    """
    ids = _tagged(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), F.unhex(F.md5(F.col("text").cast("string"))).alias("sum")).drop("text")
    first = tables.write(ids.groupBy("sum").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    found = tables.write(ids.join(first, "sum").select("doc_id", "tag", "least", "n").distinct())
    tables.drop(first)
    return found


def later_copies(groups: DataFrame) -> DataFrame:
    """(doc_id, copied): tags of the texts under this id that a smaller id holds too, byte for byte."""
    return groups.where("doc_id > least").groupBy("doc_id").agg(F.collect_set("tag").alias("copied"))


def with_and_without_id(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed rows with a doc_id, which one exchange can then serve in every join on it, and the others, unpacked.

    The others are in no join, so they need no packing, and a task needs no second Python worker to undo it.
    """
    return pack_texts(docs.where("doc_id IS NOT NULL")), unpacked(docs.where("doc_id IS NULL"))


def unpacked(docs: DataFrame) -> DataFrame:
    """Rows as pack_texts() gives them, but with the text's own bytes."""
    return _tagged(docs).select("doc_id", "tag", F.col("text").cast("binary").alias("packed"))


def is_copy() -> Column:
    return F.coalesce(F.array_contains("copied", F.col("tag")), F.lit(False))


def originals(packed: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, packed) of the texts that no smaller id holds too."""
    return packed.join(copies, "doc_id", "left").where(~is_copy()).select("doc_id", "packed")


def unpack_texts(column: pa.Array, packed: bool = True) -> pa.Array:
    if not packed:
        return column.cast(pa.large_binary())
    reader = zstandard.ZstdDecompressor()
    return pa.array([reader.decompress(x.as_buffer()) if x.is_valid else None for x in column], pa.large_binary())


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_packed(rows: DataFrame, f: Callable, schema: str, lower: bool = False) -> DataFrame:
    """f(ids, words, lists) -> arrays of one output batch, for each bounded piece of (doc_id, packed[, keys])."""
    from palimpsest.llm.kernels import lists, words

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            row, keys = lists(b.column(2)) if b.num_columns > 2 else (np.zeros(0, int), np.zeros(0, np.uint64))
            for w in words(unpack_texts(b.column(1)), lower):
                own = (row >= w.first) & (row < w.end)
                yield pa.record_batch([pa.array(x) for x in f(ids[w.first : w.end], w, (row[own] - w.first, keys[own]))], names)

    return rows.mapInArrow(run, schema)


def longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def repeated_keys(parts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that come at least so many times in all parts, sorted, and their counts.

    The parts are emptied and their keys sorted in place, so that a Python worker holds them twice at most.
    """
    keys = np.concatenate(parts)
    parts.clear()
    keys.sort()
    last = len(keys) - least + 1
    if last < 1:
        return keys[:0], np.zeros(0, np.int64)
    many = keys[:last] == keys[least - 1 :]
    many[1:] &= keys[1:last] != keys[: last - 1]
    first = np.flatnonzero(many)
    found = keys[first]
    return found, np.searchsorted(keys, found, "right") - first


def frequent_keys(texts: DataFrame, keys_of: Callable, most: int, lower: bool = False, least: int = 3, together: int = 3_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys that keys_of(words) gives, rarest first, and their counts.

    Keys that come at least so many times among so many in a row of the input are counted over all of it, so a key that a
    noticeable part of all texts share is never missed; what comes back is bounded by the parameter most.
    """
    from palimpsest.llm.kernels import words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            keys, counts = repeated_keys(held, least)
            return pa.record_batch([pa.array(longs(keys)), pa.array(counts.astype(np.int64))], ["key", "n"])

        for b in small_batches(batches):
            for w in words(unpack_texts(b.column(0)), lower=lower):
                held.append(keys_of(w))
                if sum(map(len, held)) > together:
                    yield counted()
        if held:
            yield counted()

    top = texts.select("packed").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(most).toArrow()
    keys, counts = (top.column(i).to_numpy()[::-1].astype(np.int64) for i in (0, 1))
    return keys.view(np.uint64), counts
