"""Removal of word passages that an earlier document already holds, by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm import kernels as K
from palimpsest.llm.checkpoints import Tables
from palimpsest.llm.packed import is_copy, later_copies, longs, map_packed, originals, small_batches, text_groups, unpack_texts, with_and_without_id


def level_lengths(window: int, first: int = 6) -> list[int]:
    """Lengths that double as long as they do not pass the window, then the window itself."""
    out = [first if first < window else max(1, window - 1)]
    while out[-1] * 2 <= window:
        out.append(out[-1] * 2)
    return out if len(out) > 1 and out[-1] == window else [*out, window]


def _candidates(w: K.Words, known: tuple[np.ndarray, np.ndarray], short: int, length: int, thinned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows whose shorter windows are all known to repeat."""
    ok = K.same_row(w.row, length)
    hashes = K.ngrams(w.hashes, length)
    grams, ends = K.ngrams(w.hashes, short), length - short
    alive = K.in_sets(w.row[: len(grams)], grams, *known)
    if thinned:
        at = K.leftmost_minimum(grams, ends + 1)
        ok &= alive[at]
    else:
        ok &= alive[: len(ok)] & alive[ends : ends + len(ok)]
    at = np.flatnonzero(ok)
    return at, hashes[at]


def _first_keys(w: K.Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the shortest windows, thinned so that each window of the next length keeps one."""
    grams = K.ngrams(w.hashes, lengths[0])
    whole = K.same_row(w.row, lengths[1])
    at = np.unique(K.leftmost_minimum(grams, lengths[1] - lengths[0] + 1)[: len(whole)][whole]) if len(whole) else np.zeros(0, int)
    return K.distinct_pairs(w.row[at], grams[at])


def repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, keys): per document the hashes of its windows that also start in a document with a smaller id."""
    lengths = level_lengths(window)

    def first(ids: np.ndarray, w: K.Words, _) -> tuple:
        row, keys = _first_keys(w, lengths)
        return longs(keys), ids[row].astype(np.int64)

    def extend(short: int, length: int, thinned: bool):
        def f(ids: np.ndarray, w: K.Words, known: tuple) -> tuple:
            at, hashes = _candidates(w, known, short, length, thinned)
            row, keys = K.distinct_pairs(w.row[at], hashes)
            return longs(keys), ids[row].astype(np.int64)

        return f

    of_key = Window.partitionBy("key")
    rows = map_packed(texts, first, "key long, doc_id long")
    for k, length in enumerate(lengths[1:], 1):
        repeated = rows.select("key", "doc_id", F.count("*").over(of_key).alias("n")).where("n > 1")
        known = repeated.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
        rows = map_packed(texts.join(known, "doc_id"), extend(lengths[k - 1], length, k == 1), "key long, doc_id long")
    later = rows.select("key", "doc_id", F.min("doc_id").over(of_key).alias("least")).where("doc_id > least")
    return later.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 of every row.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A word goes if a window of so many consecutive words
    that covers it also starts in a document with a smaller doc_id; windows are judged on the input. Windows of six words are
    counted first, thinned so that every window of twelve keeps at least one of them; only where these repeat are windows of
    twice the length formed, and so on until the full length is reached or none is left. A text that a smaller
    id holds too, byte for byte, goes whole (if it has a window) and is left out of the levels.

    A null or empty text has no words, its hash is that of the empty text. Fewer words than a window: nothing goes.
    Rows with a null doc_id take no part and keep all their words. Rows that repeat a doc_id are judged alike, never
    against each other. An empty table gives no rows; other columns are ignored. Windows are compared by 64-bit hash.
    """
    packed, without_id = with_and_without_id(docs)
    with Tables(docs.sparkSession) as tables:
        copies = later_copies(text_groups(docs, tables))
        flagged = repeated_windows(originals(packed, copies), window)

    def finish(batches: Iterator[pa.RecordBatch], packed: bool = True) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            set_row, set_keys = K.lists(b.column(2))
            copied = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for w in K.words(unpack_texts(b.column(1), packed)):
                own = (set_row >= w.first) & (set_row < w.end)
                starts = np.zeros(0, int)
                if own.any():
                    ok = K.same_row(w.row, window)
                    hit = K.in_sets(w.row[: len(ok)], K.ngrams(w.hashes, window), set_row[own] - w.first, set_keys[own])
                    starts = np.flatnonzero(hit & ok)
                gone = K.spread(starts, window, len(w.row))
                counts = np.bincount(w.row, minlength=w.end - w.first)
                gone |= (copied[w.first : w.end] & (counts >= window))[w.row]
                texts = joined_words(w, ~gone)
                n = w.end - w.first
                yield pa.record_batch(
                    [
                        b.column(0).slice(w.first, n),
                        pa.array(counts.astype(np.int64)),
                        pa.array(np.bincount(w.row[gone], minlength=n).astype(np.int64)),
                        pa.array([str(x, "utf-8", "replace") for x in texts], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    rows = packed.join(copies, "doc_id", "left").join(flagged, "doc_id", "left").select("doc_id", "packed", "keys", is_copy().alias("copy"))
    others = without_id.select("doc_id", "packed", F.array().cast("array<long>").alias("keys"), F.lit(False).alias("copy"))
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return rows.mapInArrow(finish, schema).unionByName(others.mapInArrow(lambda batches: finish(batches, packed=False), schema))


def joined_words(w: K.Words, keep: np.ndarray) -> list[memoryview]:
    """Of each text, the kept words joined by one space, as UTF-8."""
    s, e, row = w.starts[keep], w.ends[keep], w.row[keep]
    more = np.zeros(len(row), np.int64)
    more[:-1] = row[1:] == row[:-1]
    data = np.append(w.data, np.uint8(0))
    data[e[more == 1]] = 0x20
    edges = np.zeros(len(data) + 1, np.int32)
    edges[s] += 1
    np.add.at(edges, e + more, -1)
    taken = data[np.cumsum(edges[:-1]) > 0]
    sizes = np.bincount(row, weights=e - s + more, minlength=w.end - w.first).astype(np.int64)
    ends = np.cumsum(sizes)
    view = memoryview(np.ascontiguousarray(taken))
    return [view[b - n : b] for b, n in zip(ends, sizes, strict=True)]
