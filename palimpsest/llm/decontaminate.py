"""Benchmark passages in documents, in whatever order their parts stand, by greedy string tiling."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm import kernels as K

FOUND = "doc_id long, item_id long, n_item_words long, n_matched long, n_tiles long, coverage double"
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """The running Karp-Rabin hash of so many words from each position on: one difference of running sums each."""
    at = np.arange(max(0, len(hashes) - size + 1))
    return K.range_hash(K.prefix_sums(hashes), at, at + size)


def seeds_of(words: np.ndarray, least: int) -> tuple[int, np.ndarray]:
    """(size, hashes) of an item's seeds: runs of the least length of a tile, or the whole of a shorter item."""
    size = min(least, len(words))
    return size, rolling(words, size) if size else np.zeros(0, np.uint64)


def spare_seeds(n_words: int, least: int, threshold: float) -> int:
    """How many of an item's seeds can be left out of the search.

    Tiles that cover the share have, at the least length, one seed for so many words; so any document with fewer of
    the item's seeds than that cannot be a find, and all but one less of them are enough to meet every find.
    """
    return max(0, -(-math.ceil(threshold * n_words - 1e-9) // least) - 1) if n_words >= least else 0


def rarest(keys: np.ndarray, counts: np.ndarray, spare: int) -> np.ndarray:
    """Positions of the seeds to search by: all but so many of the most frequent."""
    return np.sort(np.lexsort((keys, counts))[: len(keys) - spare])


@dataclass
class Items:
    """Some benchmark items: their word hashes, and by seed size the sorted seeds to search by, with the item of each."""

    ids: list[int]
    words: list[np.ndarray]
    least: int
    threshold: float

    def __post_init__(self) -> None:
        found: dict[int, list[tuple]] = defaultdict(list)
        own = [seeds_of(w, self.least) for w in self.words]
        keys, counts = np.unique(np.concatenate([np.unique(g) for _, g in own] or [np.zeros(0, np.uint64)]), return_counts=True)
        for k, (size, g) in enumerate(own):
            if len(g):
                at = rarest(g, counts[np.searchsorted(keys, g)], spare_seeds(len(self.words[k]), self.least, self.threshold))
                g = np.unique(g[at])
                found[size].append((g, np.full(len(g), k)))
        self.seeds = {}
        for size, parts in found.items():
            keys, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            self.seeds[size] = keys[order], item[order]


def greedy_tiles(doc: np.ndarray, item: np.ndarray, runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length): always the longest run of equal words in which nothing is marked yet, of equal ones the first in the item, then in the document.

    runs are the maximal equal runs that the running hash of the least length finds; a run that meets a marked word is cut
    there, and its parts of at least that length wait their turn.
    """
    marked_item, marked_doc = np.zeros(len(item), bool), {}
    waiting = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(waiting)
    tiles = []
    while waiting:
        n, i, j = heapq.heappop(waiting)
        n = -n
        free = [not marked_item[i + x] and (j + x) not in marked_doc for x in range(n)]
        if all(free):
            if not np.array_equal(item[i : i + n], doc[j : j + n]):
                continue
            tiles.append((i, j, n))
            marked_item[i : i + n] = True
            marked_doc.update(dict.fromkeys(range(j, j + n)))
            if marked_item.all():
                break
            continue
        start = 0
        for x in range(n + 1):
            if x == n or not free[x]:
                if x - start >= least:
                    heapq.heappush(waiting, (start - x, i + start, j + start))
                start = x + 1
    return tiles


def _runs(at: np.ndarray, where: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Seeds (item position, document position) joined along diagonals into maximal runs."""
    order = np.lexsort((at, where - at))
    at, where = at[order], where[order]
    new = np.ones(len(at), bool)
    new[1:] = ((where - at)[1:] != (where - at)[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(at)))
    return [(int(at[f]), int(where[f]), int(c) + size - 1) for f, c in zip(first, counts, strict=True)]


def tile(doc: np.ndarray, grams: np.ndarray, item: np.ndarray, least: int, threshold: float) -> tuple[int, int] | None:
    """(matched words, tiles) of a document, given with its running hashes, and an item, or None below the threshold."""
    size, own = seeds_of(item, least)
    order = np.argsort(own, kind="stable")
    low, high = np.searchsorted(own[order], grams, "left"), np.searchsorted(own[order], grams, "right")
    hits = np.flatnonzero(high > low)
    counts = (high - low)[hits]
    where = np.repeat(hits, counts)
    at = order[np.repeat(low[hits], counts) + np.arange(len(where)) - np.repeat(np.cumsum(counts) - counts, counts)]
    if K.spread(np.unique(at), size, len(item)).sum() < threshold * len(item):
        return None
    tiles = greedy_tiles(doc, item, _runs(at, where, size), size)
    matched = sum(n for _, _, n in tiles)
    return (matched, len(tiles)) if matched >= threshold * len(item) else None


def _found(w: K.Words, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, matched, tiles) of the finds in a piece of documents."""
    starts = w.word_offsets()
    for size, (keys, item) in items.seeds.items():
        grams = rolling(w.hashes, size)
        low, high = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
        hits = np.flatnonzero((high > low) & K.same_row(w.row, size))
        if not len(hits):
            continue
        counts = high[hits] - low[hits]
        slot = np.repeat(low[hits], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        pairs = np.unique(np.repeat(w.row[hits], counts) * np.int64(len(items.ids)) + item[slot])
        for r, k in zip((pairs // len(items.ids)).tolist(), (pairs % len(items.ids)).tolist(), strict=True):
            a, b = int(starts[r]), int(starts[r + 1])
            got = tile(w.hashes[a:b], grams[a : max(a, b - size + 1)], items.words[k], items.least, items.threshold)
            if got:
                yield r, k, *got


def _item_words(texts: pa.Array) -> list[np.ndarray]:
    return [x for w in K.words(texts, fold=True) for x in np.split(w.hashes, w.word_offsets()[1:-1])]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def _small(items: DataFrame, most_chars: int) -> bool:
    return (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= most_chars


def _broadcast(items: DataFrame):
    """The items' ids and word hashes, for a benchmark whose size was checked before."""
    table = items.toArrow()
    words = _item_words(table.column(1)) if len(table) else []
    return items.sparkSession.sparkContext.broadcast((table.column(0).to_pylist(), words))


def candidates(texts: DataFrame, items: DataFrame, threshold: float, least: int) -> DataFrame:
    """(tag, item_tag) of texts (tag, text) and items (item_tag, text) that share one of the item's rarer seeds, by a join on seeds."""

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, words in enumerate(_item_words(b.column(1))):
                size, g = seeds_of(words, least)
                g, times = np.unique(g, return_counts=True)
                if len(g):
                    yield pa.record_batch([pa.array(np.full(len(g), size, np.int32)), pa.array(g.view(np.int64)), pa.array(np.full(len(g), b.column(0)[i].as_py())), pa.array(np.full(len(g), spare_seeds(len(words), least, threshold), np.int32)), pa.array(times.astype(np.int64))], ["size", "seed", "item_tag", "spare", "times"])

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = b.column(0).to_numpy(zero_copy_only=False)
            for w in K.words(b.column(1), fold=True):
                for size in range(1, least + 1):
                    ok = K.same_row(w.row, size)
                    row, keys = K.distinct_pairs(w.row[: len(ok)][ok], rolling(w.hashes, size)[ok])
                    yield pa.record_batch([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(tags[w.first + row])], ["size", "seed", "tag"])

    seeds = items.select("item_tag", "text").mapInArrow(item_seeds, "size int, seed long, item_tag long, spare int, times long")
    shared = seeds.groupBy("size", "seed").agg(F.count("*").alias("n"))
    order = Window.partitionBy("item_tag").orderBy(F.desc("n"), "seed")
    rare = seeds.join(shared, ["size", "seed"]).withColumn("upto", F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("upto > spare").select("size", "seed", "item_tag")
    sizes = rare.select("size").distinct()
    found = texts.select("tag", "text").mapInArrow(doc_seeds, "size int, seed long, tag long").join(F.broadcast(sizes), "size", "left_semi")  # at most least rows
    return found.join(rare, ["size", "seed"]).select("tag", "item_tag").distinct()


def joined_finds(texts: DataFrame, items: DataFrame, threshold: float, least: int) -> DataFrame:
    """(tag, item_id, n_item_words, n_matched, n_tiles) for a benchmark of any size: pairs that share seeds are joined with both texts."""
    texts = texts.select(F.xxhash64("text").alias("tag"), "text")
    items = items.select("item_id", F.xxhash64("item_id", "text").alias("item_tag"), "text")
    pairs = candidates(texts, items, threshold, least)
    one = texts.join(pairs.select("tag").distinct(), "tag", "left_semi").dropDuplicates(["tag"])
    rows = pairs.join(one, "tag").join(items.select("item_id", "item_tag", F.col("text").alias("item_text")), "item_tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                got = []
                for i, (doc, item) in enumerate(zip(_item_words(b.column(1)), _item_words(b.column(3)), strict=True)):
                    found = tile(doc, rolling(doc, min(least, len(item))), item, least, threshold)
                    if found:
                        got.append((b.column(0)[i].as_py(), b.column(2)[i].as_py(), len(item), *found))
                if got:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], ["tag", "item_id", "n_item_words", "n_matched", "n_tiles"])

    return rows.select("tag", "text", "item_id", "item_text").mapInArrow(run, "tag long, item_id long, n_item_words long, n_matched long, n_tiles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5, most_chars: int = 16_000_000) -> DataFrame:
    """doc_id, item_id, n_item_words, n_matched, n_tiles, coverage: the pairs in which tiles cover the item's share.

    Words are runs without white space or ASCII punctuation, in lower case. Tiles have at least so many words; a shorter
    item is one tile, found where it stands whole. Each word of item and document lies in one tile at most, so reordered
    passages count in full and repeated ones once. Coverage is the share of the item's words in tiles, and the pair is a
    find from the threshold on.

    A benchmark of up to most_chars characters is broadcast, and documents stay where they are read; a larger one
    is joined with the documents on shared seeds. Either way an item's most frequent seeds, as many as every find can do
    without, are not searched by. Null texts and texts without words match nothing, null ids take no part. Repeated rows
    give repeated finds; an empty table on either side gives none. Other columns are ignored.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    if not _small(items, most_chars):
        found = joined_finds(rows, items, threshold, least)
        out = rows.select("doc_id", F.xxhash64("text").alias("tag")).join(found, "tag")
        return out.select("doc_id", "item_id", "n_item_words", "n_matched", "n_tiles", (F.col("n_matched") / F.col("n_item_words")).alias("coverage"))
    shared = _broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Items(*shared.value, least, threshold)
        for b in batches:
            doc_ids = b.column(0).to_numpy(zero_copy_only=False)
            for w in K.words(b.column(1), fold=True):
                got = list(_found(w, held))
                if got:
                    r, k, matched, tiles = (np.array(x, np.int64) for x in zip(*got, strict=True))
                    sizes = np.array([len(held.words[x]) for x in k], np.int64)
                    yield pa.record_batch([pa.array(doc_ids[w.first + r].astype(np.int64)), pa.array([held.ids[x] for x in k], pa.int64()), pa.array(sizes), pa.array(matched), pa.array(tiles), pa.array(matched / sizes)], NAMES)

    return rows.mapInArrow(run, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5, fewest_words: int = 5, most_chars: int = 16_000_000) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item of the benchmark of at least so many words.

    That a document holds a run of one to four words, as a short answer may be, is no sign that it holds the benchmark;
    contaminated() reports such finds too.
    """
    items, at = _items(benchmark), docs.columns.index("text")
    if not _small(items, most_chars):
        texts = docs.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text"))
        bad = joined_finds(texts, items, threshold, least).where(F.col("n_item_words") >= fewest_words).select("tag").distinct()
        return docs.withColumn("tag_", F.xxhash64(F.col("text").cast("string"))).join(bad.withColumnRenamed("tag", "tag_"), "tag_", "left_anti").select(*docs.columns)
    shared = _broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words = shared.value
        held = Items(ids, [x if len(x) >= fewest_words else x[:0] for x in words], least, threshold)
        for b in batches:
            bad = {w.first + r for w in K.words(b.column(at), fold=True) for r, *_ in _found(w, held)}
            yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b

    return docs.mapInArrow(run, docs.schema)
