"""Bytes that a long repeated string covers, by a distributed merge sort of front-coded suffix runs.

Sorting every suffix would move each text a few hundred times over. Instead each window of `length` bytes names one of
the grams of half that length inside it, the least by hash (so equal windows name equal grams, and about one position
in fifty is named), and only suffixes at named grams that occur again are sorted; together with the bytes
before them they decide every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.checkpoints import Tables
from palimpsest.llm.packed import later_copies, originals, small_batches, text_groups, unpack_texts, with_and_without_id
from palimpsest.llm.suffix_runs import front_code, merge

U = np.uint64


@dataclass
class Anchors:
    """The named grams of a piece: position, row, the bytes around that its windows can reach, and hashes of gram and surroundings."""

    at: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    keys: np.ndarray
    contexts: np.ndarray


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> Anchors:
    gram, n = length // 2, len(data)
    reach = length - gram
    if n < length:
        z = np.zeros(0, np.int64)
        return Anchors(z, z, z, z, z.astype(U), z.astype(U))
    sums = K.prefix_sums(data)
    starts = np.arange(n - gram + 1)
    grams = K.range_hash(sums, starts, starts + gram)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = row[: n - length + 1] == row[length - 1 :]
    named = np.zeros(n, bool)
    named[K.leftmost_minimum(grams, reach + 1)[whole]] = True
    at = np.flatnonzero(named)
    low, high = np.maximum(off[row[at]], at - reach), np.minimum(off[row[at] + 1], at + length)
    contexts = K.mix(K.range_hash(sums, low, high) + (at - low).astype(U) * U(0x9E3779B97F4A7C15))
    return Anchors(at, row[at], low, high, grams[at], contexts)


def _map(rows: DataFrame, f, schema: str) -> DataFrame:
    """f(ids, first row, bytes, offsets, batch) -> columns, over packed rows in bounded pieces."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, off in K.text_pieces(unpack_texts(b.column(1))):
                yield pa.record_batch([pa.array(x) for x in f(ids[first:end], first, data, off, b)], names)

    return rows.mapInArrow(run, schema)


def _own(b: pa.RecordBatch, column: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    row, values = K.lists(b.column(column))
    own = (row >= first) & (row < end)
    return row[own] - first, values[own]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shared_offsets(order: list[tuple[int, int]], lefts: list[bytes], length: int) -> np.ndarray:
    """For each sorted suffix (common prefix with the one before, its length) and each distance back from the gram, whether the window there occurs again.

    The window o bytes back is equal for two suffixes if these share length - o bytes and the o bytes before them agree.
    """
    reach, m = length - length // 2, len(lefts)
    common = np.array([c for c, _ in order], np.int64)
    held = np.zeros((m, reach), np.uint8)
    sizes = np.array([len(x) for x in lefts])
    for i, x in enumerate(lefts):
        held[i, : len(x)] = np.frombuffer(x[::-1], np.uint8)
    back = np.zeros(m, U)
    out = np.zeros((m, reach + 1), bool)
    for o in range(reach + 1):
        if o:
            back += (held[:, o - 1].astype(U) + U(1)) * K.powers(reach)[0][o - 1]
        run = np.cumsum(common < length - o)
        enough = np.flatnonzero(sizes >= o)
        keys = K.mix(back[enough]) ^ K.mix(K.mix(run[enough].astype(U) + U(1 << 40)))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        out[enough, o] = counts[inverse] > 1
    return out


RUN = "bucket long, shared binary, sizes binary, rest binary, left_sizes binary, lefts binary, contexts binary, again binary"


def _encode(bucket: int, members: list[tuple[bytes, bytes, int, bool]]) -> tuple:
    members.sort()
    shared, rest = front_code([m[0] for m in members])
    wide = lambda x: np.array(x, np.uint32).tobytes()
    return bucket, wide(shared), wide([len(x) for x in rest]), b"".join(rest), wide([len(m[1]) for m in members]), b"".join(m[1] for m in members), np.array([m[2] for m in members], np.int64).tobytes(), bytes(m[3] for m in members)


def _split(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))
    return [data[b - n : b] for b, n in zip(ends.tolist(), np.frombuffer(sizes, np.uint32).tolist(), strict=True)]


def _merge_runs(length: int):
    """Of the runs of one bucket: (context, whole, offsets), the distances back at which its windows occur again, or all of them."""

    def f(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        runs = [(np.frombuffer(r["shared"], np.uint32).tolist(), _split(r["sizes"], r["rest"])) for r in rows]
        lefts = [_split(r["left_sizes"], r["lefts"]) for r in rows]
        contexts = [np.frombuffer(r["contexts"], np.int64).tolist() for r in rows]
        taken = [0] * len(rows)
        order, left, ids, again = [], [], [], []
        for r, common, s in merge(runs):
            k = taken[r]
            order.append((common, len(s)))
            left.append(lefts[r][k])
            ids.append(contexts[r][k])
            again.append(rows[r]["again"][k])
            taken[r] = k + 1
        found, whole = shared_offsets(order, left, length), np.array(again, bool)
        found[whole] = False
        some = np.flatnonzero(found.any(1) | whole)
        counts, (_, back) = found[some].sum(1), np.nonzero(found[some])
        offsets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(back.astype(np.int32)))
        return pa.table({"context": pa.array([ids[i] for i in some], pa.int64()), "whole": pa.array(whole[some]), "offsets": offsets})

    return f


def repeated_offsets(texts: DataFrame, members: DataFrame, length: int, bucket_rows: int, tables: Tables) -> DataFrame:
    """(context, whole, offsets): of surroundings, the distances back at which a window occurs again, or that all do.

    members has one row for each distinct surroundings of a repeated gram: (key, context, doc_id, n), n being how often they
    occur. Grams are dealt to buckets of about bucket_rows suffixes, by ranges of a hash; in a bucket the suffixes are in
    order of their bytes. A gram that alone has more than a bucket is split by window hash instead (of the window, its
    gram and the distance between them, so that no window is taken for its own copy).
    """
    buckets = max(1, -(-members.count() // bucket_rows))
    large = tables.write(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key"))
    split = not large.isEmpty()
    small = members.join(large, "key", "left_anti") if split else members
    again = F.collect_list(F.when(F.col("n") > 1, F.col("context")))
    rows = texts.join(small.groupBy("doc_id").agg(F.collect_list("context").alias("small"), again.alias("again")), "doc_id").select("doc_id", "packed", "small", "again")

    def write_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                columns = list(zip(*(_encode(k, v) for k, v in sorted(held.items())), strict=True))
                kinds = [pa.int64(), *[pa.binary()] * 7]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in RUN.split(", ")])
                held.clear()

        for b in small_batches(batches):
            for first, end, data, off in K.text_pieces(unpack_texts(b.column(1))):
                a = anchors(data, off, length)
                wanted = np.flatnonzero(K.in_sets(a.row, a.contexts, *_own(b, 2, first, end)))
                again = K.in_sets(a.row, a.contexts, *_own(b, 3, first, end))
                _, once = np.unique(np.stack([a.row[wanted].astype(U), a.contexts[wanted]]), axis=1, return_index=True)
                wanted = wanted[np.sort(once)]  # surroundings that a text holds twice are one member
                raw = data.tobytes()
                spread = K.mix(K.mix(a.keys + U(1 << 41)))  # named grams have small hashes
                for i in wanted.tolist():
                    at = int(a.at[i])
                    bucket = (int(spread[i]) * buckets) >> 64
                    held.setdefault(bucket, []).append((raw[at : a.high[i]], raw[a.low[i] : at], int(a.contexts[i : i + 1].view(np.int64)[0]), bool(again[i])))
                total += len(wanted)
                if total > 20_000:
                    yield from flush()
                    total = 0
        yield from flush()

    merged = rows.mapInArrow(write_runs, RUN).groupBy("bucket").applyInArrow(_merge_runs(length), "context long, whole boolean, offsets array<int>")

    def hash_windows(ids, first, data, off, b) -> tuple:
        a = anchors(data, off, length)
        wanted = np.flatnonzero(K.in_sets(a.row, a.contexts, *_own(b, 2, first, first + len(ids))))
        reach = length - length // 2
        back = np.tile(np.arange(reach + 1), len(wanted))
        of = np.repeat(wanted, reach + 1)
        start = a.at[of] - back
        ok = (start >= a.low[of]) & (start + length <= a.high[of])
        of, back, start = of[ok], back[ok], start[ok]
        hashes = K.mix(K.range_hash(K.prefix_sums(data), start, start + length) + K.mix(a.keys[of] + back.astype(U))) if len(start) else np.zeros(0, U)
        return signed(hashes), signed(a.contexts[of]), back.astype(np.int32)

    out = merged
    if split:
        # All windows of surroundings that occur more than once do; those of the others are looked for among them too.
        held = members.join(large, "key")
        theirs = texts.join(held.groupBy("doc_id").agg(F.collect_list("context").alias("large")), "doc_id").select("doc_id", "packed", "large")
        windows = tables.write(_map(theirs, hash_windows, "window long, context long, back int").distinct())
        twice = tables.write(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"))
        several = held.where("n > 1").select("context")
        part = windows.join(twice, "window").groupBy("context").agg(F.collect_set("back").alias("offsets")).join(several, "context", "left_anti").select("context", F.lit(False).alias("whole"), "offsets")
        out = merged.unionByName(part).unionByName(several.select("context", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("offsets")))
    return tables.write(out)


def dedup_suffixes(docs: DataFrame, length: int = 200, bucket_rows: int = 8_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256 of every row.

    A byte goes if a string of so many bytes that covers it also starts anywhere else, in this text or another; strings
    are judged on the input and never cross texts. n_spans counts the maximal runs of removed bytes; kept is what
    remains, as bytes (a cut may split a character).

    A null or empty text has no bytes; a text shorter than the length keeps all. Texts that are the same byte for byte go
    whole, under whatever ids. Rows with a null doc_id take no part and keep all. Grams and surroundings are compared by
    64-bit hash, suffixes by their bytes. An empty table gives no rows; other columns are ignored.
    """
    packed, without_id = with_and_without_id(docs)

    def first_keys(ids, first, data, off, b) -> tuple:
        a = anchors(data, off, length)
        return signed(a.keys), ids[a.row].astype(np.int64)

    def surroundings(ids, first, data, off, b) -> tuple:
        a = anchors(data, off, length)
        alive = K.in_sets(a.row, a.keys, *_own(b, 2, first, first + len(ids)))
        return signed(a.keys[alive]), signed(a.contexts[alive]), ids[a.row[alive]].astype(np.int64)

    # What is joined by gram or surroundings is a table first, so that Spark can split a frequent one. Packed originals
    # are one too: a task that packs and unpacks in one stage has two Python workers.
    with Tables(docs.sparkSession) as tables:
        groups = text_groups(docs, tables)
        texts = tables.write(originals(packed, later_copies(groups)))
        rows = _map(texts, first_keys, "key long, doc_id long")
        repeated = tables.write(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
        known = rows.join(repeated, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
        around = tables.write(_map(texts.join(known, "doc_id"), surroundings, "key long, context long, doc_id long"))
        members = tables.write(around.groupBy("key", "context").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")))
        found = repeated_offsets(texts, members, length, bucket_rows, tables)
        tables.drop(texts)

        whole = around.join(found.where("whole").select("context"), "context").groupBy("doc_id").agg(F.collect_set("context").alias("whole"))
        part = members.where("n = 1").join(found.where("NOT whole"), "context").groupBy("doc_id").agg(F.collect_list("context").alias("part"), F.collect_list("offsets").alias("offsets"))
        same = groups.where("n > 1").groupBy("doc_id").agg(F.collect_set("tag").alias("same"))

    def finish(batches: Iterator[pa.RecordBatch], packed: bool = True) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            same_text = b.column(5).to_numpy(zero_copy_only=False).astype(bool)
            offsets = b.column(4)
            for first, end, data, off in K.text_pieces(unpack_texts(b.column(1), packed)):
                n = end - first
                gone = removed(data, off, length, _own(b, 2, first, end), _own(b, 3, first, end), offsets.slice(first, end - first).flatten())
                sizes = np.diff(off)
                gone |= np.repeat(same_text[first:end] & (sizes >= length), sizes)
                row = np.repeat(np.arange(n), sizes)
                starts = gone.copy()
                starts[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
                kept_data, kept = data[~gone].tobytes(), np.bincount(row[~gone], minlength=n)
                ends = np.cumsum(kept)
                parts = [kept_data[e - k : e] for e, k in zip(ends.tolist(), kept.tolist(), strict=True)]
                count = lambda mask: pa.array(np.bincount(row[mask], minlength=n).astype(np.int64))
                yield pa.record_batch(
                    [b.column(0).slice(first, n), pa.array(sizes.astype(np.int64)), count(gone), count(starts), pa.array(parts, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    out = packed.join(whole, "doc_id", "left").join(part, "doc_id", "left").join(same, "doc_id", "left")
    out = out.select("doc_id", "packed", "whole", "part", "offsets", F.coalesce(F.array_contains("same", F.col("tag")), F.lit(False)).alias("same"))
    none = F.array().cast("array<long>")
    others = without_id.select("doc_id", "packed", none.alias("whole"), none.alias("part"), F.array().cast("array<array<int>>").alias("offsets"), F.lit(False).alias("same"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return out.mapInArrow(finish, schema).unionByName(others.mapInArrow(lambda batches: finish(batches, packed=False), schema))


def removed(data: np.ndarray, off: np.ndarray, length: int, whole: tuple, part: tuple, offsets: pa.ListArray) -> np.ndarray:
    """Which bytes go: all windows around grams whose surroundings repeat, and the others found one by one."""
    edges = np.zeros(len(data) + 1, np.int32)
    if len(whole[0]) or len(part[0]):
        a = anchors(data, off, length)
        full = K.in_sets(a.row, a.contexts, *whole) & (a.high - a.low >= length)
        np.add.at(edges, a.low[full], 1)
        np.add.at(edges, a.high[full], -1)
        if len(part[0]):
            by = {(int(r), int(c)): k for k, (r, c) in enumerate(zip(*part, strict=True))}
            for i in np.flatnonzero(K.in_sets(a.row, a.contexts, *part)).tolist():
                k = by.get((int(a.row[i]), int(a.contexts[i])))
                if k is None:
                    continue
                back = offsets[k].values.to_numpy().astype(np.int64)
                np.add.at(edges, a.at[i] - back, 1)
                np.add.at(edges, a.at[i] - back + length, -1)
    return np.cumsum(edges[:-1]) > 0
