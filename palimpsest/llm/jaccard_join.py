"""Documents linked by the Jaccard similarity of their word shingles, with set-relation skipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm import kernels as K
from palimpsest.llm.checkpoints import Tables
from palimpsest.llm.components import components
from palimpsest.llm.packed import frequent_keys, later_copies, longs, map_packed, originals, pack_texts, small_batches, text_groups, unpack_texts, unpacked

HEAVY = 262_144  # so many keys (4 MB with their counts) at most are ordered by frequency; the order bears on speed alone


def shingle_sets(w: K.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key), sorted, of the distinct shingles; a text of fewer words is one shingle."""
    grams = K.ngrams(w.hashes, n)
    ok = K.same_row(w.row, n)
    row, keys = [w.row[: len(ok)][ok]], [grams[ok]]
    counts = np.bincount(w.row, minlength=w.end - w.first)
    starts = w.word_offsets()
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            g = K.ngrams(w.hashes, size)
            row.append(short)
            keys.append(g[starts[short]] ^ np.uint64(size))
    return K.distinct_pairs(np.concatenate(row), np.concatenate(keys))


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """100 * i >= percent * (a + b - i), solved for the whole number i."""
    return F.ceil((a + b) * percent / (100 + percent))


def _heavy_keys(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, rarest first, and their counts."""
    return frequent_keys(texts, lambda w: shingle_sets(w, n)[1], HEAVY, lower=True)


def _prefix_rows(texts: DataFrame, n: int, percent: int, heavy: tuple[np.ndarray, np.ndarray], list_block: int) -> DataFrame:
    """(key, doc_id, at, parts): the first shingles of each set in the global order; at holds the set's size and the position.

    parts tells into how many parts the list of a frequent key is dealt; it is the same in all rows of the key.
    """
    sorted_at = np.argsort(heavy[0])
    sorted_heavy, blocks = heavy[0][sorted_at], -(-heavy[1] // list_block)

    def f(ids, w, _):
        row, keys = shingle_sets(w, n)
        rank = np.zeros(len(keys), np.int64)
        if len(sorted_heavy):
            at = np.minimum(np.searchsorted(sorted_heavy, keys), len(sorted_heavy) - 1)
            rank = np.where(sorted_heavy[at] == keys, sorted_at[at] + 1, 0)
        order = np.lexsort((keys, rank, row))
        row, keys, rank = row[order], keys[order], rank[order]
        sizes = np.bincount(row, minlength=w.end - w.first)
        first = np.cumsum(sizes) - sizes
        position = np.arange(len(row)) - first[row]
        size = sizes[row]
        take = position < size - -(-size * percent // 100) + 1
        parts = np.append(1, blocks)[rank[take]]
        return longs(keys[take]), ids[row[take]].astype(np.int64), (size[take].astype(np.int64) << 32) | position[take], parts.astype(np.int64)

    return map_packed(texts, f, "key long, doc_id long, at long, parts long", lower=True)


def parity_bits(row: np.ndarray, keys: np.ndarray, rows: int) -> list[bytes]:
    """Of each set, so many bits (a power of two, from the set's size up) as keys flip, each the one its low bits name.

    Sets whose bits differ in d places differ in d keys at least; half as many bits come of a longer string by xor of its halves.
    """
    widths = np.left_shift(1, np.ceil(np.log2(np.maximum(np.bincount(row, minlength=rows), 64))).astype(np.int64))
    ends = np.cumsum(widths)
    at = (ends - widths)[row] + (keys & (widths - 1).astype(np.uint64)[row]).astype(np.int64)
    data = np.packbits(np.bincount(at, minlength=int(ends[-1])).astype(np.uint8) & 1).tobytes() if rows else b""
    return [data[e - n : e] for e, n in zip((ends // 8).tolist(), (widths // 8).tolist(), strict=True)]


def _sizes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, tag, n_shingles, bits) of rows with their unpacked texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            for w in K.words(unpack_texts(b.column(2), packed=False), lower=True):
                m = w.end - w.first
                row, keys = shingle_sets(w, n)
                bits = pa.array(parity_bits(row, keys, m), pa.binary())
                yield pa.record_batch([b.column(0).slice(w.first, m), b.column(1).slice(w.first, m), pa.array(np.bincount(row, minlength=m).astype(np.int64)), bits], ["doc_id", "tag", "n_shingles", "bits"])

    return docs.select("doc_id", "tag", "packed").mapInArrow(run, "doc_id long, tag long, n_shingles long, bits binary")


def least_difference(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many keys two sets differ in at least, by their parity bits, for each pair."""
    sizes_a, sizes_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.zeros(len(a), np.int64)
    for m, k in np.unique(np.stack([sizes_a, sizes_b], 1), axis=0).tolist():
        at = np.flatnonzero((sizes_a == m) & (sizes_b == k))
        x, y = (np.frombuffer(b"".join(z[i] for i in at.tolist()), np.uint64).reshape(len(at), -1) for z in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


def possible(pairs: DataFrame, sketches: DataFrame, percent: int, with_sizes: bool = False) -> DataFrame:
    """The pairs (a, b) that sizes and parity bits do not rule out, on demand with the sizes n_a and n_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4096):
            x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            most = (x + y - least_difference(b.column(3).to_pylist(), b.column(5).to_pylist())) // 2
            ok = pa.array(most >= -(-(x + y) * percent // (100 + percent)))
            yield pa.record_batch([b.column(i).filter(ok) for i in (0, 1, 2, 4)], ["a", "b", "n_a", "n_b"])

    side = lambda c: sketches.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(near)
    left = rows.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long, n_a long, n_b long").distinct()
    return left if with_sizes else left.select("a", "b")


def overlaps(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, size_a, size_b, overlap) of pairs (a, b) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            sets = []
            for c in (2, 3):
                column = []
                for w in K.words(unpack_texts(batch.column(c)), lower=True):
                    row, keys = shingle_sets(w, n)
                    column += np.split(keys, np.searchsorted(row, np.arange(1, w.end - w.first)))
                sets.append(column)
            out = np.array([(len(x), len(y), len(np.intersect1d(x, y, True))) for x, y in zip(*sets, strict=True)], np.int64).reshape(-1, 3)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(out[:, i]) for i in range(3))], ["a", "b", "size_a", "size_b", "overlap"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("packed_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("packed_b"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "packed_a", "packed_b")
    return rows.mapInArrow(run, "a long, b long, size_a long, size_b long, overlap long")


def _list_pairs(percent: int, rows_at_once: int = 100_000, pairs_at_once: int = 131_072):
    """Pairs of each index list: its rows, sorted, in blocks of one component, size and position; blocks that cannot reach the overlap are skipped whole."""

    def ranges(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, number from 0) for counts[i] numbers of each i, at most pairs_at_once together; those of one i may be divided."""
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        for at in range(0, total, pairs_at_once):
            n = np.arange(at, min(at + pairs_at_once, total))
            of = np.searchsorted(ends, n, "right")
            yield of, n - (ends - counts)[of]

    def changes(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(columns[0]), bool)
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def pairs(group: np.ndarray, root: np.ndarray, at: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
        first = changes(group, root, at)
        counts = np.diff(np.append(first, len(doc)))
        group, root, size, position = group[first], root[first], at[first] >> 32, at[first] & 0xFFFFFFFF
        end = lambda starts: np.repeat(np.append(starts[1:], len(first)), np.diff(np.append(starts, len(first))))
        after_root, after_list = end(changes(group, root)), end(changes(group))
        for i, k in ranges(after_list - after_root):
            j = after_root[i] + k
            room = 1 + np.minimum(size[i] - position[i] - 1, size[j] - position[j] - 1)
            fits = room >= -(-(size[i] + size[j]) * percent // (100 + percent))
            i, j = i[fits], j[fits]
            for of, n in ranges(counts[i] * counts[j]):
                x, y = doc[first[i[of]] + n // counts[j[of]]], doc[first[j[of]] + n % counts[j[of]]]
                yield np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def search(m: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = np.zeros(len(m), np.int64)
            group[changes(m[:, 0], m[:, 1], m[:, 2])] = 1
            for p in pairs(np.cumsum(group), m[:, 3], m[:, 4], m[:, 5]):
                yield pa.record_batch([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1))
            if sum(map(len, held)) >= rows_at_once:
                m = np.concatenate(held)
                last = int(changes(m[:, 0], m[:, 1], m[:, 2])[-1])  # the last list may go on
                held = [m[last:]]
                if last:
                    yield from search(m[:last])
        if held:
            yield from search(np.concatenate(held))

    return run


def derive(pairs: DataFrame, near: DataFrame, texts: DataFrame, n: int, percent: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Of pairs (a, b): (a, b, alike) of those whose answer follows from answers that are known, and (a, b) of the others.

    near has (a, b, size_a, size_b, overlap): b's leader a and how much they share. Let p and q be the leaders of a and b (or a
    and b themselves). Then a and b share at most what p and q share (or a with p, or b with q, if that is less) and
    what each lacks of its leader, and at least what p and q share less what these lack of a and b. If p is q, what it shares with itself
    is known; if several pairs have the same two leaders, these are compared once for all of them.
    """
    once = near.groupBy("b").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("a", "overlap", "size_b", "size_a"))).where("n = 1")  # an id with several texts leads and follows nowhere
    leader = once.select(F.col("b").alias("doc"), F.col("a").alias("l"), F.col("overlap").alias("o"), F.col("size_b").alias("s"), F.col("size_a").alias("z"))
    for side in ("a", "b"):
        pairs = pairs.join(leader.select(F.col("doc").alias(side), *(F.col(c).alias(f"{c}{side}") for c in "losz")), side, "left")
    sizes = lambda x: [F.coalesce(f"{c}{x}", f"n_{x}").alias(f"{c}{x}") for c in "osz"]
    led = tables.write(pairs.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"), *sizes("a"), *sizes("b")).withColumns({"lo": F.least("la", "lb"), "hi": F.greatest("la", "lb")}))
    asked = led.where("lo < hi AND (la <> a OR lb <> b)").groupBy("lo", "hi").agg(F.count("*").alias("n")).where("n > 1").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    known = tables.write(overlaps(asked, texts, n).groupBy(F.col("a").alias("lo"), F.col("b").alias("hi")).agg(F.count("*").alias("n"), F.max("overlap").alias("between")).where("n = 1").drop("n"))
    between = F.coalesce("between", F.when(F.col("la") == F.col("lb"), F.col("za")))
    most = F.least(between, "oa", "ob") + F.col("sa") - F.col("oa") + F.col("sb") - F.col("ob")
    most = F.when(F.col("la") == F.col("lb"), F.least("oa", "ob") + F.least(F.col("sa") - F.col("oa"), F.col("sb") - F.col("ob"))).otherwise(most)
    fewest = between - (F.col("za") - F.col("oa")) - (F.col("zb") - F.col("ob"))
    need = least_overlap(F.col("sa"), F.col("sb"), percent)
    said = F.when(fewest >= need, True).when(most < need, False)
    judged = tables.write(led.join(known, ["lo", "hi"], "left").select("a", "b", said.alias("alike")))
    tables.drop(led, known)
    return judged.where("alike IS NOT NULL"), judged.where("alike IS NULL").select("a", "b").distinct()


def links(texts: DataFrame, sketches: DataFrame, n: int, percent: int, tables: Tables, list_block: int = 4096) -> DataFrame:
    """(u, v): similar pairs of texts, enough of them to connect whatever is connected.

    sketches: (doc_id, n_shingles, bits) of the texts. The result needs the tables that are written on the way.
    """
    rows = _prefix_rows(texts, n, percent, _heavy_keys(texts, n), list_block).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    of_part = Window.partitionBy("key", "part")
    lists = tables.write(rows.select("*", F.count("*").over(of_part).alias("n"), F.min("doc_id").over(of_part).alias("head")).where("n > 1 OR parts > 1").drop("n"))

    # First each set is compared with one other: the head of most of its lists.
    votes = lists.where("doc_id > head").groupBy("doc_id", "head").agg(F.count("*").alias("n"), F.max(F.shiftright("at", 32)).alias("size"))
    chosen = votes.where("n * 20 >= size").groupBy("doc_id").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"))
    near = tables.write(overlaps(possible(chosen.select(F.col("head").alias("a"), F.col("doc_id").alias("b")), sketches, percent), texts, n))
    alike = F.col("overlap") >= least_overlap(F.col("size_a"), F.col("size_b"), percent)
    # A set's head is smaller, so heads form trees; where a head has one itself, it is followed, twice.
    up = near.where(alike).select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(2):
        up = tables.write(up.join(up.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root")))

    # Then lists are searched for pairs across trees only. What a key's parts hold is aggregated before they meet.
    owned = lists.join(up.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "part", "parts", "doc_id", "at", F.coalesce("root", "doc_id").alias("root"))
    one = owned.where("parts = 1").select("*", F.min("root").over(of_part).alias("low"), F.max("root").over(of_part).alias("high"), F.count("*").over(of_part).alias("n")).where("low < high")
    one = one.withColumn("parts", F.ceil(F.col("n") / list_block).cast("long"))
    many = owned.where("parts > 1")
    wide = tables.write(many.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"))
    mixed = one.select("key", "parts", "doc_id", "at", "root").unionByName(many.join(wide, "key").select("key", "parts", "doc_id", "at", "root"))
    own = F.pmod(F.xxhash64("doc_id"), "parts")
    dealt = mixed.select("key", "root", "at", "doc_id", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "root", "at", "doc_id")
    sorted_lists = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "root", "at")
    pairs = possible(sorted_lists.mapInArrow(_list_pairs(percent), "a long, b long").distinct(), sketches, percent, with_sizes=True)

    told, open_ = derive(pairs, near, texts, n, percent, tables)
    more = told.where("alike").select(F.col("a").alias("u"), F.col("b").alias("v"))
    compared = overlaps(open_, texts, n).where(alike).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return up.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more).unionByName(compared)


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A-Z are lowered; words are runs of bytes other than 0x20 and 0x09-0x0D; a text's set holds its distinct shingles of n
    words, or the whole text if it has fewer. Two texts link when 100 * |intersection| >= percent * |union|; a component
    is what links connect, named by its smallest doc_id. Texts that are the same byte for byte are one node.

    Null, empty or blank text: no shingles, linked with nothing, not even its like. Rows with a null doc_id take no part:
    their component is null. Rows that share a doc_id are one node. An empty table gives no rows; other columns are
    ignored. Shingles are compared by 64-bit hash.
    """
    with Tables(docs.sparkSession) as tables:
        groups = text_groups(docs, tables)
        sizes = tables.write(_sizes(unpacked(docs), n))
        some = sizes.where("doc_id IS NOT NULL AND n_shingles > 0")
        same = groups.where("doc_id > least").join(some, ["doc_id", "tag"], "left_semi").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))

        # The texts are dealt by document once, for all joins; what is kept on a lost executor's disk is made anew.
        dealt = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        packed = pack_texts(docs.where("doc_id IS NOT NULL")).repartition(dealt, "doc_id").persist(StorageLevel.DISK_ONLY)
        found = links(originals(packed, later_copies(groups)), some.select("doc_id", "n_shingles", "bits").distinct(), n, percent, tables)
        roots = components(found.unionByName(same), tables)
        packed.unpersist()
        return sizes.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns: of each component the one with the smallest doc_id.

    Of rows that share a doc_id the first in order of their columns stays (maps do not count); rows with a null doc_id stay.
    """
    first = jaccard_classes(docs.select("doc_id", "text"), n, percent).where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString()))
    kept = docs.where("doc_id IS NOT NULL").withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_").join(first, "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)
