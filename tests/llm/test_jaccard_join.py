import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from palimpsest.llm import jaccard_join
from palimpsest.llm.checkpoints import Tables
from palimpsest.llm.components import components
from palimpsest.llm.jaccard_join import jaccard_classes
from palimpsest.llm.packed import pack_texts, repeated_keys


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(x), None if i is None else find(i)) for i, x in sets), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, key string, tag int, root string")
    return sorted((tuple(r) for r in jaccard_classes(df).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "\U0001f600", "THE"]
    passage = [r.choice(vocab) for _ in range(20)]
    bases = [[r.choice(vocab) for _ in range(r.randrange(8, 90))] for _ in range(12)] + [passage + [r.choice(vocab) for _ in range(r.randrange(1, 8))] for _ in range(25)]
    out = []
    for _ in range(220):
        w = list(r.choice(bases))
        for _ in range(r.randrange(0, 1 + len(w) // 20)):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = w + [r.choice(vocab) for _ in range(r.randrange(6))]
        out.append((len(out) - 5, r.choice([" ", "\n"]).join(w)))
    out += [(900, None), (901, ""), (902, " \t"), (903, ""), (904, "one two"), (905, "ONE two"), (906, "one"), (None, out[3][1]), (None, None), out[8], (907, out[9][1])]
    return out + [(950, " ".join(f"x{k}" for k in range(20000))), (951, " ".join(f"x{k}" for k in range(2000, 20000)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    with Tables(spark) as tables:
        got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "u long, v long"), tables).collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_answers_are_derived_both_ways(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(4000)]
    base = [r.choice(vocab) for _ in range(400)]
    other = base[:330] + [r.choice(vocab) for _ in range(70)]  # some 0.70 alike
    third = base[:350] + [r.choice(vocab) for _ in range(50)]  # some 0.77 alike
    rows = []
    for source in (base, other, third):
        for _ in range(6):
            w = list(source)
            w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    leader = {i: 6 * (i // 6) for i in range(18)}
    near = [(leader[i], i, len(sets[leader[i]]), len(sets[i]), len(sets[i] & sets[leader[i]])) for i in range(18) if i != leader[i]]
    pairs = [(i, j, len(sets[i]), len(sets[j])) for i in range(18) for j in range(i + 1, 18)]
    texts = pack_texts(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "packed")
    with Tables(spark) as tables:
        told, open_ = jaccard_join.derive(spark.createDataFrame(pairs, "a long, b long, n_a long, n_b long"), spark.createDataFrame(near, "a long, b long, size_a long, size_b long, overlap long"), texts, 5, 75, tables)
        told, open_ = [tuple(x) for x in told.collect()], [tuple(x) for x in open_.collect()]
    assert {(a, b) for a, b, _ in told} | set(open_) == {(i, j) for i, j, _, _ in pairs} and len(told) + len(open_) == len(pairs)
    assert all(alike == (100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])) for a, b, alike in told)
    assert sum(alike for *_, alike in told) > 20 and sum(not alike for *_, alike in told) > 20


def test_pairs_of_two_large_blocks_are_made_in_bounded_pieces():
    n, at = 700, (20 << 32)
    rows = [(5, 0, 0, root, at, 10 * i + root) for root in (1, 2) for i in range(n)] + [(6, 0, 0, 3, at, 3)]
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "x", "y", "root", "at", "doc_id"])
    out = list(jaccard_join._list_pairs(75)(iter([batch])))
    assert max(b.num_rows for b in out) <= 131_072  # was n * n
    found = [p for b in out for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(found) == n * n and set(found) == {(min(x, y), max(x, y)) for x in range(1, 10 * n, 10) for y in range(2, 10 * n, 10)}


def test_repeated_keys_are_counted_without_many_copies():
    keys = np.random.default_rng(1).integers(0, 400_000, 1_000_000).astype(np.uint64)
    every, counts = np.unique(keys, return_counts=True)
    for least in (1, 3):
        parts = [keys[:10].copy(), keys[10:].copy()]
        tracemalloc.start()
        found, n = repeated_keys(parts, least)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (found == every[counts >= least]).all() and (n == counts[counts >= least]).all() and parts == []
        assert most < 3 * keys.nbytes
    assert [len(x) for x in repeated_keys([keys[:2]], 3)] == [0, 0]


def test_lists_of_frequent_keys_are_dealt_in_parts(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    common = "this very common line stands in a third of all texts".split()
    rows = [(i, " ".join(common + [r.choice(vocab) for _ in range(4 if i % 2 else 40)])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    texts = pack_texts(df).select("doc_id", "packed")
    keys, counts = jaccard_join._heavy_keys(texts, 5)
    assert counts.max() >= 300 and (counts[:-1] <= counts[1:]).all()
    with Tables(spark) as tables:
        sizes = jaccard_join._sizes(df.select("doc_id", F.lit(0).cast("long").alias("tag"), F.col("text").cast("binary").alias("packed")), 5)
        found = jaccard_join.links(texts, sizes.select("doc_id", "n_shingles", "bits"), 5, 75, tables, list_block=16)
        roots = dict(tuple(x) for x in components(found, tables).collect())
    assert {(i, roots.get(i, i)) for i, _ in rows} == {(i, root) for i, _, root in brute(rows)}
