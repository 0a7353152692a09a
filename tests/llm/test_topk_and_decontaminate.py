import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, topk_search


def brute_top(rows, k):
    fine = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in fine if i % 100 == 0}):
        best = {}
        for a in (v for i, v in fine if i == q):
            for j, b in fine:
                if j != q and len(a) == len(b):
                    score = sum(x * y for x, y in zip(a, b, strict=True))
                    best[j] = max(best.get(j, score), score)
        out += [(q, n + 1, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + r.choice([0.0, 0.0, r.uniform(-0.1, 0.1)]) for x in r.choice(base)]) for i in range(500)]
    rows += [rows[7], (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.inf] * 6), (903, [math.nan] * 6), (None, base[0]), (1000, [0.5, 0.5]), (1001, [0.25, -1.0]), (100, base[1]), (1100, [])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = sorted(tuple(x) for x in topk_search.top_k(df, F.col("vec_id") % 100 == 0, row_block=128, query_block=2).collect())
    assert got == brute_top(rows, 10)


def test_ids_with_several_vectors_among_the_candidates(spark):
    rows = [(0, [1.0, 0.0])] + [(5, [9.0 - i, 0.0]) for i in range(3)] + [(6, [5.0, 1.0]), (7, [4.0, 0.0]), (8, [4.0, 7.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in topk_search.top_k(df, F.col("vec_id") == 0, k=3).collect()) == [x for x in brute_top(rows, 3) if x[0] == 0]


def test_scores_beyond_a_long_keep_their_order(spark):
    big = 2.0**52
    rows = [(0, [big, big])] + [(i, [big + 64 * ((i * 7) % 5), big - 64 * (i % 3)]) for i in range(1, 12)] + [(20, [-big, -big])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in topk_search.top_k(df, F.col("vec_id") == 0, k=12).orderBy("rank").collect()]
    expect = [x for x in brute_top(rows, 12) if x[0] == 0]
    assert [x[:3] for x in got] == [x[:3] for x in expect]
    assert all(a[3] == max(-(2**63), min(2**63 - 1, b[3])) for a, b in zip(got, expect, strict=True))


def test_pivots_eliminate_rows_and_clusters(spark):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (8, 12)) * 40
    x = np.floor(1024 * (centres[r.integers(0, 8, 4000)] + r.normal(0, 0.3, (4000, 12)))).astype(np.int64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<long>").withColumn("asks", F.col("vec_id") % 100 == 0)
    points = topk_search.choose_pivots(df.select("vec_id", "vec"), 24, 1024)
    placed = topk_search.place(df, points).cache()
    far = np.array([v["far"] for v in placed.orderBy("vec_id").select("far").collect()])
    ids = np.arange(4000)
    found, taken = topk_search.search_block(x[::100], ids[::100], far[::100], np.full(40, -np.inf), x, ids, far, 10)
    assert taken < 0.5 * 40 * 4000
    products = x[::100] @ x.T
    for q in range(40):
        order = sorted((-int(s), i) for i, s in enumerate(products[q]) if i != 100 * q)[:10]
        assert [(-s, i) for s, i in order] == [(s, i) for a, i, s in found if a == 100 * q]
    summary = topk_search._summaries(placed, 24)
    least = F.lit(float(np.sort(products, axis=1)[:, -11].min()))
    aimed = topk_search.targets(placed.where("asks").withColumn("least", least), summary, 24).count()
    assert 40 <= aimed < 0.9 * 40 * len(summary)


def test_top_k_of_nothing(spark):
    assert topk_search.search_digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


ITEM = "seven brave turtles crossed that wide river before the early morning light arrived quietly"


def test_reordered_passages_are_found(spark):
    words = ITEM.split()
    filler = "we walked to town and bought bread for everyone there".split()
    docs = [
        (1, " ".join(filler + words + filler)),
        (2, " ".join(words[7:] + filler + words[:7])),
        (3, " ".join(words[:6] + filler)),
        (4, " ".join(filler * 30)),
        (5, ITEM.upper().replace(" ", ", ")),
        (6, None),
        (7, ""),
        (8, " ".join(filler * 20000 + words)),
        (None, ITEM),
        (1, " ".join(filler + words + filler)),
    ]
    schema = "doc_id long, text string, item_id int, coverage string"
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], schema)
    bench = spark.createDataFrame([(10, ITEM, "x"), (11, None, "x"), (12, "four words are few", "x"), (None, ITEM, "x"), (13, "", "x")], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"], r["item_id"], r["n_matched"], r["n_tiles"]) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(1, 10, 14, 1), (1, 10, 14, 1), (2, 10, 14, 2), (5, 10, 14, 1), (8, 10, 14, 1)]
    assert sorted((r["doc_id"], r["item_id"], r["n_matched"], r["n_tiles"]) for r in decontaminate.contaminated(df, bench, most_chars=0).collect()) == got
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "6", "7"]
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(df, bench, most_chars=0).collect()) == ["3", "4", "6", "7"]


def test_nothing_to_compare(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).collect() == []
    some = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert decontaminate.contaminated(some, bench).collect() == [] and decontaminate.clean(some, bench).count() == 1


def fold(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).split()


def brute_tiles(doc, item, least):
    """Greedy tiling by trying every pair of positions again and again."""
    least, used_i, used_j, tiles = min(least, len(item)), set(), set(), []
    while item:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_j:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            break
        n, i, j = best
        used_i |= set(range(i, i + n))
        used_j |= set(range(j, j + n))
        tiles.append(best)
    return tiles


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_tiles_against_brute_force(spark, threshold):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    common = [r.choice(vocab) for _ in range(8)]  # a passage, and so its seeds, that many items share
    items = [[r.choice(vocab) for _ in range(r.randrange(1, 20))] + (common if k % 2 else []) + [r.choice(vocab) for _ in range(r.randrange(0, 9))] for k in range(24)]
    items += [["w1"] * 12, ["w1", "w2"] * 6, items[3], common, ["lone"], ["lone", "pair"]]
    docs = []
    for _ in range(40):
        parts = [r.choice(items) for _ in range(3)]
        cut = [p[a : a + r.randrange(1, 15)] for p in parts for a in (r.randrange(len(p)),)]
        docs.append([w for p in cut + [[r.choice(vocab) for _ in range(6)]] for w in p])
    docs += [["w1"] * 40, ["lone", "pair"], common * 3, []]
    expect = []
    for d, doc in enumerate(docs):
        for k, item in enumerate(items):
            tiles = brute_tiles(doc, item, 5)
            matched = sum(n for n, *_ in tiles)
            if matched and matched >= threshold * len(item):
                expect.append((d, k, len(item), matched, len(tiles)))
    df = spark.createDataFrame([(d, "; ".join(doc)) for d, doc in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x).upper()) for k, x in enumerate(items)], "item_id long, text string")
    for most in (16_000_000, 0):
        got = sorted(tuple(x)[:5] for x in decontaminate.contaminated(df, bench, threshold, most_chars=most).collect())
        assert got == sorted(expect)
        bad = {d for d, _, n, *_ in expect if n >= 5}
        assert sorted(x["doc_id"] for x in decontaminate.clean(df, bench, threshold, most_chars=most).collect()) == [d for d in range(len(docs)) if d not in bad]


def test_frequent_seeds_are_spared_but_no_find(spark):
    items = decontaminate.Items([0, 1], [np.arange(20, dtype=np.uint64), np.append(np.arange(10, dtype=np.uint64), np.arange(100, 110, dtype=np.uint64))], 5, 0.5)
    keys, item = items.seeds[5]
    assert [(item == k).sum() for k in (0, 1)] == [15, 15]  # of 16 seeds one, and that a shared one
    assert decontaminate.spare_seeds(20, 5, 0.5) == 1 and decontaminate.spare_seeds(60, 5, 0.5) == 5 and decontaminate.spare_seeds(3, 5, 0.5) == 0
