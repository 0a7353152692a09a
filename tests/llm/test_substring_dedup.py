import hashlib
import random
import re

import pytest

from palimpsest.llm.substring_dedup import dedup_substrings, level_lengths

DOCS = "doc_id long, text string, doc_id_ string, key long, keys string"


def brute(rows, n):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, ws in words:
        for p in range(len(ws) - n + 1):
            if i is not None:
                k = tuple(ws[p : p + n])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for p in range(len(ws) - n + 1):
            if i is not None and least[tuple(ws[p : p + n])] < i:
                gone |= set(range(p, p + n))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, n):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
    return sorted((tuple(r) for r in dedup_substrings(df, n).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def corpus(seed, docs=60):
    r = random.Random(seed)
    vocab = ["the", "of", "Été", "ab", "x", " y", "long" * 9, "\U0001f600"]
    passages = [[r.choice(vocab) for _ in range(r.randrange(5, 60))] for _ in range(6)]
    out = []
    for i in range(docs):
        ws = []
        for _ in range(r.randrange(0, 5)):
            ws += r.choice(passages) if r.random() < 0.4 else [r.choice(vocab) + str(r.randrange(50)) for _ in range(r.randrange(0, 30))]
        out.append((i - 3, r.choice([" ", "\n\t", "  "]).join(ws)))
    out += [(500, None), (501, ""), (502, " \n"), (None, out[5][1]), (None, None), out[7], (503, out[9][1]), (504, " ".join(["a"] * 40)), (505, " ".join(["a"] * 20))]
    out += [(600, " ".join(f"w{k % 5000}" for k in range(20000))), (601, " ".join(f"w{k}" for k in range(4000, 4400)))]
    return out


@pytest.mark.parametrize("n", [13, 5, 1, 30])
def test_against_brute_force(spark, n):
    rows = corpus(n)
    assert run(spark, rows, n) == brute(rows, n)


def test_empty_table(spark):
    assert run(spark, [], 13) == []


def test_lengths_double():
    assert level_lengths(13) == [6, 12, 13] and level_lengths(50) == [6, 12, 24, 48, 50] and level_lengths(24) == [6, 12, 24] and level_lengths(3) == [2, 3] and level_lengths(1) == [1, 1]


def test_windows_that_very_many_share(spark):
    r = random.Random(12)
    line = [f"c{i}" for i in range(20)]
    rows = [(i, " ".join([f"u{r.randrange(10**6)}" for _ in range(r.randrange(3, 9))] + (line if i % 3 else []) + [f"u{r.randrange(10**6)}"])) for i in range(400)]
    assert run(spark, rows, 13) == brute(rows, 13)
