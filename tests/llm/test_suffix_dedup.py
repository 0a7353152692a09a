import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.checkpoints import Tables
from palimpsest.llm.suffix_dedup import dedup_suffixes
from palimpsest.llm.suffix_runs import common_prefix, decode, front_code, merge


def brute(rows, n):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for i, b in data:
        if i is not None:
            for p in range(len(b) - n + 1):
                count[b[p : p + n]] = count.get(b[p : p + n], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - n + 1):
                if count[b[p : p + n]] > 1:
                    gone[p : p + n] = b"\x01" * n
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, n, **more):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, key string, tag int, keys string")
    return sorted((tuple(r) for r in dedup_suffixes(df, n, **more).drop("kept").collect()), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    letters = "abcdefgh é\U0001f600"
    noise = lambda k: "".join(r.choice(letters) for _ in range(k))
    passages = [noise(r.randrange(n // 2, 3 * n)) for _ in range(8)]
    rows = []
    for i in range(90):
        t = ""
        for _ in range(r.randrange(0, 5)):
            p = list(r.choice(passages))
            if r.random() < 0.5:
                p[r.randrange(len(p))] = "Z"
            t += "".join(p) if r.random() < 0.6 else noise(r.randrange(n))
        rows.append((i - 4, t))
    rows += [(500, None), (501, ""), (502, "q" * (3 * n)), (503, "ab" * n), (None, rows[5][1]), (None, None), rows[8], (504, rows[9][1]), (505, "p" * n), (506, "p" * n), (507, noise(30 * n))]
    return rows


@pytest.mark.parametrize("n,more", [(200, {}), (20, {}), (20, {"bucket_rows": 3}), (41, {})])
def test_against_brute_force(spark, n, more):
    rows = corpus(n, n)
    assert run(spark, rows, n, **more) == brute(rows, n)


def test_empty_table(spark):
    assert run(spark, [], 200) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=5).map(lambda b: bytes(x % 3 for x in b))), max_size=6))
def test_merge_of_front_coded_runs(runs):
    runs = [sorted(r) for r in runs]
    coded = [front_code(r) for r in runs]
    assert [[s for _, s in decode(c)] for c in coded] == runs
    out = list(merge(coded))
    assert [s for _, _, s in out] == sorted(s for r in runs for s in r)
    assert all(n == common_prefix(a[2], b) for a, (_, n, b) in zip(out, out[1:]))


def test_no_task_packs_and_unpacks(spark, monkeypatch):
    plans, write = [], Tables.write

    def seen(tables, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(tables, df)

    monkeypatch.setattr(Tables, "write", seen)
    rows = [(1, "a" * 300), (2, "b" * 90 + "a" * 250), (3, "b" * 90), (None, "a" * 250), (4, None)]
    got = dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 300, 2: 250, 3: 0, None: 0, 4: 0}
    assert any("MapInArrow pack(" in p for p in plans)
    assert not any("MapInArrow pack(" in p and "MapInArrow run(" in p for p in plans)  # that takes two Python workers
