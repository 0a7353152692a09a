import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, tokens long, block string, weight int"


def corpus():
    rows = [(i, "big" if i % 3 else f"s{i % 7}", "w " * (1 + i % 11)) for i in range(600)]
    rows += [(1000, None, "a b c"), (1001, "void", None), (1002, "void", " \n"), (7, "big", "w w"), (7, "big", "w w"), (None, "s1", "x y")]
    rows += [(2000, "long", "y " * 5000)]
    return [(*r, 1, "b", 2) for r in rows]


def brute_exponent(shares, goal):
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        z = sum(p**a for p in shares)
        if -sum(p**a / z * math.log(p**a / z) for p in shares) >= goal:
            low = a
        else:
            high = a
    return low


@pytest.mark.parametrize("kind", [{"target_entropy": 0.9}, {"target_entropy": None, "max_repetition": 3.0}, {"target_entropy": 0.9, "budget": 700}])
def test_weights_quotas_and_permutations(spark, kind):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.mix_sources(df, block_docs=16, **kind).collect()
    tokens, copies = defaultdict(int), Counter()
    for i, s, t, *_ in rows:
        n = len((t or "").split())
        tokens[s or ""] += n
        copies[i, s or "", n] += 1
    tokens.pop("void")
    total = sum(tokens.values())
    budget = kind.get("budget") or total
    weight, used, most = {}, defaultdict(int), defaultdict(int)
    times = Counter()
    for r in out:
        weight[r["source"]] = r["weight"]
        used[r["source"]] += r["n_tokens"]
        times[r["doc_id"], r["source"], r["n_tokens"], r["epoch"]] += 1
        assert 0 <= r["position"] <= 1
    shares = {s: n / total for s, n in tokens.items()}
    if kind.get("target_entropy"):
        a = brute_exponent(list(shares.values()), kind["target_entropy"] * math.log(len(shares)))
        z = sum(p**a for p in shares.values())
        expect = {s: p**a / z for s, p in shares.items()}
        assert len(weight) >= 8 and all(weight[s] == pytest.approx(expect[s], rel=1e-5) for s in weight)
    else:
        assert max(weight[s] * budget / tokens[s] for s in weight) <= 3.0 + 1e-6
        expect = defaultdict(float, weight)
    for (i, s, t, *_) in rows:
        most[s or ""] = max(most[s or ""], len((t or "").split()))
    for s in tokens:
        quota = math.floor(budget * expect[s] + 1e-9)
        assert quota - most[s] <= used[s] <= quota + 1
    full = {s: int(used[s] // tokens[s]) for s in used}
    for (i, s, n), c in copies.items():
        for e in range(full.get(s, 0) if used[s] > full.get(s, 0) * tokens[s] else 0):
            assert times[i, s, n, e] == c


def signed_hash(spark, rows, columns):
    """Spark's hash of each row, by which the permutation orders."""
    kinds = ", ".join(f"c{i} {k}" for i, k in enumerate(columns))
    df = spark.createDataFrame(rows, kinds)
    return [r[0] for r in df.select(F.xxhash64(*df.columns)).collect()]


@pytest.mark.parametrize("kind", [{"target_entropy": 0.9}, {"target_entropy": 0.97, "budget": 1500}])
def test_the_permutation_against_plain_python(spark, kind):
    rows = [*corpus(), *[(7777, "big", "t t t", 1, "b", 2)] * 200]  # equal rows, many times a block
    out = M.mix_sources(spark.createDataFrame(rows, SCHEMA), block_docs=16, seed=7, **kind).collect()
    counts = Counter((i, s or "", len((t or "").split())) for i, s, t, *_ in rows)
    weight = {r["source"]: r["weight"] for r in out}
    tokens, distinct = Counter(), Counter()
    for (_, s, n), c in counts.items():
        tokens[s] += n * c
        distinct[s] += 1
    budget = kind.get("budget") or sum(tokens.values())
    expect = Counter()
    keys = list(counts)
    into = signed_hash(spark, [(7, i, n) for i, _, n in keys], ["int", "long", "long"])
    for s in weight:
        blocks = defaultdict(list)
        for (i, src, n), h in zip(keys, into, strict=True):
            if src == s:
                blocks[h % -(-distinct[s] // 16)].append((i, n))
        quota = math.floor(budget * weight[s])
        full = quota // tokens[s]
        for e in range(full + 1):
            left, at = tokens[s] if e < full else quota - full * tokens[s], 0
            order = sorted(zip(signed_hash(spark, [(7, s, b, e) for b in blocks], ["int", "string", "long", "long"]), blocks, strict=True))
            for _, b in order:
                if at > left or (at == left and e == full):
                    break
                inside = signed_hash(spark, [(7, i, e) for i, _ in blocks[b]], ["int", "long", "long"])
                for _, i, n in sorted(((h, i, n) for h, (i, n) in zip(inside, blocks[b], strict=True)), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
                    for _ in range(counts[i, s, n]):
                        if at + n <= left:
                            expect[i, s, n, e, b, round(((e * tokens[s]) + at) / max(quota, 1), 9)] += 1
                        at += n
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], r["epoch"], r["block"], round(r["position"], 9)) for r in out) == expect


def test_empty_and_bad(spark):
    assert M.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        M.mix_sources(spark.createDataFrame([], SCHEMA), target_entropy=None)
