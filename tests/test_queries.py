"""Every query that has SQL gives the same rows in the second engine."""

import math
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import compaction, frames, metrics, runs, segments
from palimpsest.plans import registry
from palimpsest.sources import results

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


def plain(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    told = duck.execute(registry.ORACLE_SQL[name])
    at = [d[0] for d in told.description]
    assert sorted(at) == columns
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in told.fetchall()), key=str)


def test_only_frames_have_no_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"crc32_frames", "frame_decode"}


def number(data, at=0):
    """(value, next place) of a varint."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def frame_of(key, seq, op, value):
    sized = lambda x: bytes([len(x)]) + x if len(x) < 128 else bytes([len(x) % 128 + 128, len(x) // 128]) + x
    body = bytes([op]) + seq.to_bytes(8, "little") + sized(key) + sized(value or b"")
    return zlib.crc32(body).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def test_frames_against_zlib(spark):
    assert zlib.crc32(b"123456789") == 0xCBF43926
    log = registry.oplog.from_events(spark, FOLDER)
    by = {r["seq"]: r for r in log.collect()}
    got = registry.QUERIES["crc32_frames"](spark, FOLDER).collect()
    assert len(got) == len(by)
    for r in got:
        x = by[r["seq"]]
        frame = frame_of(x["user_key"].encode(), x["seq"], x["op"], x["value"] and x["value"].encode())
        assert bytes.fromhex(r["frame"]) == frame and r["crc"] == zlib.crc32(frame[8:]) and bytes.fromhex(r["payload"]) == frame[8:]
    back = registry.QUERIES["frame_decode"](spark, FOLDER).collect()
    assert len(back) == len(by) and 0 < sum(not r["good"] for r in back) < len(back)
    for r in back:
        damaged = r["id"] % 1000 >= 700 and r["id"] % 11 == 3
        x = by[r["id"]]
        assert r["good"] != damaged
        assert tuple(r)[3:] == ((None,) * 4 if damaged else (x["user_key"], x["seq"], x["op"], x["value"]))


def test_unsound_frames(spark):
    good = frame_of(b"k", 7, 1, b"value")
    resealed = lambda body: zlib.crc32(body).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    bad = [b"", good[:15], good[:-1], good + b"x", good[:8] + b"\x00" + good[9:], resealed(b"\x02" + good[9:]), resealed(good[8:] + b"x"), resealed(good[8:-2]), resealed(b"\x00" + good[9:]), resealed(b"")]
    rows = [(i, x.hex().upper()) for i, x in enumerate([good, *bad])]
    told = {r["id"]: r["good"] for r in frames.decode(spark.createDataFrame(rows, "id long, frame string")).collect()}
    assert told == {0: True, **dict.fromkeys(range(1, len(bad) + 1), False)}


def test_codecs_read_back(spark):
    numbers = [0, 1, 127, 128, 2**32 - 1, 2**35, 2**56, 2**63, 2**64 - 1, 2**64]
    coded = []
    for n in numbers:
        out, x = [], n
        while True:
            out.append(x % 128 + (128 if x >= 128 else 0))
            x //= 128
            if not x:
                break
        coded.append(bytes(out).hex().upper())
        assert number(bytes(out)) == (n, len(out))
    rows = [(h, n) for h, n in zip(coded, map(str, numbers), strict=True)] + [("80", None), ("FF" * 9, None), ("", None), ("FF" * 10 + "01", None)]
    got = spark.createDataFrame(rows, "h string, n string").select("n", codec.varint64_from_hex(F.col("h")).cast("string").alias("v")).collect()
    assert [r["v"] for r in got] == [r["n"] if r["n"] != str(2**64) else None for r in got]
    keys = spark.createDataFrame([("été", 5, 1), ("", 2**56 - 1, 0)], "k string, seq long, op int").withColumn("h", codec.internal_key_hex(F.col("k"), F.col("seq"), F.col("op")))
    assert all(tuple(r)[:3] == tuple(r)[3:] for r in keys.select("k", "seq", "op", *codec.internal_key_parts(F.col("h"))).collect())
    short = spark.createDataFrame([("00" * 7,), ("02" + "00" * 7,)], "h string").select(*codec.internal_key_parts(F.col("h"))).collect()
    assert all(x is None for r in short for x in r)


def cut_one_by_one(rows, limit):
    file, filled, out = 1, 0, {}
    for seq, size, key in sorted(rows):
        if filled >= limit:
            file, filled = file + 1, 0
        filled += size
        out[seq, size, key] = file
    return out


@pytest.mark.parametrize("chunk,fan_in", [(7, 2), (50, 3), (1000, 256)])
def test_segments_in_a_tree(spark, chunk, fan_in):
    r = random.Random(chunk)
    rows = [(seq, r.choice([1, 5, 30, 90, 400]), f"k{i}") for seq in range(600) if seq // 40 != 7 for i in range(1 + (seq % 10 == 0))]  # a gap, and repeated numbers
    df = spark.createDataFrame([(k, s, n) for s, n, k in rows], "user_key string, seq long, size long")
    got = segments.reset_sum(df, F.col("size"), 200, chunk, fan_in).collect()
    assert len(got) == len(rows) and {(x["seq"], x["size"], x["user_key"]): x["file_id"] for x in got} == cut_one_by_one(rows, 200)


def test_few_steps_are_left_to_compose(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(20, 60)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "seq long, bytes long").withColumn("node", F.floor(F.col("seq") / 2000).cast("long"))
    steps = df.groupBy("node").applyInPandas(segments._summary(4096), segments.STEPS)
    assert steps.count() < 10 * 4096 / 40 / 2  # not half of the rows that fit in one file, for each chunk


def test_percentiles_in_ranges(spark):
    r = random.Random(3)
    rows = [(g, r.choice([r.random(), 7.0, r.gauss(0, 1000)])) for g in ("a", "b", None) for _ in range(500)] + [("c", None), ("d", 5.0), ("a", None)]
    got = {x["g"]: tuple(x)[1:] for x in metrics.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert got[g] == (len(v), *((v[math.ceil(p * len(v)) - 1] if v else 0) for p in (0.5, 0.99, 0.999)))


def test_results_come_back_as_they_were(spark, tmp_path):
    schema = "name string, x double, n long, empty string"
    rows = [('a "quoted", b', 0.1 + 0.2, 1, ""), ("two\nlines", 1e-300, None, None), ("", math.pi, 2**60, "x"), (None, -0.0, 0, "\\")]
    df = spark.createDataFrame(rows, schema)
    results.write_csv(df, f"{tmp_path}/csv")
    results.write_json(df, f"{tmp_path}/json")
    for back in (results.read_csv(spark, f"{tmp_path}/csv", schema), results.read_json(spark, f"{tmp_path}/json", schema)):
        assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
    with pytest.raises(Exception):  # noqa: B017
        results.read_csv(spark, f"{tmp_path}/csv", "other string, x double, n long, empty string").collect()


def test_compaction_to_a_fixpoint(spark, tmp_path):
    r = random.Random(8)
    rows = [(f, 0 if f < 6 else 1, f"k{k:02d}", f * 100 + k, 1, "v") for f in range(9) for k in sorted(r.sample(range(40), 9))]
    df = spark.createDataFrame(rows, "file_id long, level int, user_key string, seq long, op int, value string")
    n = iter(range(1000))

    def store(x):
        path = f"{tmp_path}/{next(n)}"
        x.write.parquet(path)
        return spark.read.schema(x.schema).parquet(path)

    plan = lambda x: compaction.leveled_l0_plan(runs.manifest(x), 2)
    out = compaction.to_fixpoint(df, plan, store, 100)
    newest = {}
    for row in rows:
        if row[3] > newest.get(row[2], (0,))[0]:
            newest[row[2]] = (row[3],)
    left = out.collect()
    assert all(x["level"] == 1 for x in left) and {x["user_key"]: x["seq"] for x in left if x["file_id"] >= 100} == {k: v[0] for k, v in newest.items() if k in {x["user_key"] for x in left if x["file_id"] >= 100}}
    bounds = sorted((min(x["user_key"] for x in left if x["file_id"] == f), max(x["user_key"] for x in left if x["file_id"] == f)) for f in {x["file_id"] for x in left})
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))


def test_a_missing_bound_rules_nothing_out(spark):
    files = spark.createDataFrame([(1, "b", "d"), (2, None, "c"), (3, "c", None)], "file_id long, smallest_key string, largest_key string")
    got = {x["user_key"]: x["candidates"] for x in runs.range_pruning(spark.createDataFrame([("a",), ("c",), ("e",)], "user_key string"), files).collect()}
    assert got == {"a": 1, "c": 3, "e": 1}
    assert compaction.level_capacity(5000, 40) == 2**64 - 1
    with pytest.raises(OverflowError):
        compaction.base_size(2**62, 4)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def some_runs(seed):
    """(rows of runs, asked keys): keys of several alphabets, repeated ones, some that no run holds, and a null."""
    r = random.Random(seed)
    names = [f"k{i:03d}" for i in range(150)] + ["é", "z\U0001f600", "z\uffff", ""]
    rows = [(f, r.choice(names), f * 1000 + i, 1, "v" * r.randrange(9)) for f in range(1, 24) for i in range(r.choice([1, 6, 40]))]
    return rows, [*names, *(n + "x" for n in names), None]


@pytest.mark.parametrize("block_keys", [7, 4096])
def test_first_block_of_each_key(spark, block_keys):
    rows, asked = some_runs(5)
    blocks = {}
    for f, key, *_ in sorted(rows, key=lambda x: (x[0], x[1].encode())):
        of = blocks.setdefault(f, [[]])
        if len(of[-1]) == 3:
            of.append([])
        of[-1].append(key)
    index = [(f, k, keys[-1]) for f, of in blocks.items() for k, keys in enumerate(of)]
    df = runs.block_of_key(spark.createDataFrame([(x,) for x in asked], "user_key string"), spark.createDataFrame(index, "file_id long, block_no long, last_key string"), block_keys=block_keys)
    want = {}
    for key in asked:
        for f, k, last in index:
            if key is not None and last.encode() >= key.encode():
                want[key, f] = min(k, want.get((key, f), k))
    got = df.collect()
    assert len(got) == len(want) and {(x["user_key"], x["file_id"]): x["block_no"] for x in got} == want
    assert "unboundedfollowing" not in plan_of(df)  # such a window takes the square of a run's rows


@pytest.mark.parametrize("block_keys", [7, 4096])
def test_filters_in_packs(spark, block_keys):
    rows, asked = some_runs(6)
    held = {(key, f) for f, key, *_ in rows}
    files = {f for _, f in held}
    df = runs.bloom_prune(spark.createDataFrame([(x,) for x in asked], "user_key string"), spark.createDataFrame(rows, "file_id long, user_key string, seq long, op int, value string"), block_keys=block_keys)
    maybe = {}
    for f in files:
        of = sorted(k for k, g in held if g == f)
        m = codec.bloom_size(len(of), 10)
        bits = set(codec.bloom_positions(of, m, 7).ravel().tolist())
        for key, at in zip(asked[:-1], codec.bloom_positions(asked[:-1], m, 7).tolist(), strict=True):
            maybe[key, f] = bits.issuperset(at)
    got = df.collect()
    assert len(got) == len(maybe)
    assert {(x["user_key"], x["file_id"]): (x["maybe"], x["present"]) for x in got} == {p: (v, p in held) for p, v in maybe.items()}
    assert "SortMergeJoin" not in plan_of(df) and "HashJoin" not in plan_of(df)  # pairs are in no join after they are made


def test_ranges_are_counted_without_pairs(spark):
    r = random.Random(7)
    names = [None, *(f"k{i:02d}" for i in range(40)), "é", ""]
    files = [(i, r.choice(names), r.choice(names)) for i in range(300)]  # some bounds are missing or cross
    asked = [*names, "k", "k05x", "zz"]
    df = runs.range_pruning(spark.createDataFrame([(x,) for x in asked * 2], "user_key string"), spark.createDataFrame(files, "file_id long, smallest_key string, largest_key string"))
    byte = lambda x: x.encode()
    want = {k: sum(k is not None and (a is None or byte(k) >= byte(a)) and (b is None or byte(k) <= byte(b)) for _, a, b in files) for k in asked}
    got = df.collect()
    assert len(got) == len(want) and {x["user_key"]: (x["candidates"], x["runs"]) for x in got} == {k: (n, 300) for k, n in want.items()}
    assert "LeftOuter" not in plan_of(df)  # no pair of a key and a run is made
    none = runs.range_pruning(spark.createDataFrame([("a",)], "user_key string"), spark.createDataFrame([], "file_id long, smallest_key string, largest_key string")).collect()
    assert [tuple(x) for x in none] == [("a", 0, 0)]
