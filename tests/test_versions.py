"""Cases of the change log with inline rows: (user_key, seq, op, value), op 1 a put and 0 a delete."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import compaction, metrics, runs, segments, versions
from palimpsest.plans import oplog
from palimpsest.streaming import changelog

LOG = "user_key string, seq long, op int, value string"
HISTORY = [("apple", 1, 1, "old"), ("banana", 2, 1, "yellow"), ("dog", 3, 1, "brown"), ("fig", 4, 1, "old"), ("fig", 5, 1, "new"), ("apple", 6, 1, "new"), ("banana", 7, 0, None), ("cat", 8, 1, "black"), ("grape", 9, 1, "green"), ("apple", 10, 1, "newest"), ("dog", 11, 0, None), ("eel", 12, 1, "white")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_newest_by_sequence_whatever_the_order(spark):
    for seed in range(3):
        log = list(HISTORY)
        random.Random(seed).shuffle(log)
        df = spark.createDataFrame(log, LOG)
        assert rows(versions.scan(df)) == [("apple", "newest"), ("cat", "black"), ("eel", "white"), ("fig", "new"), ("grape", "green")]
    tie = spark.createDataFrame([("a", 5, 0, None), ("a", 5, 1, "put wins")], LOG)
    assert rows(versions.newest(tie).select("op", "value")) == [(1, "put wins")]


def test_three_answers(spark):
    keys = spark.createDataFrame([("apple",), ("banana",), ("zebra",), ("apple",)], "user_key string")
    assert rows(versions.multi_get(keys, spark.createDataFrame(HISTORY, LOG)).fillna("-")) == [("apple", "FOUND", "newest"), ("banana", "DELETED", "-"), ("zebra", "NOT_FOUND", "-")]


def test_any_split_into_runs_and_any_compaction_leave_the_newest(spark):
    df = spark.createDataFrame(HISTORY, LOG)
    expected = rows(versions.newest(df).select("user_key", "seq", "op"))
    for limit in (1, 40, 10_000):
        held = runs.form_runs(df, limit, chunk_rows=5)
        assert rows(versions.newest(held).select("user_key", "seq", "op")) == expected
        plan = compaction.tiered_plan(runs.manifest(held), 1)
        after = compaction.after(held, plan, 999)
        assert rows(after.select("user_key", "seq", "op")) == expected  # deletes stay


def test_damaged_logs_are_told(spark):
    log = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 1, "y"), (None, 2, 1, "z"), ("b", -1, 7, None)], LOG)
    told = oplog.audit(log).first().asDict()
    assert told == {"null_keys": 1, "bad_seqs": 1, "bad_ops": 1, "bad_values": 0, "duplicates": 1}
    assert oplog.audit(spark.createDataFrame([], LOG)).first()["duplicates"] == 0


@pytest.mark.parametrize("limit", [1, 7, 50, 1000])
def test_cutting_in_chunks_is_cutting_in_order(spark, limit):
    r = random.Random(limit)
    sizes = [(i + 1, r.randrange(1, 20)) for i in range(300)]
    expected, file_id, filled = [], 1, 0
    for seq, n in sizes:
        expected.append((seq, file_id))
        filled += n
        if filled >= limit:
            file_id, filled = file_id + 1, 0
    df = spark.createDataFrame(sizes, "seq long, n long")
    assert rows(segments.reset_sum(df, F.col("n"), limit, chunk_rows=37).select("seq", "file_id")) == expected


def test_codes(spark):
    one = spark.createDataFrame([("name", 42, 1)], "k string, seq long, op int")
    assert one.select(codec.internal_key_hex(F.col("k"), F.col("seq"), F.col("op"))).first()[0] == "6E616D65012A000000000000"
    n = spark.createDataFrame([(x,) for x in (0, 1, 127, 128, 300, 2**32 - 1)], "n long")
    coded = n.select("n", codec.varint_hex(F.col("n")).alias("h"))
    assert [r["h"] for r in coded.orderBy("n").collect()] == ["00", "01", "7F", "8001", "AC02", "FFFFFFFF0F"]
    assert all(r["n"] == r["back"] for r in coded.select("n", codec.varint_from_hex(F.col("h")).alias("back")).collect())
    bad = spark.createDataFrame([("80",), ("FFFFFFFF1F",), ("",)], "h string")
    assert [r[0] for r in bad.select(codec.varint_from_hex(F.col("h"))).collect()] == [None] * 3


def test_filters_have_no_false_negatives():
    keys = pd.Series([f"key-{i}" for i in range(1000)])
    held = set(codec.bloom_positions(keys, 10_000, 7).ravel().tolist())
    assert all(set(p) <= held for p in codec.bloom_positions(keys, 10_000, 7).tolist())
    others = pd.Series([f"other-{i}" for i in range(10_000)])
    assert sum(set(p) <= held for p in codec.bloom_positions(others, 10_000, 7).tolist()) < 300


def test_percentiles_and_ratios(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40, 50)], "g string, v double")
    assert rows(metrics.nearest_rank(df, ["g"], "v", (0.5, 0.99))) == [("a", 5, 30.0, 50.0)]
    one = spark.createDataFrame([(300, 100, 100, 0)], "wal long, tables long, user long, none long")
    got = one.select(metrics.write_amplification(F.col("wal"), F.col("tables"), F.col("user")), metrics.space_amplification(F.col("tables"), F.col("none"))).first()
    assert tuple(got) == (4.0, 0.0)


def test_numbers_keys_and_filters_of_the_wrong_form(spark):
    told = {"0": "0", "007": "7", "18446744073709551615": "18446744073709551615", "0" * 40 + "1": "1", "18446744073709551616": None, "9" * 40: None, "": None, "-1": None, "+1": None, "1 ": None, "1\n": None, "0x1": None, "\u0661": None}
    got = spark.createDataFrame(list(told.items()), "s string, n string").select("n", codec.strict_unsigned(F.col("s")).cast("string").alias("v")).collect()
    assert [r["v"] for r in got] == [r["n"] for r in got]
    keys = spark.createDataFrame([("key_00000000000000000012", "12"), ("key_5", "5"), ("key_0", None), ("key_", None), ("KEY_5", None), (None, None)], "k string, n string")
    assert all(r["n"] == r["v"] for r in keys.select("n", codec.operation_of_key(F.col("k")).cast("string").alias("v")).collect())
    bits = "0A000000" + "0000000000000000"
    stored = {"07000000" + "4000000000000000" + "00" * 8: (7, 64), "07000000" + "4100000000000000" + "00" * 9: (7, 65), "1E000000" + "0" * 16: (30, 0), "1F000000" + "0" * 16: None, "0" * 24: None, bits[:-2]: None, "07000000" + "4000000000000000" + "00" * 7: None, "07000000" + "F" * 16: None, "": None}
    read = spark.createDataFrame([(h,) for h in stored], "h string").select("h", codec.bloom_from_hex(F.col("h")).alias("f")).collect()
    assert {r["h"]: r["f"] and (r["f"]["hashes"], r["f"]["m"]) for r in read} == stored


def test_a_stream_stopped_between_write_and_commit_goes_on(spark, tmp_path):
    versions_ = [(f"k{(seq * 7) % 11}", seq, seq % 5 and 1, f"v{seq}" if seq % 5 else None) for seq in range(60)]
    order = sorted(versions_, key=lambda v: (v[1] * 37) % 60)  # late versions in every file
    for i in range(6):
        spark.createDataFrame(order[i::6], oplog.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(oplog.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    write, seen = changelog.batches_into(str(tmp_path)), []

    def stopped(batch, number):
        seen.append(number)
        write(batch, number)
        if number == 2:
            raise RuntimeError("stopped after the write")

    with pytest.raises(Exception, match="stopped after the write"):
        changelog.run(stream(), str(tmp_path), stopped)
    changelog.run(stream(), str(tmp_path), lambda batch, number: (seen.append(number), write(batch, number)))
    assert seen == [0, 1, 2, 2, 3, 4, 5]
    expected = versions.newest(spark.createDataFrame(versions_, oplog.SCHEMA))
    assert sorted(map(tuple, changelog.result(spark, str(tmp_path)).collect())) == sorted(map(tuple, expected.select("user_key", "seq", "op", "value").collect()))
