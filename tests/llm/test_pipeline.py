import random
import re
from collections import Counter

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, tag int"
ITEM = "seven brave turtles crossed that wide river before the early morning light arrived quietly"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    words = {"en": "the of and house river with light that tree from".split(), "de": "der die und haus fluss mit licht das baum von".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(r.choice(words[lang]) + (r.choice(words[lang]) if r.random() < 0.6 else "") for _ in range(60)), lang, f"s{i % 4}"))
    rows += [(200, rows[5][1], "en", "s1"), (201, rows[7][1] + " the end", "en", "s1"), (202, None, "en", "s0"), (203, "1234 %%% --- 99", "en", "s0"), (204, "", None, None)]
    half = ITEM.split()
    rows += [(205, " ".join(rows[8][1].split()[::-1]) + " " + " ".join(half[7:] + ["and"] + half[:7]), "en", "s2"), (206, 'the house and api_key = "abcdefghijkl0123" of the river with light from that tree', "en", None), rows[9]]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(i, t, g, s, len(t or ""), "c", 1) for i, t, g, s in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM, "q"), (2, None, "q"), (3, "the house", "q")], "item_id long, text string, score string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_each_stage_and_the_whole(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids.append(Counter(r["doc_id"] for r in docs.collect()))
    every = Counter(r[0] for r in rows)
    assert every - ids[0] == Counter([202, 203, 204])
    assert ids[0] - ids[1] == Counter([200, 201, 9])
    assert ids[1] - ids[2] == Counter([205])
    assert ids[2] == ids[3]
    by = {r["doc_id"]: r for r in docs.collect()}
    assert by[206]["text"] == 'the house and <SECRET>" of the river with light from that tree' and by[206]["n_chars"] == len(by[206]["text"])
    assert by[0]["text"] == rows[0][1]
    out = corpus_pipeline.run(spark, path).collect()
    used = Counter(r["source"] for r in out)
    assert {r["doc_id"] for r in out} <= set(ids[3]) and set(used) == {"s0", "s1", "s2", "s3", ""}
    assert all(len(re.findall(r"\S+", by[r["doc_id"]]["text"])) == r["n_tokens"] for r in out)


def test_tasks_hold_small_batches(spark, folder):
    path, _ = folder
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = spark.conf.get(key)
    try:
        for given, held in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (500, 500)):
            spark.conf.set(key, given)
            corpus_pipeline.drop_contaminated(spark, docs, path)
            assert int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, before)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
