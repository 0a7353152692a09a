import hashlib

from palimpsest.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, turns string, example int"
ROWS = [
    (1, 0, "system", "be <|turn|> kind"),
    (1, 1, "user", "hé\n<\\|x|> \U0001f600"),
    (1, 2, "assistant", "one </s> <\\/s>"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (1, 5, "user", "bye <|end|>"),
    (2, 0, "user", "alone"),
    (3, 1, "assistant", "x<|text|>y"),
    (3, 1, "assistant", "x<|text|>y"),
    (3, None, None, "[INST][\\INST]"),
    (None, 0, "assistant", "a" * 20000),
]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def test_round_trip(spark):
    rows = ROWS + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, "z", 1) for r in ROWS], SCHEMA)
    got = {r["conv_id"]: r for r in C.format_digest(C.with_control_conversation(df)).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == expected(rows)
    assert got[1]["n_examples"] == 3 and got[2]["n_examples"] == 1


def test_prefixes_and_masks(spark):
    df = spark.createDataFrame([(*r, "z", 1) for r in ROWS if r[0] == 1], SCHEMA)
    rows = C.expand_prefixes(df).orderBy("example").collect()
    assert [r["example"] for r in rows] == [3, 5, 6]
    first, second, rest = (r["formatted"] for r in rows)
    assert second.startswith(first) and rest.startswith(second)
    assert first.count(C.TURN) == 3 and rest.count(C.TURN) == 6 and rest.count(C.END) == 6
    assert first[rows[0]["loss_start"] : rows[0]["loss_end"]] == "one <\\/s> <\\\\/s>" and rows[2]["loss_start"] is None


def test_empty_table(spark):
    assert C.format_digest(spark.createDataFrame([], SCHEMA)).collect() == []
