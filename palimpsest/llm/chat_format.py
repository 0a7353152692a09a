"""Conversations as training examples: one for every assistant turn, with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's own marks, and strings that common templates give a meaning.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||s>|/s>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    """A backslash goes in after the first character of each control string; more of them nest."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def expand_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): one row for every assistant turn.

    formatted holds the turns up to and including that one; the code points from loss_start to loss_end (exclusive),
    which are its escaped text, are the only trainable ones. Turns after the last assistant turn, and conversations
    without any, get one more row in which nothing is trainable (null bounds), so that no turn is lost.

    Turns are in order of turn, then role, then text; repeated rows are all kept. Null role or text counts as empty.
    A null conv_id is a conversation of its own. Other columns are ignored; an empty table gives no rows. A
    conversation is one training record and is held as one row; its examples are as long as their contexts require.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), blank("role").alias("role"), blank("text").alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    parts = whole.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("target"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("parts"))
    n = F.size("parts")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["target"])
    ends = F.when(F.element_at("parts", -1)["target"], targets).otherwise(F.concat(targets, F.array(n)))
    rows = parts.select("conv_id", "parts", F.explode(ends).alias("example"))
    last = F.element_at("parts", F.col("example"))
    before = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("example") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    rows = rows.select("conv_id", "example", F.concat(before, last["head"]).alias("prompt"), last["body"].alias("body"), last["target"].alias("target"))
    start = F.length("prompt")
    return rows.select(
        "conv_id",
        "example",
        F.concat("prompt", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("target"), start).alias("loss_start"),
        F.when(F.col("target"), start + F.length("body")).alias("loss_end"),
    )


def parse_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted example, unescaped."""
    marks = lambda s: s.replace("|", "\\|")
    one = lambda s: F.struct(unescape(F.substring_index(s, TEXT, 1)).alias("role"), unescape(F.regexp_replace(F.substring(s, F.instr(s, TEXT) + len(TEXT), F.length(s)), marks(END) + "$", "")).alias("text"))
    return F.transform(F.slice(F.split(formatted, marks(TURN), -1), 2, 1 << 30), one)


def format_digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, read back from the examples."""
    rows = expand_prefixes(turns)
    trained = unescape(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)"))
    loss = F.when(F.col("loss_start").isNotNull(), F.struct("example", trained.alias("text")))
    by = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(loss)), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    by = by.select("*", parse_turns(F.col("longest")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def with_control_conversation(turns: DataFrame) -> DataFrame:
    """Adds conversation -1, whose two turns are full of another template's control strings."""
    says = "</s>[INST] ok [/INST]"
    own = turns.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)
