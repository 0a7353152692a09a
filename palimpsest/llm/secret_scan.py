"""Secrets in texts: fixed rules, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.codec import let
from palimpsest.llm.sampling import bounded_sample

# The rules every scan applies, by kind and in this order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
STATES = len(ALPHABET) + 2  # the start, then the alphabet, then any other character


def labelled_samples(docs: DataFrame, rows: int = 2000, randoms: int = 4000) -> DataFrame:
    """(token, is_random): identifiers made of the words of about so many rows (chosen by hash of doc_id), and digests.

    Both bounds are parameters; the models need a few thousand strings of each kind, whatever the corpus holds.
    """
    words = (
        bounded_sample(docs.select("doc_id", "text"), "doc_id", rows)
        .select(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w"))
        .where("size(w) > 1")
        .select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b")))).alias("i", "p"))
    )
    sep = F.element_at(F.array(*map(F.lit, ("_", "-", "/", "", "_", "="))), (F.col("i") % 6 + 1).cast("int"))
    names = words.select(F.concat("p.a", sep, F.when(sep == "", F.initcap("p.b")).otherwise(F.col("p.b")), F.when(F.col("i") % 5 == 0, (F.col("i") % 100).cast("string")).otherwise("")).alias("token"), F.lit(False).alias("is_random"))
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256))
    coded = F.base64(digest)
    form = F.when(F.col("id") % 3 == 0, F.lower(F.hex(digest))).when(F.col("id") % 3 == 1, coded).otherwise(F.translate(coded, "+/=", "-_"))
    digests = docs.sparkSession.range(randoms).select(form.alias("token"), F.lit(True).alias("is_random"))
    return names.unionByName(digests)


def state(c: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at > 0, at).otherwise(STATES - 1)


def train(samples: DataFrame, smoothing: float = 0.5, prior: float = 5.0) -> list[float]:
    """Log-likelihood ratio of each pair of character states, random over ordinary, from (token, is_random).

    A pair's probability backs off to that of its second character alone, which weighs as much as prior sightings.
    Null or empty tokens count for nothing; with no samples of a kind its model is uniform. The counts come back to
    the driver as at most 2 * STATES^2 rows.
    """
    chars = F.split(F.col("token"), "")
    step = F.transform(chars, lambda c, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(state(F.get(chars, i - 1))).alias("a"), state(c).alias("b")))
    pairs = samples.where("token <> ''").select("is_random", F.explode(step).alias("s")).groupBy("is_random", "s.a", "s.b").count().collect()
    logs = []
    for kind in (True, False):
        counts = [[0] * STATES for _ in range(STATES)]
        for r in pairs:
            if r["is_random"] == kind:
                counts[r["a"]][r["b"]] += r["count"]
        alone = [smoothing + sum(row[b] for row in counts) for b in range(STATES)]
        alone = [x / sum(alone) for x in alone]
        logs.append([math.log((x + prior * p) / (sum(row) + prior)) for row in counts for x, p in zip(row, alone, strict=True)])
    return [round(a - b, 4) for a, b in zip(*logs, strict=True)]


def likelihood_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the ratios over the characters of a token of the alphabet."""
    states = [STATES - 1] * 128
    for i, c in enumerate(ALPHABET):
        states[ord(c)] = i + 1
    of = F.split(F.lit(",".join(map(str, states))), ",").cast("array<int>")
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        b = F.get(of, F.least(F.ascii(c), F.lit(127)))
        return F.struct(b.alias("a"), (acc["sum"] + F.get(table, acc["a"] * STATES + b)).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["sum"])


SPANS = "array<struct<start:int,kind:int,end:int>>"
PIECE = 256  # items folded before their results are set aside; any size gives the same result


def folded(items: Column, kind: str, step, aside=lambda at, piece: at) -> Column:
    """What step(at, item, aside) gives for each item, one array after the other, of the type kind.

    step returns the next at, a number that starts as 0, and an array. Results are gathered by pieces of items, so that an
    item copies those of its own piece and not all before it; aside(at, piece) is computed once a piece.
    """
    none = F.array().cast(kind)

    def one(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x, acc["aside"])
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out"), acc["aside"].alias("aside"), acc["done"].alias("done"))

    def piece(acc: Column, xs: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), none.alias("out"), aside(acc["at"], xs).alias("aside"), acc["done"].alias("done"))
        return F.aggregate(xs, zero, one, lambda end: F.struct(end["at"].alias("at"), F.concat(end["done"], F.array(end["out"])).alias("done")))

    def pieces(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / PIECE).cast("int")), lambda i: F.slice(all_, i * PIECE + 1, PIECE))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(let(items, pieces), zero, piece, lambda acc: F.flatten(acc["done"]))


def matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches that keep() accepts, in code points."""
    none = F.array().cast(SPANS)

    def step(at: Column, x: Column, _) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["found"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return end, F.when(x["found"].isNotNull() & keep(x["found"]), F.array(span)).otherwise(none)

    def spans(found: Column) -> Column:
        pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"))
        return F.when(F.size(found) > 0, folded(pairs, SPANS, step)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def scan(docs: DataFrame, ratios: list[float], margin: float = 12.0) -> DataFrame:
    """All columns of docs (as given), then base and spans: arrays of (start, kind, end), kind being a place in KINDS.

    The fixed rules give base. A run of 16 or more identifier characters that is likelier under the random model by the
    margin (natural log), with or without digits, is added as kind random, unless it lies within one base span; one that
    a base span covers in part is added whole, so spans of different kinds may overlap.

    Null text counts as empty and gives empty arrays. Offsets count code points, ends are exclusive. Spans are in order
    of start, then kind. Columns of docs named base or spans are replaced. A text of n spans costs about n copied references
    times the size of a piece, and n / PIECE more.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    every = lambda m: F.lit(True)
    none = F.array().cast(SPANS)
    base = F.array_sort(
        F.concat(
            matches(text, ASSIGN, 0, long_enough),
            F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, 1, every)).otherwise(none),
            matches(text, HEX, 2, every),
        )
    )
    random = matches(text, CANDIDATE, 3, lambda m: likelihood_ratio(m, ratios) >= margin)
    out = docs.withColumn("base", base).withColumn("random_", random)
    return out.withColumn("spans", F.when(F.size("random_") > 0, _uncovered(F.array_sort(F.concat("base", "random_")))).otherwise(F.col("base"))).drop("random_")


def _uncovered(spans: Column) -> Column:
    """Spans in order, without random ones that lie within a base span: one that reaches as far and starts no later."""

    def step(reach: Column, s: Column, _) -> tuple[Column, Column]:
        fixed = s["kind"] < 3
        keep = fixed | (s["end"] > reach)
        return F.when(fixed, F.greatest(reach, s["end"])).otherwise(reach), F.when(keep, F.array(s)).otherwise(F.array().cast(SPANS))

    return folded(spans, SPANS, step)


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """The text with each span, or each run of overlapping spans, replaced by the mark."""
    ends = lambda piece: F.array_max(F.transform(piece, lambda s: s["end"]))

    def part(at: Column, piece: Column) -> Column:
        """The part of the text that a piece of spans is about, and where it starts: places are counted from there."""
        return F.struct(at.alias("from"), F.substring(text, at + 1, F.greatest(ends(piece) - at, F.lit(0))).alias("text"))

    def step(at: Column, s: Column, part: Column) -> tuple[Column, Column]:
        apart = (s["start"] > at) | (at == 0)
        gap = F.substring(part["text"], at - part["from"] + 1, F.greatest(s["start"] - at, F.lit(0)))
        return F.greatest(at, s["end"]), F.when(apart, F.array(gap, F.lit(mark))).otherwise(F.array().cast("array<string>"))

    rest = F.substring(text, ends(spans) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(folded(spans, "array<string>", step, part), ""), rest)).otherwise(text)


def span_list(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = scan(docs, train(labelled_samples(docs)))
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count("base", k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
        count("spans", 3).alias("n_random"),
    )


def redacted(docs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The same rows and columns, secrets replaced in text, n_chars (if there) counted anew where the text changed."""
    found = scan(docs, train(labelled_samples(docs.select("doc_id", "text"))))
    text = redact(F.col("text"), F.col("spans"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
