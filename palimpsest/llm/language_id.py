"""Language identification: known words first, then ever shorter character n-grams for unseen words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import kernels as K
from palimpsest.llm.sampling import bounded_sample

U = np.uint64
EDGE = 2  # the code point that stands before and after a word
SPACE = re.compile(r"\s")
WORD, GRAM = 0, 1


@cache
def kinds() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a combining mark, 0 for all else."""
    kind = {"L": 1, "M": 2}
    return np.fromiter((kind.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)


@dataclass
class LetterWords:
    """The words of some texts, lowered: a letter, then letters and their combining marks; all else divides words."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    keys: np.ndarray


def letter_words(rows: list[int], lowered: list[str]) -> LetterWords:
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le"), "<u4")
    kind = kinds()[points]
    solid = kind > 0
    starts, ends = np.flatnonzero(solid & ~np.append(False, solid[:-1])), np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
    letters = np.append(np.flatnonzero(kind == 1), len(points))
    starts = letters[np.searchsorted(letters, starts)]  # marks before the first letter are no part of a word
    some = starts < ends
    starts, ends = starts[some], ends[some]
    offsets = np.append(0, np.cumsum([len(x) + 1 for x in lowered]))
    row = np.array(rows, np.int64)[np.searchsorted(offsets, starts, "right") - 1]
    return LetterWords(points, starts, ends, row, K.range_hash(K.prefix_sums(points), starts, ends))


def pieces(texts: pa.Array, limit: int = 1 << 18) -> Iterator[LetterWords]:
    """The words of a column of texts, about so many characters at a time; a longer text is cut at white space."""
    rows, lowered, size = [], [], 0
    for i, value in enumerate(texts):
        text, at = value.as_py() or "", 0
        while at < len(text):
            found = SPACE.search(text, at + limit) if len(text) - at > limit else None
            end = found.end() if found else len(text)
            rows.append(i)
            lowered.append((text[at:end] if at or found else text).lower())
            size, at = size + end - at, end
            if size >= limit:
                yield letter_words(rows, lowered)
                rows, lowered, size = [], [], 0
    if rows:
        yield letter_words(rows, lowered)


@dataclass
class Grams:
    """All n-grams of some words with an edge on both sides: of[p] is the word of position p, keys(n) those of n characters."""

    of: np.ndarray
    points: np.ndarray
    room: np.ndarray

    @classmethod
    def around(cls, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Grams:
        sizes = ends - starts + 2
        last = np.cumsum(sizes)
        first = last - sizes
        of = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(int(last[-1]) if len(last) else 0)
        around = points[np.clip(np.repeat(starts - 1 - first, sizes) + at, 0, len(points) - 1)].astype(U)
        around[first], around[last - 1] = EDGE, EDGE
        return cls(of, around, last[of] - at)

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of the n-grams that lie in one word."""
        at = np.flatnonzero(self.room >= n)
        out = np.full(len(at), n, U)
        for j in range(n):
            out = K.mix(out + (self.points[at + j] + U(1)) * U(0x9E3779B97F4A7C15))
        return at, out


@dataclass
class Model:
    """Per-language log frequencies of words and of character n-grams, both by sorted 64-bit hash, for the sorted languages."""

    langs: list[str]
    word_keys: np.ndarray
    word_logs: np.ndarray
    gram_keys: np.ndarray
    gram_logs: np.ndarray
    longest: int = 4

    def scores(self, w: LetterWords) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the distinct words, which of these each word is): known words by themselves, the others by back-off.

        An unseen word's score is the mean, over those of its positions (edges included) at which any n-gram is known, of the
        longest one's; without any it is 0 for each language.
        """
        keys, first, inverse = np.unique(w.keys, return_index=True, return_inverse=True)
        at, known = _find(self.word_keys, keys)
        out = np.zeros((len(keys), len(self.langs)))
        out[known] = self.word_logs[at[known]]
        unseen = np.flatnonzero(~known)
        g = Grams.around(w.points, w.starts[first[unseen]], w.ends[first[unseen]])
        found = np.full(len(g.of), -1)
        for n in range(self.longest, 0, -1):
            where, grams = g.keys(n)
            open_ = found[where] < 0
            where, grams = where[open_], grams[open_]
            slot, hit = _find(self.gram_keys, grams)
            found[where[hit]] = slot[hit]
        where = np.flatnonzero(found >= 0)
        count = np.bincount(g.of[where], minlength=len(unseen))
        for k in range(len(self.langs)):
            out[unseen, k] = np.bincount(g.of[where], self.gram_logs[found[where], k], len(unseen)) / np.maximum(count, 1)
        return out, inverse


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is among the sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def train(docs: DataFrame, rows: int = 6000, longest: int = 4) -> Model:
    """Learns from (doc_id, text, lang): from the whole texts of about so many documents with a lang and a text, chosen by hash of doc_id.

    Every word of these texts, and every n-gram of up to so many characters, is in the model, however rare. Rows with
    null text or lang teach nothing; without any, the model knows no language. Of rows that share a doc_id one counts.
    Counting is a Spark aggregate; what comes back to the driver and is broadcast grows with the sample, not with the table.
    """
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = bounded_sample(labelled, "doc_id", rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, of = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True) if b.num_rows else ([], np.zeros(0, int))
            for w in pieces(b.column(1)):
                for i, lang in enumerate(langs):
                    own = of[w.row] == i
                    keys, first, n = np.unique(w.keys[own], return_index=True, return_counts=True)
                    g = Grams.around(w.points, w.starts[own][first], w.ends[own][first])
                    parts = [(WORD, keys, n)]
                    for size in range(1, longest + 1):
                        at, grams = g.keys(size)
                        grams, slot = np.unique(grams, return_inverse=True)
                        parts.append((GRAM, grams, np.bincount(slot, n[g.of[at]], len(grams)).astype(np.int64)))
                    for kind, keys, n in parts:
                        yield pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array([lang] * len(keys), pa.string()), pa.array(n)], ["kind", "key", "lang", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "kind int, key long, lang string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")).coalesce(8).toArrow()
    kind, key, n = (counted.column(i).to_numpy() for i in (0, 1, 3))
    lang = counted.column(2).combine_chunks().dictionary_encode()
    names = np.array(lang.dictionary.to_pylist() if len(lang) else [], object)
    order = np.argsort(names)
    of = np.argsort(order)[lang.indices.to_numpy()] if len(lang) else np.zeros(0, int)
    total = np.bincount(of, np.where(kind == WORD, n, 0), len(names))

    def table(which: int) -> tuple[np.ndarray, np.ndarray]:
        keys, slot = np.unique(key[kind == which].astype(np.int64).view(U), return_inverse=True)
        counts = np.zeros((len(keys), len(names)))
        counts[slot, of[kind == which]] = n[kind == which]
        return keys, np.log((counts + 0.1) / (total + 1.0)).astype(np.float32)

    return Model(list(names[order]), *table(WORD), *table(GRAM), longest)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, then lang_pred and score (columns of these names are replaced), from each whole text.

    Words are split at all but letters (and combining marks after them), and lowered. A known word adds its log
    frequency in each language; an unseen word adds the mean over its positions of the longest known n-gram (at most
    model.longest characters, then shorter), however long it is. The score is the softmax over languages of the mean log frequency of a word.

    `und` with score 0 if the text is null, has no letter, or the model knows no language. Ties fall to the language
    first in order. Rows are judged one by one: repeated rows alike, an empty table gives none; other columns are
    kept. A long text is read piece by piece, cut at white space.
    """
    docs = docs.drop("lang_pred", "score")
    text_at, names = docs.columns.index("text"), [*docs.columns, "lang_pred", "score"]
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample that taught it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        width = len(m.langs)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                sums, count = np.zeros((b.num_rows, max(1, width))), np.zeros(b.num_rows)
                for w in pieces(b.column(text_at)):
                    count += np.bincount(w.row, minlength=b.num_rows)
                    values, slot = m.scores(w)
                    for k in range(width):
                        sums[:, k] += np.bincount(w.row, values[slot, k], b.num_rows)
                mean = sums / np.maximum(count, 1)[:, None]
                best = mean.argmax(1)
                odds = np.exp(mean - mean.max(1, keepdims=True))
                score = odds.max(1) / odds.sum(1)
                told = (count > 0) & (width > 0)
                yield pa.record_batch([*b.columns, pa.array([m.langs[k] if ok else "und" for k, ok in zip(best, told, strict=True)], pa.string()), pa.array(np.where(told, score, 0.0))], names)

    return docs.mapInArrow(run, schema)


def recognised(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with at least that score."""
    return predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*docs.columns)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows that are not held out, predicted for all."""
    docs = docs.select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
