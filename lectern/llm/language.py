"""Language identification by rank-order n-gram profiles and the out-of-place distance.

Letters are lower-cased one by one (a letter whose lower case is several characters stays as it is); all else is a word
boundary. A text's n-grams of one to three characters, those with a boundary at an end included, are ranked by count, ties
by the characters' code points, the last one first. A language's profile is the same ranking over all its training texts.
The distance of a text to a language is the sum, over the text's first `top` n-grams, of how many places each is out of
its place in the profile, `top` for one that the profile lacks; the nearest language wins, ties by name.

N-grams are exact: three code points of 21 bits packed in one number. A null text, or one without letters, is `und` with
score 0. Texts or languages that repeat, and extra columns, change nothing else. Without training texts every text is
`und`. Counts cover all training texts, whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lectern.llm.ragged import blocks, buffers
from lectern.session import table

BOUNDARY = 1
POINTS = 0x110000
#: Texts counted together: with all letters of Unicode in a block, three of them and a text's number still fit 63 bits.
TEXTS = 2048
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower case, or BOUNDARY for what is no letter."""
    global _LETTERS
    if _LETTERS is None:
        low = [c.lower() if unicodedata.category(c)[0] == "L" else "" for c in map(chr, range(POINTS))]
        _LETTERS = np.array([BOUNDARY if not x else ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.int32)
    return _LETTERS


class Grams:
    """All n-grams of a block of texts: distinct ones with counts, sorted by the text's number, then by code."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        raw = np.insert(np.where(data == 10, np.uint8(32), data), offsets, np.uint8(10))
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        number = np.minimum(np.maximum(np.cumsum(chars == 10) - 1, 0), max(0, len(offsets) - 2))
        points = letters()[chars]
        there = np.zeros(POINTS, bool)
        there[points] = True
        # the block's own alphabet, in the order of code points: 0 is no character
        self.alphabet = np.r_[0, np.flatnonzero(there)]
        rank = np.zeros(POINTS, np.int32)
        rank[self.alphabet] = np.arange(len(self.alphabet))
        s, size = rank[points].astype(np.int64), len(self.alphabet)
        letter = points != BOUNDARY
        self.lettered = np.unique(number[letter])
        owner = number * size**3
        one = (owner + s)[letter]
        pair = letter[:-1] | letter[1:]
        two = (np.where(letter[:-1], owner[:-1], owner[1:]) + s[:-1] + s[1:] * size)[pair]
        three = (owner[1:-1] + s[:-2] + s[1:-1] * size + s[2:] * size**2)[letter[1:-1]]
        keys = np.sort(np.concatenate([one, two, three]))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.counts = np.diff(np.r_[first, len(keys)])
        self.number, self.code = np.divmod(keys[first], size**3)

    def packed(self, code: np.ndarray) -> np.ndarray:
        """The code points of n-grams, 21 bits each, the first lowest."""
        size = len(self.alphabet)
        a, b, c = code % size, code // size % size, code // size**2
        return self.alphabet[a] | self.alphabet[b] << 21 | self.alphabet[c] << 42


def _parts(column: pa.Array) -> Iterator[tuple[int, int, Grams]]:
    data, offsets, _ = buffers(column)
    for low, high in blocks(offsets):
        for a in range(low, high, TEXTS):
            b = min(a + TEXTS, high)
            yield a, b, Grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language numbers, n-grams and counts with equal ones added up."""
    lang, gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((gram, lang))
    lang, gram, n = lang[order], gram[order], n[order]
    first = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])])
    return lang[first], gram[first], np.add.reduceat(n, first)


def _train(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array([*names], object)[lang], pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        said = batch.column(0).to_pylist()
        for a, b, grams in _parts(batch.column(1)):
            number = np.array([names.setdefault(x, len(names)) for x in said[a:b]], np.int64)
            if len(grams.code):
                held.append(_summed([(number[grams.number], grams.packed(grams.code), grams.counts)]))
        if sum(len(x[0]) for x in held) > most:
            held = [_summed(held)]
            if len(held[0][0]) > most // 2:
                yield rows(*held.pop())
    if held:
        yield rows(*_summed(held))


def profiles(documents: DataFrame, top: int = 400, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, rank) of the first `top` n-grams of each language, over all rows with a language."""
    rows = documents.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    counts = rows.mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram", "rank")


def _predict(batches: Iterator[pa.RecordBatch], shared, top: int) -> Iterator[pa.RecordBatch]:
    names, known, ranks = shared.value  # ranks: one row a language, `top` where its profile lacks the n-gram
    for batch in batches:
        best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
        for a, b, grams in _parts(batch.column(1)):
            if not len(names) or not len(grams.lettered):
                continue
            most = int(grams.counts.max())
            order = np.argsort(grams.number * (most + 1) + (most - grams.counts), kind="stable")  # codes ascend already
            number = grams.number[order]
            place = np.arange(len(number)) - np.searchsorted(number, number)
            kept = place < top
            number, place, gram = number[kept], place[kept], grams.packed(grams.code[order[kept]])
            at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            slot = np.where(known[at] == gram, at, len(known))
            apart = np.stack([np.bincount(number, np.where(r[slot] < top, np.abs(r[slot] - place), top), b - a) for r in ranks])
            nearest = apart.argmin(0)
            ordered = np.sort(apart, 0)
            margin = (ordered[1] - ordered[0]) / np.maximum(ordered[1], 1) if len(names) > 1 else np.ones(b - a)
            best[a + grams.lettered] = nearest[grams.lettered]
            score[a + grams.lettered] = margin[grams.lettered]
        said = np.array([*names, "und"], object)[best]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])


def identify(documents: DataFrame, profile: DataFrame, top: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score (how much nearer the language is than the next one). profile holds `top` rows a language."""
    got = profile.collect()
    names = sorted({r["lang"] for r in got})
    known = sorted({r["gram"] for r in got})
    row, column = ({x: i for i, x in enumerate(xs)} for xs in (names, known))
    ranks = np.full((len(names), len(known) + 1), top, np.int32)
    for r in got:
        ranks[row[r["lang"]], column[r["gram"]]] = r["rank"] - 1
    shared = documents.sparkSession.sparkContext.broadcast((names, np.array(known, np.int64), ranks))
    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(partial(_predict, shared=shared, top=top), schema).withColumnRenamed("id", doc_id)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = identify(docs, profiles(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
