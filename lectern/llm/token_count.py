"""Token counts of a byte-fallback BPE model by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie in one flat array of symbols with offsets. In each round every sequence finds its
lowest rank and all sequences apply theirs at once, at every place that has it (of places that overlap, the left one), up
to the first place where the new symbol makes a pair of a still lower rank, which must come before the places behind it.
So a sequence takes about as many rounds as it has distinct ranks, however long it is. A sequence without a pair in the
vocabulary is done, and its surviving symbols are its tokens, an unknown character counting as its UTF-8 bytes.

A null text is an empty one and has no tokens. Repeated rows are counted each. Only the id and text columns are read, so
extra columns cannot clash. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lectern.llm.ragged import blocks, buffers
from lectern.session import table

MARK = 0x2581
PRE_TOKEN = re.compile("[ \u2581]+[^ \u2581]*")
NONE = np.int64(1) << np.int64(30)
KNOWN, LONG = 1 << 20, 64


class Merges:
    """The vocabulary of a model file as arrays: characters to symbols, pairs of symbols to ranks and merged symbols."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in ids}
        symbols = {p: k for k, p in enumerate(sorted({*pieces, *(c for p in pieces for c in p)}))}
        scores = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.width = len(symbols) + 1
        pairs = {}
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                if p[:cut] in symbols and p[cut:] in symbols:
                    pairs[symbols[p[:cut]] * self.width + symbols[p[cut:]]] = (scores[score], symbols[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks, self.merged = (np.array([pairs[k][i] for k in self.keys.tolist()], np.int64) for i in (0, 1))
        single = sorted((ord(s), k) for s, k in symbols.items() if len(s) == 1)
        self.chars, self.char_symbols = (np.array(x, np.int64) for x in zip(*single, strict=True))
        # a symbol that is only a part of pieces, or a character outside the vocabulary, falls back to its bytes
        self.weights = np.array([1 if s in pieces else len(s.encode()) for s in sorted(symbols)] + [0], np.int64)
        inside = {(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.bigrams = np.array(sorted((a << 21) | b for a, b in inside), np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def counts(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each sequence of code points; starts has the end of the last one too."""
        at = np.minimum(np.searchsorted(self.chars, chars), len(self.chars) - 1)
        known = self.chars[at] == chars
        symbols = np.where(known, self.char_symbols[at], self.width - 1)
        size = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        sequence = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        total = np.bincount(sequence, np.where(known, 0, size), len(starts) - 1).astype(np.int64)
        # no merge crosses two characters that stand together in no piece, so sequences end there
        edge = np.ones(len(chars), bool)
        keys = (chars[:-1].astype(np.int64) << 21) | chars[1:]
        near = np.minimum(np.searchsorted(self.bigrams, keys), len(self.bigrams) - 1)
        edge[1:] = (self.bigrams[near] != keys) | (sequence[1:] != sequence[:-1])
        begins = np.flatnonzero(edge)
        owner, lengths = sequence[begins], np.diff(np.r_[begins, len(chars)])
        rank, merged = self.ranked(symbols, begins)
        while len(begins):
            best = np.minimum.reduceat(rank, begins)
            live = best < NONE
            if not live.all():
                done = np.repeat(~live, lengths)
                np.add.at(total, np.repeat(owner[~live], lengths[~live]), self.weights[symbols[done]])
                symbols, rank, merged = symbols[~done], rank[~done], merged[~done]
                best, owner, lengths = best[live], owner[live], lengths[live]
                begins = np.cumsum(lengths) - lengths
            if not len(begins):
                break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
            place = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            number = np.searchsorted(begins, place, "right") - 1
            place, number = self.until_lower(symbols, merged, begins, lengths, best, place, number)
            symbols[place] = merged[place]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            symbols, rank, merged = symbols[keep], rank[keep], merged[keep]
            begins = begins - np.searchsorted(place, begins)
            lengths = lengths - np.bincount(number, minlength=len(lengths))
            place = place - np.arange(len(place))
            last = place == (begins + lengths - 1)[number]
            right = place[~last]
            rank[place[last]] = NONE
            rank[right], merged[right] = self.pair(symbols[right], symbols[right + 1])
            left = place[place > begins[number]] - 1
            rank[left], merged[left] = self.pair(symbols[left], symbols[left + 1])
        return total

    def until_lower(self, symbols: np.ndarray, merged: np.ndarray, begins: np.ndarray, lengths: np.ndarray, best: np.ndarray, place: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that a sequence merges in this round: those up to the first whose new symbol forms a pair of a lower rank."""
        new, beside = merged[place], np.r_[False, (place[1:] == place[:-1] + 2) & (number[1:] == number[:-1])]
        before = np.where(beside, np.r_[new[:1], new[:-1]], symbols[np.maximum(place - 1, 0)])
        lower = (self.pair(before, new)[0] < best[number]) & (place > begins[number])
        behind = np.minimum(place + 2, len(symbols) - 1)
        lower |= (self.pair(new, symbols[behind])[0] < best[number]) & (place + 2 < (begins + lengths)[number])
        if not lower.any():
            return place, number
        seen = np.cumsum(lower) - lower
        first = np.searchsorted(number, number)  # where each sequence's places begin
        use = seen == seen[first]
        return place[use], number[use]

    def ranked(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], merged[:-1] = self.pair(symbols[:-1], symbols[1:])
            rank[begins[1:] - 1] = NONE
        return rank, merged


_MERGES: dict[str, Merges] = {}


class Counter:
    """Counts texts block by block and remembers the tokens of up to KNOWN distinct pre-tokens, each by its characters."""

    def __init__(self, path: str) -> None:
        self.merges = _MERGES.setdefault(path, None) or Merges(path)
        _MERGES[path] = self.merges
        self.tokens: dict[str, int] = {}

    def texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text: a space goes before each that isn't empty, and pre-tokens begin where spaces begin."""
        parts = [PRE_TOKEN.findall(" " + t) if t else [] for t in texts]
        if len(self.tokens) > KNOWN:
            self.tokens = {}
        new = list({w for p in parts for w in p if w not in self.tokens})
        if new:
            chars = np.frombuffer("".join(new).replace(" ", chr(MARK)).encode("utf-32-le"), np.uint32).astype(np.int64)
            self.tokens.update(zip(new, self.merges.counts(chars, np.r_[0, np.cumsum([len(w) for w in new])]).tolist(), strict=True))
        out = [sum(map(self.tokens.__getitem__, p)) for p in parts]
        for w in new:
            if len(w) > LONG:
                del self.tokens[w]
        return out


def _batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = Counter(path)
    for batch in batches:
        _, offsets, _ = buffers(batch.column(1))
        tokens = [n for a, b in blocks(offsets) for n in counter.texts(batch.column(1).slice(a, b - a).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])


def count_tokens(documents: DataFrame, model_path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row; model_path must be readable on every executor."""
    from pyspark.sql import functions as F

    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(partial(_batches, path=model_path), schema)
    return counted.select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_token_count": op6_token_count}
