"""Best-fit packing of token sequences, with repacking where a lower bound leaves a gap.

A document's tokens are those of a tokenizer file without special tokens, then an end token. Documents longer than a
sequence are cut into whole sequences and a last piece; nothing else is cut. Whole pieces are sequences of their own. The
others are dealt into groups of about `group_pieces`; each group packs its pieces by best fit, longest first, inside a task.

Dual-feasible functions give a lower bound of each group's sequences: a function that maps lengths so that no sequence
that is feasible exceeds one, summed over the lengths. A group that needs less than one sequence more than its bound is
certified. Groups with a gap give up the documents of all their open sequences, certified groups those of their emptiest
sequence alone (that is where the rounding of many groups stands), and what was given up is dealt into new groups, by other
hashes, and packed again. This ends with a single group, or when a round saves no sequence, whose packing is then dropped.
What is exchanged shrinks with each round, as full sequences never return.

Every row of documents is packed, with or without an id, repeated or not; a null text is an empty one, whose only token is
the end. An empty table gives no pieces. Only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import materialise, table

#: Words and pre-tokens whose ids a worker remembers, and the longest of them.
KNOWN, LONG = 800_000, 64
#: Words whose normal form is their lower case: ASCII and letters of the Latin blocks that stand for themselves there.
LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
PLAIN = re.compile(f"[!-~{LETTERS}]*")
#: Fixed value: the pre-tokens of such words, as the tokenizer file's own pattern cuts them.
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^a-z0-9{LETTERS}]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Kept(dict):
    """A dictionary that asks for what it lacks, and keeps it if it is short, up to KNOWN entries."""

    def __init__(self, ask: Callable[[str], bytes]) -> None:
        super().__init__()
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        found = self.ask(word)
        if len(word) <= LONG:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by the library, which is asked once for each distinct pre-token.

    For byte-level tokenizers in lower case whose pre-tokens never hold a blank, so that the ids of a text are those of its
    parts between blanks. Plain words are cut into pre-tokens here and the library's model is asked for these; words with
    other characters, or with a special token's brackets, go to the whole library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words, self.pieces = _Kept(self.word), _Kept(self.piece)

    def piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return packed_ids([t.id for t in self.model.tokenize(spelled)])

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.pieces.__getitem__, PRE_TOKEN.findall(word.lower())))
        return packed_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A worker's encoder of that file, with all that it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int, end: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece of each document; `no` is a number of its own."""
    encoder, no, last = encoder_of(path), TaskContext.get().partitionId() << 36, packed_ids([end])
    for batch in batches:
        row, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            ids = memoryview(encoder.encode(text.as_py() or "") + last)
            for k, at in enumerate(range(0, len(ids), 4 * limit)):
                part = ids[at : at + 4 * limit]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        numbers = pa.array(np.arange(no, no + len(row), dtype=np.int64))
        no += len(row)
        columns = [numbers, batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        yield pa.RecordBatch.from_arrays(columns, ["no", "doc_id", "piece", "start", "length", "ids_crc32"])


def lower_bound(lengths: np.ndarray, limit: int, most: int = 64) -> float:
    """Sequences that the lengths need at least, before rounding up: the best of two families of dual-feasible functions.

    The first drops lengths below k and counts those above limit - k whole, for every k up to half the limit. The second
    rounds (k + 1) * length / limit down to k-ths, for k up to `most`, and leaves lengths alone where that is a whole number.
    """
    counts = np.bincount(lengths, minlength=limit + 1)[: limit + 1].astype(np.int64)
    size = np.arange(limit + 1, dtype=np.int64)
    total, number = np.cumsum(counts * size), np.cumsum(counts)
    k = np.arange(1, limit // 2 + 1)
    first = total[limit - k] - total[k - 1] + limit * (number[-1] - number[limit - k])
    best = max(int(total[-1]), int(first.max(initial=0))) / limit
    for k in range(1, most + 1):
        whole = (k + 1) * size % limit == 0
        best = max(best, int((counts * np.where(whole, k * size, (k + 1) * size // limit * limit)).sum()) / (k * limit))
    return best


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the place in it of each length: longest first, each in the sequence with the least room that takes it."""
    sequence, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, levels, count = 0, {}, 0  # bit r of open_ is set if a sequence has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = levels[room].pop()
            if not levels[room]:
                open_ ^= 1 << room
        else:
            room, at = limit, count
            count += 1
        sequence[i], place[i] = at, limit - room
        if room > n:
            levels.setdefault(room - n, []).append(at)
            open_ |= 1 << (room - n)
    return sequence, place


def _pack(group: pa.Table, limit: int) -> pa.Table:
    """Pieces of one group with sequence, offset and whether their sequence is given up; a sequence's number is that of its first piece."""
    group = group.sort_by("no")
    lengths = group["length"].to_numpy()
    sequence, place = best_fit_decreasing(lengths, limit)
    filled = np.bincount(sequence, lengths)
    released = np.zeros(len(filled), bool)
    if len(filled) - lower_bound(lengths, limit) >= 1:
        released = filled < limit
    elif filled.min() < limit:
        released[filled.argmin()] = True
    leader = np.zeros(len(filled), np.int64)
    leader[sequence[place == 0]] = group["no"].to_numpy()[place == 0]
    group = group.drop_columns(["deal"])
    return group.append_column("sequence_id", pa.array(leader[sequence])).append_column("offset", pa.array(place)).append_column("released", pa.array(released[sequence]))


def pack_documents(documents: DataFrame, tokenizer_path: str, limit: int = 4096, end: int = 1, group_pieces: int = 4096, rounds: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    tokenizer_path must be readable on every executor. Each round's packing is written once, so that nothing is dealt anew
    if an executor is lost.
    """
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("no", T.LongType()), rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    pieces = materialise(rows.mapInArrow(partial(_pieces, path=tokenizer_path, limit=limit, end=end), schema))
    packed_schema = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("released", T.BooleanType())])

    def pack(group: pa.Table) -> pa.Table:
        return _pack(group, limit)

    place = {"sequence_id": F.col("no"), "offset": F.lit(0).cast("long")}
    done = [pieces.where(F.col("length") == limit).withColumns(place)]
    loose = pieces.where(F.col("length") < limit)
    kept, before = None, math.inf  # what was given up last, as it is packed so far, and its sequences
    for turn in range(rounds):
        waiting = loose.count() if turn == 0 else kept.count()
        if not waiting:
            break
        groups = math.ceil(waiting / group_pieces)
        deal = F.pmod(F.xxhash64(F.lit(turn), "no"), F.lit(groups)).cast("int").alias("deal")
        packed = materialise(loose.select(deal, "*").groupBy("deal").applyInArrow(pack, packed_schema))
        sequences, given = packed.where("offset = 0").agg(F.count("*"), F.count_if("released")).first()
        if sequences >= before:
            break
        done.append(packed.where("not released").drop("released"))
        kept, before = packed.where("released").drop("released"), given
        if groups == 1:
            break
        loose = kept.drop("sequence_id", "offset")
    if kept is not None:
        done.append(kept)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("doc_id").alias(doc_id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op13_best_fit_packing": op13_best_fit_packing}
