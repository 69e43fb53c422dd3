"""Licence scan: Aho-Corasick finds phrases and tags, a shunting-yard parser evaluates and/or/with expressions.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text; each text is re-joined with single
spaces, so that one automaton pass finds every phrase that starts and ends at a word. A statement is read from its phrase
to the end of its and/or/with expression, however long; a phrase inside a statement that was read is part of it and starts
none of its own, so a text is read in time linear in its length. Behind a tag the expression is taken from the raw rest of
the line, where parentheses count. A null text is an empty one: no words, no labels, score 0. Repeated rows are scanned
each. Only the id and text columns are read. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.ragged import buffers
from lectern.session import table

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases after which a licence is named, and the tag that an expression follows.
NOTICES = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "license", "licence")
TAG = "spdx license identifier"
#: Names that a notice may give (as words), and how permissive each family is, from 0 to 1.
NAMES = {
    "gnu general public license": "gpl", "gpl": "gpl", "gnu lesser general public license": "lgpl", "lgpl": "lgpl",
    "gnu affero general public license": "agpl", "agpl": "agpl", "apache license": "apache", "apache": "apache",
    "mit license": "mit", "mit": "mit", "bsd license": "bsd", "bsd": "bsd", "mozilla public license": "mpl", "mpl": "mpl",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0", "isc": "isc", "unlicense": "unlicense", "public domain": "public-domain",
}
PERMISSIVE = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.9, "apache": 0.9, "cc-by": 0.85,
    "mpl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.15, "cc-by-nc-sa": 0.15, "cc-by-nd": 0.1, "cc-by-nc-nd": 0.05,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FILLERS = frozenset((b"the", b"a", b"an", b"either", b"of", b"terms"))
_TOKEN = re.compile(rb"[()\r\n]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_VERSION = re.compile(rb"v?[0-9]{1,2}")
_LONGEST = max(len(n.split()) for n in NAMES)


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: identifiers and and/or/with with parentheses, in postfix order; None if they form no expression."""
    out, held, operand = [], [], True
    for t in tokens:
        low = t.lower()
        if low in PRECEDENCE:
            if operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif t == "(":
            if not operand:
                return None
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if operand or not held:
                return None
            held.pop()
        else:
            if not operand:
                return None
            out.append(low)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def family(identifier: str) -> float:
    """How permissive a licence identifier is: by its longest known family, 0.4 where none is known."""
    known = [n for n in PERMISSIVE if identifier == n or identifier.startswith((n + "-", n + "+"))]
    return PERMISSIVE[max(known, key=len)] if known else 0.4


def evaluate(rpn: list[str]) -> tuple[float, set[str]]:
    """Permissiveness and licence identifiers of a postfix expression: `or` leaves the choice, `and` binds to the stricter
    side, and an exception after `with` loosens its licence a little and is no licence of its own."""
    stack: list[tuple[float, set[str]]] = []
    for t in rpn:
        if t not in PRECEDENCE:
            stack.append((family(t), {t}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((min(1.0, a + 0.1), left))
            continue
        small, large = sorted((left, right), key=len)
        large |= small
        stack.append((max(a, b) if t == "or" else min(a, b), large))
    return stack[0]


def longest_expression(tokens: Iterable[str]) -> list[str] | None:
    """The postfix form of the longest leading run of tokens that is an expression; reads no token beyond the one that ends it."""
    held: list[str] = []
    depth, end, operand = 0, 0, True
    for t in tokens:
        low = t.lower()
        depth += (t == "(") - (t == ")")
        # a second name with no operator between ends the expression, and so does an operator where a name must stand
        if depth < 0 or (operand and (low in PRECEDENCE or t == ")")) or (not operand and t == "(") or (not operand and low not in PRECEDENCE and t != ")"):
            break
        held.append(t)
        operand = t == "(" or low in PRECEDENCE
        if not operand and depth == 0:
            end = len(held)
    return postfix(held[:end]) if end else None


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def name_at(words: list[bytes], at: int) -> tuple[str, int]:
    """The longest licence name, with its version, that starts at a word, and the word after it; an empty name where none does."""
    for size in range(min(_LONGEST, len(words) - at), 0, -1):
        name = NAMES.get(b" ".join(words[at : at + size]).decode("latin-1"))
        if name:
            break
    else:
        return "", at
    at += size
    if at < len(words) and words[at] in (b"license", b"licence"):
        at += 1
    if at < len(words) and words[at] in (b"version", b"v"):
        at += 1
    version: list[str] = []
    while at < len(words) and len(version) < 2 and _VERSION.fullmatch(words[at]):
        version.append(words[at].decode().lstrip("v"))
        at += 1
    return name + ("-" + ".".join(version if len(version) > 1 else [*version, "0"]) if version else ""), at


def named(words: list[bytes], at: int) -> tuple[list[str], int]:
    """The expression of licence names that starts at a word, as tokens, and the word after its last name."""
    out, kept, end = [], 0, at
    while True:
        while at < len(words) and words[at] in FILLERS:
            at += 1
        name, at = name_at(words, at)
        if not name:
            break
        out.append(name)
        kept, end = len(out), at
        operator = words[at].decode("latin-1") if at < len(words) else ""
        if operator not in PRECEDENCE:
            break
        out.append(operator)
        at += 1
    return out[:kept], end


def scan(raw: bytes, machine) -> tuple:
    spaced = raw.translate(_SPACED)
    words = spaced.split()
    text = " " + b" ".join(words).decode("latin-1") + " "
    hits = list(machine.iter(text))
    if not hits:
        return len(words), 0, None, None, "", "", 0.0
    blank = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    after = np.searchsorted(blank, [end for end, _ in hits])  # the word behind each phrase: the blank before it has its number
    places, base, values, extra, starts, tags = [], set(), [], set(), [], []
    for word, (_, phrase) in zip(after.tolist(), hits, strict=True):
        if phrase in BASE:
            places.append(word - phrase.count(" ") - 1)
            base.add(BASE[phrase])
            starts.append(places[-1])
        elif phrase == TAG:
            tags.append(word)
        else:
            starts.append(word)

    def state(tokens: Iterable[str]) -> None:
        said = longest_expression(tokens)
        if said:
            value, leaves = evaluate(said)
            values.append(value)
            extra.update(leaves)

    read = 0
    for word in sorted(starts):
        if word >= read:
            tokens, read = named(words, word)
            state(tokens)
    if tags:
        inside = np.frombuffer(spaced, np.uint8) != 32
        ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
        for word in tags:
            found = (m[0].rstrip(b".-").decode("latin-1") for m in _TOKEN.finditer(raw, int(ends[word - 1])))
            state(takewhile(lambda t: t not in "\r\n", found))
    score = min(values) if values else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | extra)), score


FIELDS = (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    for batch in batches:
        data, offsets, _ = buffers(batch.column(1))
        raw = memoryview(np.ascontiguousarray(data))
        bounds = offsets.tolist()
        rows = [scan(bytes(raw[a:b]), machine) for a, b in zip(bounds, bounds[1:], strict=False)]
        columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *(n for n, _ in FIELDS)])


def scan_licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, places of the base phrases, base labels, all labels, and score: how permissive what the text states is.

    score is 0 where nothing is stated; a text with several statements is bound by the strictest of them.
    """
    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, t) for n, t in FIELDS)])
    return rows.mapInArrow(_batches, schema).withColumnRenamed("id", doc_id)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op5_license_scan": op5_license_scan}
