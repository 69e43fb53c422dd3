"""Ranked lexical search and hard negatives against brute force, with odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lexical, negatives

# ---- ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for i, text in {(i, t) for i, t in items}:
        asked, found = Counter(terms(text)), []
        for d, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total if c else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_docs,slice_bytes,bundle", [(3, 1 << 20, 2), (1000, 1 << 20, 256), (7, 200, 5)])
def test_ranks_match_brute_force(spark, slice_docs, slice_bytes, bundle):
    rng = random.Random(slice_docs)
    words = ["the", "of", "Über", "ÜBER", "über", "a1", "x", "naïve", "日本", "rare%d"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join((rng.choice(words[:4] * 6 + words[4:]).replace("%d", str(rng.randrange(40)))) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 80]))) for i in range(90)]
    docs += [(i, "the of same words here") for i in range(200, 230)]  # ties
    docs += [(300, None), (301, ""), (302, "?! --"), (None, "rare1 rare2 the"), (303, "rare3 " * 30_000 + "z" * 100_000), (5, docs[5][1]), (304, "\x00nul\x7fdel rare5")]
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(11)] + [(50, None), (51, ""), (52, "nothing-of-this"), (53, "the the the same rare1"), (53, "rare5 rare5"), (0, "here"), (0, "here")]
    schema = "doc_id long, text string, item long, score string, slice int, rank string"
    df = spark.createDataFrame([(*d, 1, "s", 2, "r") for d in docs], schema).repartition(4)
    asked = spark.createDataFrame([(*i, 7, "t") for i in items], "item_id long, text string, doc_id long, term string")
    got = lexical.ranked_search(df, asked, k=4, slice_docs=slice_docs, slice_bytes=slice_bytes, bundle_items=bundle)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked(docs, items, 4)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 40


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.select("doc_id", F.lit(None).cast("string").alias("text")), items)):
        assert lexical.ranked_search(d, i).count() == 0
    # a term of every document has weight ln((2 N + 2) / (2 N + 1)), which rounds down to something above nothing for one document alone
    assert [tuple(r)[:3] for r in lexical.ranked_search(docs, items).collect()] == [(1, 1, 1)]


def test_long_texts_are_read_whole():
    for step in (1, 2, 7, 1 << 22):
        text = "ab cd-ÉÉ zz9" * 30
        assert lexical.term_counts(text.encode(), step) == Counter(t.encode() for t in re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))


# ---- hard negatives


def mined(rows, anchor, positives=5, most=10):
    whole = {(i, tuple(math.floor(256 * x) for x in e), lab) for i, e, lab in rows if i is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for a, x, lab in whole:
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, y, other in whole if i != a and len(y) == len(x))
        same, others = [s for s in scored if s[2] == lab][:positives], [s for s in scored if s[2] != lab]
        for p, i, _ in same:
            found = [s for s in others if 30 * -p <= 100 * -s[0] <= 90 * -p][:most]
            out |= {(a, i, r, j, -p, -s) for r, (s, j, _) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block,scale", [(16, 1.0), (1 << 16, 1.0), (40, 4096.0)])
def test_negatives_match_brute_force(spark, block, scale):
    rng = np.random.default_rng(block)
    rows = []
    for i in range(260):
        v = rng.normal(size=8) * scale
        v[: 3] *= 3  # dimensions of unlike energy
        rows.append((i, (v / 8).tolist(), int(rng.integers(0, 4))))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(60)] + [(2000 + i, rows[3][1], (rows[3][2] + 1) % 4) for i in range(60)]  # groups of copies, ties
    rows += [(3000 + i, rng.normal(size=3).tolist(), 1 + i % 2) for i in range(12)]  # another length
    rows += [(4000, None, 1), (4010, [1.0] * 8, None), (None, [1.0] * 8, 1), (4020, [1.0] * 7 + [None], 1), (4030, [float("nan")] * 8, 1), (4040, [float("inf")] + [1.0] * 7, 1), (4050, [], 1), (4060, [0.0] * 8, 2)]
    rows += [rows[7], rows[10], (20, rows[21][1], rows[21][2])]  # repeated rows, an id with a second vector
    df = spark.createDataFrame([(*r, 1, "c", 0.5) for r in rows], "vec_id long, embedding array<double>, label int, g int, cell string, score double").repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    # 20 has two vectors, so its results of both stand under one id; they are compared as sets
    assert set(found) == mined(rows, lambda i: i % 10 == 0) and len(found) > 500


def test_negatives_of_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label long"
    every = lambda rows: [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect()]
    assert every([]) == [] and every([(100, [1.0, 0.0], 1)]) == [] and every([(1, [1.0], 1), (2, [1.0], 2)]) == []
    # 0.9 is not quite 0.9 times 1 in floats: 230 of 256 is below the window's end, 256 above it
    assert sorted(every([(100, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.5, 0.0], 2), (4, [1.0, 0.0], 2), (5, [0.9, 0.0], 3)])) == [(100, 2, 1, 5, 65536, 58880), (100, 2, 2, 3, 65536, 32768)]
    # a positive with a negative score has no window, one of 0 takes scores of 0
    assert every([(100, [1.0], 1), (2, [-1.0], 1), (3, [-0.5], 2)]) == []
    assert every([(100, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (4, [1.0, 0.0], 2)]) == [(100, 2, 1, 3, 0, 0)]


def test_the_index_loses_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(20):
        rows = rng.integers(-300, 300, (200, 24)) * (rng.random((200, 24)) < 0.5)
        anchors = rng.integers(-300, 300, (9, 24)) // rng.integers(1, 9, (9, 1))
        least = rng.integers(-50_000, 400_000, 9)
        i, j, score = negatives.Index(rows.astype(np.int64)).reaching(anchors.astype(np.int64), least)
        exact = anchors @ rows.T
        good = score >= least[i]
        assert (score == exact[i, j]).all() and set(zip(i[good], j[good], strict=True)) == set(zip(*np.nonzero(exact >= least[:, None]), strict=True))
