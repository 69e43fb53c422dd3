"""Jaccard join and vector deduplication against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest

from lectern.llm import components, jaccard, vector_dedup
from lectern.llm.ragged import shingles, words


def roots(n, links):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def brute(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in roots(ids, links).items()}, len(links)


def corpus(seed, n=140):
    rng = random.Random(seed)
    vocabulary = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 150]))] for _ in range(8)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [], [w[at], rng.choice(vocabulary)]])
                w = w or ["x"]
        elif kind < 0.8:
            w = passage + [rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 30]))]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        text = " ".join(w)
        docs.append((i * 3 + 1, text.upper() if rng.random() < 0.1 else text))
    return docs


@pytest.mark.parametrize("seed,k,num,rare,rows", [(1, 4, 85, 32, 512), (2, 4, 85, 2, 8), (3, 5, 80, 3, 6), (4, 3, 70, 1, 4)])
def test_components_match_brute_force(spark, seed, k, num, rare, rows):
    docs = corpus(seed)
    want, links = brute(docs, k, num, 100)
    assert links > 50
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k, (num, 100), rare=rare, block_docs=40, bucket_tokens=500, block_rows=rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_prefixes_of_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 80))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        n = len(base)
        lose, gain = rng.integers(0, max(1, n // 6) + 1, 2)
        other = np.unique(np.r_[rng.permutation(base)[lose:], rng.integers(0, 1 << 63, gain, dtype=np.uint64)])
        both = len(np.intersect1d(base, other))
        if not both or 100 * both < 85 * (n + len(other) - both):
            continue
        kind = {int(t): int(rng.integers(1, 3)) for t in np.union1d(base, other)}
        for t in np.setxor1d(base, other):
            kind[int(t)] = int(rng.integers(0, 3))
        signed = [set(jaccard.signatures(x, np.array([kind[int(t)] for t in x]), (85, 100)).tolist()) for x in (base, other)]
        assert signed[0] & signed[1]


def test_jaccard_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one two", "x"), (5, "One TWO", "x"), (5, "One TWO", "x"), (None, "one two", "x"), (6, "a " * 5000, "x"), (7, "a " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, 4, (85, 100)).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, None), (6, 1, 6), (7, 1, 6)], key=repr)
    empty = jaccard.jaccard_components(df.limit(0), 4, (85, 100))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_words_and_shingles_are_those_of_the_pattern():
    texts = ["Ab  cD\tef", "", "x", "é ü É", " a b c d e "]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashed, before = words(np.frombuffer(raw, np.uint8), offsets)
    assert np.diff(before).tolist() == [3, 0, 1, 3, 5]
    again, _ = words(np.frombuffer(b"ab cd", np.uint8), np.array([0, 5]))
    assert hashed[:2].tolist() == again.tolist() and hashed[4] != hashed[6]  # only A-Z are lowered
    tokens, sizes = shingles(hashed, before, 4)
    assert np.diff(sizes).tolist() == [1, 0, 1, 1, 2]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 90)] + [(7, 7), (None, 3), (300, 200), (300, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[j] == 5 for j in range(5, 90)) and got[300] == got[200] == 200 and 3 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_are_stars_take_one_round_and_no_links_none(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialise", lambda df, kept=components.materialise: written.append(df) or kept(df))
    top = 2**63 - 1
    stars = [(i, i % 4) for i in range(4, 60)] + [(0, 8), (top, top - 2), (top - 2, top - 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: i % 4 for i in range(60)} | {top: top - 2, top - 1: top - 2, top - 2: top - 2} and len(written) == 2
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0 and len(written) == 3


def vectors(seed, n=300, size=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 3 and out:
            v = np.array(out[rng.integers(len(out))][1]) + rng.normal(0, rng.choice([0.0, 0.02, 0.05]), size)
        else:
            v = rng.normal(size=size)
        out.append((i * 2, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return out


def expected(rows):
    """Links and components by comparing all pairs of equal label and length."""
    count, links = {i: 0 for i, _, _ in rows}, []
    for x, (i, v, a) in enumerate(rows):
        for j, w, b in rows[x + 1 :]:
            if a == b and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    return count, roots([r[0] for r in rows], links)


@pytest.mark.parametrize("block,spread", [(2048, 2.0), (16, 2.0), (5, 0.05)])
def test_vectors_match_brute_force(spark, block, spread):
    rows = vectors(1)
    count, component = expected(rows)
    got = vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block, spread=spread).collect()
    assert len(got) == len(rows) and sum(count.values()) > 200
    assert all(r["n_links"] <= count[r["vec_id"]] for r in got)  # nothing below the threshold is linked
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(count.values())
    assert np.mean([component[r["vec_id"]] == r["component_id"] for r in got]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_pairs_at_the_threshold_are_found(spark):
    """Partners at a cosine of 0.9801 among random vectors, for ids divisible by 20 against all rows."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(0.9801)
    both = np.r_[base, np.cos(angle) * base + np.sin(angle) * side]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicate_vectors(df).collect()}
    queries = range(0, 6000, 20)
    want = (both[queries] @ both.T >= 0.98).sum() - len(queries)
    assert want >= 300 and sum(got[i] for i in queries) >= 0.99 * want


def test_vectors_of_mixed_lengths(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        size = (8, 8, 8, 3, 20, 1)[i % 6]
        v = rng.normal(size=size) if i < 60 else np.array(rows[i - 60][1]) + rng.normal(0, 0.01, size)
        rows.append((i, v.tolist(), i % 2))
    count, component = expected(rows)
    df = spark.createDataFrame([*rows, (500, [], 0), (501, [1e200, 1e200, 0.0], 7), (502, [1e-200, 1e-200, 0.0], 7)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert got == {**{i: (count[i], component[i]) for i in count}, 500: (0, 500), 501: (1, 501), 502: (1, 501)}


def test_a_third_of_the_vectors_in_one_near_copy_group(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64) / 8
    rows = []
    for i in range(1500):
        v = centre + rng.normal(0, rng.choice([0.005, 0.01, 0.016]), 64) if i % 3 == 0 else rng.normal(size=64)
        rows.append((i, [float(np.float32(x)) for x in v], 1))
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    assert abs(cosine - 0.98).min() > 1e-12
    near = (cosine >= 0.98) & ~np.eye(len(rows), dtype=bool)
    want = roots(range(len(rows)), [(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    assert near.sum() > 100_000
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block, spread in ((2048, 2.0), (64, 8.0)):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicate_vectors(df, block=block, spread=spread).collect()}
        assert all(got[i][0] <= near[i].sum() for i in want) and sum(n for n, _ in got.values()) >= 0.999 * near.sum()
        assert {i: c for i, (_, c) in got.items()} == want


def test_vector_edge_cases(spark):
    v, nan = [1.0, 2.0], float("nan")
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [1.0], 1), (10, v, 2), (11, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)}}
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).count() == 0
