"""Inputs made against hashing, splitting and allow lists, and rows at the edge of what ids can be."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, licenses, mixture, secrets, token_count, vector_dedup
from lectern.llm.rows import numbered

DOCS = "doc_id long, text string"


def thue_morse(a, b, doublings=10):
    word = a
    other = b
    for _ in range(doublings):
        word, other = word + other, other + word
    return word, other


@pytest.mark.parametrize("a,b", [("e", "x"), ("t", "h"), ("a", "b")])
def test_words_built_against_polynomial_hashes_stay_apart(spark, a, b):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    one, two = thue_morse(a, b)
    docs = [(1, one), (2, two), (3, f"common {one}"), (4, f"common {two}"), (5, f"{one}{two}"), (6, f"{two}{one}")]
    df = spark.createDataFrame(docs, DOCS).coalesce(1)
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(df, path).collect()}
    assert got == {i: len(model.encode(t)) for i, t in docs}
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert found == {i: i for i, _ in docs}


def test_a_schedule_does_not_depend_on_how_files_are_split(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None if i % 7 == 0 else i, rng.choice("aab"), " ".join(["w"] * rng.randint(1, 40)), i) for i in range(2000)]
    rows += [(5, "a", "same row " * 5, -1)] * 6000 + [(5, "a", "same row " * 5, None)] * 3
    spark.createDataFrame(rows, "doc_id long, source string, text string, extra long").repartition(5).write.parquet(f"{tmp_path}/d")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism")
    before = {k: spark.conf.get(k, None) for k in keys}
    seen = []
    try:
        for plan, action in ((("128m", "2"), ("2k", "16")), (("4k", "7"), ("128m", "1"))):
            for k, v in zip(keys, plan, strict=True):
                spark.conf.set(k, v)
            scheduled = mixture.mix_sources(spark.read.parquet(f"{tmp_path}/d"), budget_share=0.7, block_docs=64)
            for k, v in zip(keys, action, strict=True):
                spark.conf.set(k, v)
            seen.append(sorted(scheduled.collect(), key=repr))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert seen[0] == seen[1]
    total = sum(len(r[2].split()) for r in rows)
    for s in "ab":
        used = sum(r["n_tokens"] for r in seen[0] if r["source"] == s)
        want = next(r["target_weight"] for r in seen[0] if r["source"] == s) * total * 0.7
        assert want - 40 < used <= want + 1e-6
    assert len({r["mix_order"] for r in seen[0]}) > 0.99 * len(seen[0])


def test_one_substituted_word_in_a_short_item_is_found(spark):
    items, docs, want = [], [], set()
    for n in (5, 6, 7):
        for gone in range(n):
            k = n * 10 + gone
            words = [f"w{k}x{j}" for j in range(n)]
            items.append((k, " ".join(words)))
            docs.append((k, " ".join(["before", *words[:gone], "other", *words[gone + 1 :], "after"])))
            want.add((k, k))
            docs.append((1000 + k, " ".join(["before", *words[:gone], "other", *words[gone + 2 :], "after"])))  # one word is gone and one is missing
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= got and all(d - 1000 in (n * 10 + g for n in (5, 6, 7) for g in (0, n - 2, n - 1)) for d, _ in got - want)


def test_a_key_beside_an_example_is_found(spark):
    rng = random.Random(1)
    key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(37))
    texts = [f"/docs/example/{key}", f"example={key}", f"{key}/example", f"see {key}-placeholder-{key[::-1]} there", "AKIAI-OSFODNN7EXAMPLE-short", "/docs/example/of-the-documentation/more", f"{key}"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: [s.split(":") for s in r["s"].split(",") if s.startswith("entropy")] for r in secrets.scan_secrets(df).select("doc_id", secrets.joined(F.col("secrets")).alias("s")).collect()}
    found = {i: [texts[i][int(a) : int(b)] for _, a, b in v] for i, v in got.items()}
    assert found[0] == [key] and found[1] == [key] and found[6] == [key]
    assert found[2] == [key + "/"] and found[3] == [key + "-", key[::-1]] and found[4] == [] and found[5] == []


def test_tags_without_an_expression_take_linear_time(spark):
    machine = licenses.automaton()
    for word in (b"and", b"or", b"with", b")", b"(", b"mit or", b"( mit and"):
        text = b"SPDX-License-Identifier " + word + b" "
        began = time.perf_counter()
        licenses.scan(text * (1_000_000 // len(text)), machine)
        assert time.perf_counter() - began < 20, word


def test_an_id_of_two_vectors_counts_each_link_once(spark):
    near = lambda x: [1.0, x, 0.0, 0.0]
    df = spark.createDataFrame([(1, near(0.0), 0), (1, near(0.01), 0), (2, near(0.02), 0), (3, [0.0, 0.0, 1.0, 0.0], 0), (3, [0.0, 0.0, 0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in vector_dedup.near_duplicate_vectors(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True)]


def test_rows_are_numbered_up_to_the_largest_id(spark):
    top = (1 << 63) - 1
    rows = [(top, "a"), (top - 1, "b"), (-top - 1, "c"), (5, "d"), (5, "e"), (None, "f"), (None, "f"), (7, "g"), (1 << 62, "h")]
    got = {(r["doc_id"], r["text"]): r["n"] for r in numbered(spark.createDataFrame(rows, DOCS), "n").collect()}
    assert len(set(got.values())) == len(got) == 8 and got[7, "g"] == 7 and got[1 << 62, "h"] == 1 << 62
    assert got[top - 1, "b"] < got[top, "a"] < got[None, "f"]


def test_hashes_of_rows_tell_nulls_from_their_neighbours(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "a"), (None, None)], "x string, y string")
    assert df.select(*mixture.row_hashes(df.columns)).distinct().count() == 4
