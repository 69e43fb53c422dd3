"""The subpackage's registered queries and the pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline
from lectern.llm import decontaminate, jaccard, quality, registry, secrets

ROOT = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{ROOT}/{f}'")
    want = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, ROOT)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def test_pipeline_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, ROOT))
        after = docs.collect()
        seen[name] = (before, after)
        if name != "mixed":
            assert docs.columns == columns
    before, after = seen["quality_filter"]
    frame = spark.createDataFrame([(k, v) for k, v in before.items()], "doc_id long, text string")
    model = quality.learned_from(spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet"))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in quality.score(frame, model).where("score >= 0.5").collect()}
    before, after = seen["one_of_each_group"]
    sets = {}
    for i, t in before.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    kept = sorted(r["doc_id"] for r in after)
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for x, a in enumerate(kept) for b in kept[x + 1 :])
    assert all(any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in before if j != i) for i in set(before) - set(kept))
    before, after = seen["without_benchmark"]
    frame = spark.createDataFrame([(k, v) for k, v in before.items()], "doc_id long, text string")
    bad = {r["doc_id"] for r in decontaminate.contaminated(frame, spark.read.parquet(f"{ROOT}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in after} == set(before) - bad
    before, after = seen["without_secrets"]
    assert {r["doc_id"] for r in after} == set(before) and all(r["n_chars"] == len(r["text"]) for r in after)
    assert secrets.scan_secrets(spark.createDataFrame([(r["doc_id"], r["text"]) for r in after], "doc_id long, text string")).where("size(secrets) > 0").count() == 0
    before, after = seen["mixed"]
    assert {r["doc_id"] for r in after} <= set(before) and len(after) >= 0.9 * len(before)


def test_jaccard_query_has_production_parameters():
    assert jaccard.op3_jaccard_join.__name__ == "op3_jaccard_join" and len(registry.QUERIES) == 13


def test_pipeline_takes_nulls_repeats_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, hub string"
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [(1, word * 3 + "one", "en", "a", 9, 0.1, "x"), (1, word * 3 + "one", "en", "a", 9, 0.1, "x"), (2, word * 3 + "one", None, None, None, None, None), (None, word + "two", "en", "a", 1, 0.0, "y"), (3, None, "en", "a", None, 0.0, "y"), (4, "", None, "b", 0, None, None), (5, "x" * 50_000 + " token = 04dbebab91ab85687d33eeaaf9ac699e1188f962", "en", "b", 1, 1.0, "z")]
    spark.createDataFrame([(1, 1), (2, None), (None, 0), (5, 0)], "doc_id long, quality int").where("doc_id is null or quality is null or doc_id = 1").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "a benchmark item that is in none of the documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, none = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path))), corpus_pipeline.materialise(stage(spark, none, str(tmp_path)))
        assert none.count() == 0 and set(schema.replace(",", "").split()[::2]) <= set(docs.columns), name
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "mixed":  # weights may leave documents out
            assert set(got) <= {1, None, 3, 4, 5}
        elif name != "quality_filter":
            assert set(got) == {1, None, 3, 4, 5} and got[3] is None and got[4] == ""
    assert 5 not in got or got[5].endswith("[secret]")


def test_rows_without_an_id_or_with_a_shared_one_are_judged_by_their_texts(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, secrets string, _new string, _quality double, _ruled string, epoch int, node string, key string, spans string, clean int, row string"
    rng = __import__("random").Random(3)
    prose = lambda n: " ".join(rng.choice(["river", "stone", "house", "green", "walks", "slowly", "over", "under", "light", "morning", "wind", "paper"]) for _ in range(n))
    item, a, b, c = prose(30), prose(60), prose(60), prose(60)
    extra = ("s", "n", 0.5, "r", 3, "x", "y", "z", 4, "w")
    rows = [
        (None, f"{prose(10)} {item} {prose(10)}", "en", "a", 1, *extra), (7, a, "en", "a", 1, *extra), (7, b, "en", "a", 1, *extra), (7, b, "en", "a", 1, *extra),
        (None, a + " more", "en", "a", 1, *extra), (None, c, "de", None, None, *extra), (None, c, None, "b", None, *extra), (8, f"{prose(9)} token = 04dbebab91ab85687d33eeaaf9ac699e1188f962", "en", "a", 1, *extra),
    ]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "river")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)))
        seen[name] = docs.collect()
        if name != "mixed":
            assert docs.columns == schema.replace(",", "").split()[::2] and all(tuple(r[5:]) == extra for r in seen[name]), name
    assert len(seen["quality_filter"]) == len(rows)
    # the copy of a without an id goes, of the two rows of c and of the repeated row one each, and both texts of id 7 stay
    assert sorted((r["doc_id"] or 0, r["text"]) for r in seen["one_of_each_group"]) == sorted((i or 0, t) for i, t in {(r[0], r[1]) for r in rows} - {(None, a + " more")})
    assert {r["text"] for r in seen["without_benchmark"]} == {a, b, c, rows[-1][1]}
    assert [r["text"].split()[-1] for r in seen["without_secrets"] if r["doc_id"] == 8] == ["[secret]"]
    assert {"secrets", "_new", "epoch_in", "epoch", "mix_order"} <= set(docs.columns) and all(r["epoch_in"] == 3 for r in seen["mixed"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["mixed"])
