"""Features, folds, metrics, tracing and the recommender against hand-computed values and plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import folds
from lectern.operators import bkt, features, marts, ml, online, ranges, recsys

CLICKS = "id_student int, code_module string, code_presentation string, date int, sum_click int"


def test_vle_features_of_one_day(spark):
    clicks = [(28400, "A", "P", -10, c) for c in (17, 3, 3, 3, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5)] + [(1, "A", "P", None, 5), (1, "A", "P", 31, 5)]
    got = features.vle_features(spark.createDataFrame(clicks, CLICKS), 30).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["total_clicks"], r["active_days"], r["avg_daily_clicks"], r["max_clicks_day"], r["engagement_span"], r["recency_days"], r["recent_weekly_rate"], r["engagement_momentum"]) == (70, 1, 5.0, 17, 0, 40, None, -5.0)


def test_recent_week_is_half_open(spark):
    rows = [(1, "A", "P", d, 7) for d in (23, 24, 30)]
    assert features.vle_features(spark.createDataFrame(rows, CLICKS), 30).first()["recent_weekly_rate"] == 2.0


def test_weighted_average_needs_weight(spark):
    defs = spark.createDataFrame([(1, "A", "P", 10, 0.0), (2, "A", "P", None, 20.0), (3, "A", "P", 31, 50.0)], "id_assessment int, code_module string, code_presentation string, date int, weight double")
    subs = spark.createDataFrame([(1, 9, 50.0, 1), (2, 9, 80.0, None), (2, 9, None, 0), (3, 9, 1.0, 0), (1, 8, 40.0, 0)], "id_assessment int, id_student int, score double, is_banked int")
    got = {r["id_student"]: r for r in features.assessment_features(subs, defs, 30).collect()}
    assert got[8]["weighted_avg"] is None and got[9]["weighted_avg"] == 40.0  # the NULL score still adds its weight
    assert (got[9]["submission_count"], got[9]["late_submissions"], got[9]["min_score"]) == (3, 1, 50.0)


def test_feature_as_of_respects_ttl_and_ties(spark):
    f = spark.createDataFrame([(1, "2024-01-01", 1.0, 1), (1, "2024-01-05", 2.0, 1), (1, "2024-01-05", 3.0, 2)], "k int, t string, value double, created int").withColumn("event_time", F.to_timestamp("t"))
    q = spark.createDataFrame([(10, 1, "2024-01-05"), (11, 1, "2024-01-04"), (12, 1, "2024-03-01"), (13, 2, "2024-01-05")], "query_id long, k int, t string").withColumn("event_time", F.to_timestamp("t"))
    got = {r["query_id"]: r["value"] for r in features.feature_as_of(q, f, ["k"], ttl_days=30).collect()}
    assert got == {10: 3.0, 11: 1.0, 12: None, 13: None}


def test_bkt_fold(spark):
    df = spark.createDataFrame([([1, 1, 0],)], "a array<int>")
    trace = df.select(folds.bkt_trace(F.col("a")).alias("t")).first()["t"]
    assert trace[-1]["p_known_after"] == pytest.approx(0.7553591435329267, abs=1e-12)
    assert [x["p_known_before"] for x in trace][1:] == [x["p_known_after"] for x in trace][:-1]


def test_online_mastery_rises_and_stays_a_probability(spark):
    got = spark.range(0, 101).select(folds.online_mastery(F.lit(0.4), F.col("id").cast("double")).alias("m")).collect()
    values = [r["m"] for r in got]
    assert values[100] > 0.4 and values[0] < values[100] and all(0 <= v <= 1 for v in values)


def test_bkt_fit_recovers_what_made_the_answers(spark):
    rng = random.Random(3)
    rows = []
    for user in range(400):
        known = rng.random() < 0.3
        for i in range(1, 13):
            rows.append((user, "s", i, int(rng.random() < (0.9 if known else 0.2))))
            known = known or rng.random() < 0.2
    p = bkt.fit(spark.createDataFrame(rows, "user_id int, skill_name string, order_id int, correct int"), rounds=12).first()
    assert abs(p["prior"] - 0.3) < 0.12 and abs(p["learn"] - 0.2) < 0.08 and abs(p["guess"] - 0.2) < 0.08 and abs(p["slip"] - 0.1) < 0.06


def test_metrics_with_ties_match_pairs(spark):
    rng = random.Random(1)
    data = [("g", rng.randint(0, 5) / 5, rng.randint(0, 1)) for _ in range(80)] + [("one", 0.5, 1)]
    df = spark.createDataFrame(data, "g string, score double, label int")
    auc = {r["g"]: r["auc"] for r in ml.roc_auc(df, ["g"]).collect()}
    pos = [s for g, s, y in data if g == "g" and y]
    neg = [s for g, s, y in data if g == "g" and not y]
    assert auc["g"] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])) and auc["one"] is None
    ap = {r["g"]: r["average_precision"] for r in ml.average_precision(df, ["g"]).collect()}
    assert ap["one"] == 1.0 and 0 < ap["g"] <= 1


def test_top_k_equals_full_sort(spark):
    rng = np.random.default_rng(0)
    users, items = rng.normal(size=(20, 4)).round(3), rng.normal(size=(50, 4)).round(3)
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "node long, vector array<double>")
    got = {(r["user"], r["rank"]): r["item"] for r in recsys.top_k(frame(users), frame(items), 5, block_bytes=7 * 32).collect()}
    scores = users @ items.T
    for u in range(20):
        assert [got[u, r] for r in range(1, 6)] == sorted(range(50), key=lambda i: (-round(float(scores[u, i]), 9), i))[:5]


def test_ties_go_to_the_smaller_item_and_exclusions_to_their_blocks(spark):
    users = spark.createDataFrame([(f"u{i}", [1.0, 0.1 * i]) for i in range(30)] + [("zero", [0.0, 0.0]), ("none", None)], "node string, vector array<double>")
    items = spark.createDataFrame([(i, [0.3, 0.7]) for i in range(40)] + [(40 + i, [0.1, 0.1 * (i % 3)]) for i in range(40)], "node long, vector array<double>")
    pairs = [(f"u{i}", j) for i in range(30) for j in range(0, 40, 1 + i % 3)] + [("u1", 999), ("nobody", 1), (None, 1)]
    got = {}
    for r in recsys.top_k(users, items, 4, exclude=spark.createDataFrame(pairs, "user string, item long"), block_bytes=200).collect():
        got.setdefault(r["user"], []).append((r["rank"], r["item"]))
    for u in range(30):
        left = [j for j in range(80) if (f"u{u}", j) not in set(pairs)]
        score = lambda j: 0.3 + 0.07 * u if j < 40 else 0.1 + 0.01 * u * ((j - 40) % 3)  # noqa: B023, E731
        assert [j for _, j in sorted(got[f"u{u}"])] == sorted(left, key=lambda j: (-round(score(j), 9), j))[:4]
    assert sorted(got["zero"]) == [(1, 0), (2, 1), (3, 2), (4, 3)] and "none" not in got


def test_embeddings_keep_ids_beyond_ints(spark):
    far = 10**12
    edges = spark.createDataFrame([(far + u, far * 3 + i) for u in range(20) for i in range(12) if (u < 10) == (i < 6)], "user long, item long")
    users, items = recsys.base_embeddings(edges, size=4, iterations=4)
    assert {r["node"] for r in users.collect()} == {far + u for u in range(20)} and items.count() == 12
    top = recsys.top_k(users, items, 3).collect()
    assert all((r["user"] - far < 10) == (r["item"] - far * 3 < 6) for r in top) and len(top) == 60


def test_column_functions_of_vectors_agree_with_top_k(spark):
    from lectern.functions import vectors as V

    rng = np.random.default_rng(4)
    m = rng.normal(size=(6, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "node long, vector array<double>")
    pairs = df.select(F.col("node").alias("user"), F.col("vector").alias("u")).crossJoin(df.select(F.col("node").alias("item"), F.col("vector").alias("v")))
    for kind, f in (("dot", V.dot), ("match", V.match_percent)):
        want = {(r["user"], r["item"]): r["s"] for r in pairs.select("user", "item", f(F.col("u"), F.col("v")).alias("s")).collect()}
        got = recsys.top_k(df, df, 6, score=kind).collect()
        assert len(got) == 36 and all(abs(want[r["user"], r["item"]] - r["score"]) < 1e-9 for r in got)
    unit = pairs.select(V.norm(V.shifted(F.col("u"), F.col("v"), unit=True)).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-6 for r in unit)


def test_top_k_with_few_items_and_exclusions(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0])], "node long, vector array<double>")
    seen = spark.createDataFrame([(1, 1)], "user long, item long")
    got = recsys.top_k(one, one, 5, exclude=seen)
    assert sorted((r["user"], r["item"], r["rank"]) for r in got.collect()) == [(1, 2, 1), (2, 1, 1), (2, 2, 2)]


def test_negative_samples_are_no_edges(spark):
    edges = spark.createDataFrame([(u, (u * 7 + j) % 30) for u in range(20) for j in range(5)], "user long, item long")
    got = recsys.negative_samples(edges)
    assert got.join(edges.withColumnRenamed("item", "negative"), ["user", "negative"]).count() == 0 and got.count() > 90


def test_every_pair_of_a_user_who_lacks_an_item_has_negatives(spark):
    held = {0: range(20), 1: range(19), 2: range(1, 20), 3: [i for i in range(20) if i != 9], 4: [7], 5: range(0, 20, 2), 6: range(8, 12)}
    edges = spark.createDataFrame([(u, i) for u, items in held.items() for i in items], "user long, item long")
    for bucket in (4, 4096):
        got = [(r["user"], r["item"], r["negative"]) for r in recsys.negative_samples(edges, per_pair=3, bucket=bucket).collect()]
        assert all(n not in held[u] and n in range(20) for u, _, n in got)
        assert Counter((u, i) for u, i, _ in got) == {(u, i): 3 for u, items in held.items() if u for i in items}
        assert {n for u, _, n in got if u == 5} == set(range(1, 20, 2))


def test_numbering_is_contiguous(spark):
    df = spark.createDataFrame([(x * 3,) for x in range(500)], "v long")
    got = recsys.numbering(df, "v").orderBy("v").collect()
    assert [r["index"] for r in got] == list(range(500))


def test_split_weights_and_classifier(spark):
    rng = random.Random(0)
    rows = [(i, "2014B" if i % 4 == 0 else "2013J", float(i % 50), None if i % 9 == 0 else "r" + str(i % 3), "Success" if i % 50 > 25 else ("Fail" if rng.random() < 0.5 else "Withdrawn")) for i in range(400)]
    df = ml.temporal_split(spark.createDataFrame(rows, "id_student int, code_presentation string, clicks double, region string, target_class string"))
    assert df.where("is_test").count() == 100
    weighted = ml.class_weights(df.where("not is_test"), "target_class")
    model = ml.classifier(["clicks"], ["region"]).fit(weighted)
    out = ml.scored(model, df, ["id_student"])
    r = out.withColumn("s", F.col("prob_Fail") + F.col("prob_Success") + F.col("prob_Withdrawn")).agg(F.min("s"), F.max("s"), F.count("*")).first()
    assert r[0] == pytest.approx(1) and r[1] == pytest.approx(1) and r[2] == 400
    right = out.join(df.select("id_student", "clicks"), "id_student").where("(predicted_class = 'Success') = (clicks > 25)").count()
    assert right > 380


def test_pieces_of_a_history_give_what_the_whole_gives(spark):
    rng = random.Random(11)
    rows = [(u, s, i, int(rng.random() < 0.3 + 0.1 * u)) for u in range(6) for s in "ab" for i in range(1, 2 + rng.randint(0, 25) * (u + 1))]
    graded = spark.createDataFrame(rows, "user_id int, skill_name string, order_id int, correct int")
    parameters = spark.createDataFrame([("a", 0.3, 0.2, 0.25, 0.15)], "skill_name string, prior double, learn double, guess double, slip double")
    key = lambda r: (r["user_id"], r["skill_name"], r["order_id"])
    whole = {key(r): (r["answer"], r["p_known_before"], r["p_correct"], r["p_known_after"]) for r in bkt.predict(graded, parameters).collect()}
    cut = {key(r): (r["answer"], r["p_known_before"], r["p_correct"], r["p_known_after"]) for r in bkt.predict(graded, parameters, size=4).collect()}
    assert set(whole) == set(cut) == {r[:3] for r in rows} and all(np.allclose(whole[k], cut[k], atol=1e-12) for k in whole)
    fitted = [{r["skill_name"]: tuple(r)[1:] for r in bkt.fit(graded, rounds=3, size=n).collect()} for n in (4096, 5)]
    assert all(np.allclose(fitted[0][s], fitted[1][s], atol=1e-9) for s in "ab")


def test_online_features_equal_a_fold_over_the_history(spark):
    from lectern.streaming import state

    rng = random.Random(2)
    rows = [(u, i, float(rng.randint(0, 20)), float(rng.randint(0, 100))) for u in range(4) for i in range(1 + 30 * u)]
    df = spark.createDataFrame(rows, "id_student int, ts int, clicks double, score double")
    clicks = {r["id_student"]: r for r in online.online_clicks(df, order=("ts",)).collect()}
    mastery = {r["id_student"]: r for r in online.mastery_updates(df, ["id_student"], ["ts"]).collect()}
    for u in range(4):
        c, s = state.START
        for _, _, count, score in [r for r in rows if r[0] == u]:
            c, s = state.click(c, count), state.submission(s, score)
        r = clicks[u]
        assert np.allclose([r["total_clicks"], r["active_days"], r["avg_daily_clicks"], r["max_clicks_day"], r["engagement_span"], r["recent_weekly_rate"]], c)
        assert mastery[u]["submissions"] == s[0] and mastery[u]["mastery"] == pytest.approx(s[3], abs=1e-9)


def test_vectors_move_step_by_step(spark):
    rng = np.random.default_rng(1)
    users, items = rng.normal(size=(3, 4)), rng.normal(size=(5, 4))
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "node long, vector array<double>")
    steps = [(u, int(rng.integers(5)), t) for u in range(2) for t in range(40)] + [(9, 1, 1)]
    events = spark.createDataFrame([(u, i, t, t) for u, i, t in steps], "user long, item long, ts long, event_id long")
    for unit in (False, True):
        got = {r["user"]: r["vector"] for r in online.shifted_user(frame(users), events, frame(items), 0.3, unit).collect()}
        assert set(got) == {0, 1}
        for u in got:
            v = users[u]
            for w, i, _ in steps:
                if w == u:
                    v = v + 0.3 * items[i]
                    v = v / (np.linalg.norm(v) + 1e-9) if unit else v
            assert np.allclose(got[u], v)


def test_quantiles_and_running_sums_are_exact(spark):
    rng = random.Random(5)
    rows = [(g, None if rng.random() < 0.1 else rng.choice([1.5, 2.0, 3.25, 10.0, -4.0]) if g else rng.random()) for g in (0, 1) for _ in range(300)] + [(2, 7.0), (3, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: (r["q"], r["nearest"]) for r in ranges.quantiles(df, ["g"], "v", [0.25, 0.5, 0.99], (0.99,)).collect()}
    for g in (0, 1, 2):
        v = [x for h, x in rows if h == g and x is not None]
        assert np.allclose(got[g][0], np.quantile(v, [0.25, 0.5, 0.99])) and got[g][1] == [sorted(v)[int(np.ceil(0.99 * len(v))) - 1]]
    assert 3 not in got
    box = {r["g"]: r for r in marts.box_statistics(df, "g", "v").collect()}
    assert box[2]["median"] == 7.0 and box[2]["outliers"] == 0
    assert sorted(r["place"] for r in ranges.placed(spark.range(500).withColumn("k", F.lit(1)), ["k"], ["id"]).collect()) == list(range(500))
