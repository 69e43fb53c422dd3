"""Boosted trees: a cut checked by hand, early stopping, a held-out year against the linear model, and explanations."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import boosting as B
from lectern.operators import ml


def rows(spark, n, seed):
    """Classes that depend on a product of two numbers and on a label, which no linear score can tell."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, z, r = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice(["north", "south", "west", None])
        c = "Withdrawn" if r == "west" and z > -0.5 else "Success" if x * y > 0 else "Fail"
        out.append((i, "2014J" if i % 4 == 0 else "2013B", x, None if i % 31 == 0 else y, z, r, rng.choice(["Success", "Fail", "Withdrawn"]) if rng.random() < 0.05 else c))
    return spark.createDataFrame(out, "id_student long, code_presentation string, x double, y double, z double, region string, target_class string")


def test_a_cut_on_twelve_rows_is_the_one_worked_out_by_hand(spark):
    data = [(1.0, 5.0, "a"), (2.0, 5.0, "a"), (3.0, 1.0, "a"), (4.0, 5.0, "a"), (5.0, 1.0, "a"), (6.0, 5.0, "a"), (7.0, 1.0, "b"), (8.0, 5.0, "b"), (9.0, 1.0, "b"), (10.0, 5.0, "a"), (11.0, 1.0, "b"), (12.0, 1.0, "b")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id_student long, u double, v double, target_class string").repartition(3)
    start = B.prepared(df, ["u", "v"], [], "target_class")
    held = B._rows(df, start, "target_class", F.lit(False))
    size = 15
    trees = [B.Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in "ab"]
    got = {r["k"]: r for r in B.best_cuts(B._histograms(held, start, 0, trees, 0), 1.5, 2).collect()}
    # weights 12 / (2 * 7) and 12 / (2 * 5); at the start p = 1/2, so g = w (1/2 - y) and h = w / 4
    wa, wb = 12 / 14, 12 / 10
    rows_ = [(u, v, wa * (0.5 - 1) if c == "a" else wb * 0.5, (wa if c == "a" else wb) / 4) for u, v, c in data]
    part = lambda s: sum(r[2] for r in s) ** 2 / (sum(r[3] for r in s) + 1.5)
    gains = {}
    for j in (0, 1):
        for cut in sorted({r[j] for r in rows_})[:-1]:
            left, right = [r for r in rows_ if r[j] <= cut], [r for r in rows_ if r[j] > cut]
            if len(left) >= 2 and len(right) >= 2:
                gains[j, cut] = part(left) + part(right) - part(rows_)
    (feature, cut), gain = max(gains.items(), key=lambda x: x[1])
    assert (feature, cut) == (0, 6.0)
    for k in (0, 1):  # two classes have the same cuts
        assert got[k]["feature"] == feature and abs(got[k]["gain"] - gain) < 1e-8
        assert np.searchsorted(start.edges[0], cut, "left") == got[k]["bin"]
        assert abs(got[k]["gt"] - (-1) ** k * sum(r[2] for r in rows_)) < 1e-9 and abs(got[k]["ht"] - sum(r[3] for r in rows_)) < 1e-9


def macro_ap(spark, scores, truth):
    joined = scores.join(truth, "id_student")
    classes = [c.removeprefix("prob_") for c in scores.columns if c.startswith("prob_")]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"prob_{c}").alias("score"), (F.col("target_class") == c).cast("int").alias("label")) for c in classes]))
    found = ml.average_precision(joined.select(each.alias("r")).select("r.*"), ["class"])
    return found.agg(F.avg("average_precision")).first()[0]


def test_a_held_out_year_is_told_better_than_by_the_linear_model(spark):
    df = ml.temporal_split(rows(spark, 3000, 1)).cache()
    train, test = df.where("not is_test"), df.where("is_test")
    model = B.fit(train, ["x", "y", "z"], ["region"], rounds=9, patience=3)
    assert model.losses[-1] < model.losses[0] and model.losses[0] - math.log(3) < 1e-9
    best = int(np.argmin(model.losses))
    assert len(model.rounds) == max(1, math.floor(best * 1.15)) and best >= 3
    scores = B.scored(model, test, ["id_student"])
    p = np.array([[r[f"prob_{c}"] for c in model.classes] for r in scores.collect()])
    assert np.allclose(p.sum(1), 1) and model.classes == ["Fail", "Success", "Withdrawn"]
    truth = test.select("id_student", "target_class")
    linear = ml.classifier(["x", "y", "z"], ["region"]).fit(ml.class_weights(train, "target_class"))
    boosted, plain = macro_ap(spark, scores, truth), macro_ap(spark, ml.scored(linear, test, ["id_student"]), truth)
    assert boosted > plain + 0.1, (boosted, plain)

    parts = B.path_contributions(model, test, ["id_student"], "Success")
    gap = parts.groupBy("id_student").agg((F.max("score") - F.max("base") - F.sum("contribution")).alias("gap"), F.count("*").alias("n"))
    assert gap.where("abs(gap) > 1e-9 or n <> 4").count() == 0 and gap.count() == test.count()
    found = {r["feature"]: r["importance"] for r in B.permutation_importance(model, test, ["id_student"]).collect()}
    assert set(found) == {"x", "y", "z", "region"} and min(found["x"], found["y"]) > found["z"] > 0


def test_early_stopping_ends_on_noise_and_edge_cases_do_not_fail(spark):
    rng = random.Random(3)
    noise = spark.createDataFrame([(i, rng.random(), rng.choice(["a", "b", None]), rng.choice(["Fail", "Success"])) for i in range(600)], "id_student long, x double, region string, target_class string")
    model = B.fit(noise, ["x"], ["region"], rounds=14, patience=2)
    assert len(model.losses) < 15 and len(model.rounds) <= max(1, int(np.argmin(model.losses) * 1.15))
    same = noise.withColumn("x", F.lit(None).cast("double")).withColumn("region", F.lit("a"))
    flat = B.fit(same, ["x"], ["region"], rounds=3)
    assert flat.rounds == [] and B.scored(flat, same, ["id_student"]).count() == 600
    assert B.scored(model, noise.limit(0), ["id_student"]).count() == 0
    one = B.fit(noise.where("target_class = 'Fail'"), ["x"], ["region"], rounds=3)
    assert {r["predicted_class"] for r in B.scored(one, noise, ["id_student"]).collect()} == {"Fail"}
