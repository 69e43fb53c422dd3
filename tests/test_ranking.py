"""Ranking-loss training: gradients against finite differences, falling loss and recall on a planted graph, edge cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import ranking as K
from lectern.operators import recsys as R


def planted(spark, users=120, groups=6, per_group=12, picks=6, seed=1):
    """Users click items of their own group."""
    rng = random.Random(seed)
    return spark.createDataFrame([(u, 1000 + (u % groups) * per_group + i) for u in range(users) for i in rng.sample(range(per_group), picks)], "user long, item long")


def test_gradients_are_those_of_finite_differences(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 12), (2, 10)], "user long, item long")
    triples = [(1, 10, 12), (2, 11, 12), (3, 12, 10), (1, 11, 12)]
    rng = np.random.default_rng(2)
    u, i = {n: rng.normal(size=3) for n in (1, 2, 3)}, {n: rng.normal(size=3) for n in (10, 11, 12, 13)}  # 13 is in no pair
    weights = {(r["user"], r["item"]): r["weight"] for r in R.normalised(edges).collect()}

    def loss(u, i, layers=2):
        at, total = (u, i), ({n: x.copy() for n, x in u.items()}, {n: x.copy() for n, x in i.items()})
        for _ in range(layers):
            nu = {n: sum((w * at[1][b] for (a, b), w in weights.items() if a == n), np.zeros(3)) for n in u}
            ni = {n: sum((w * at[0][a] for (a, b), w in weights.items() if b == n), np.zeros(3)) for n in i}
            at = (nu, ni)
            for t, a in zip(total, at, strict=True):
                for n in t:
                    t[n] += a[n]
        fu, fi = ({n: x / (layers + 1) for n, x in t.items()} for t in total)
        return sum(math.log(1 + math.exp(-fu[a] @ (fi[p] - fi[n]))) for a, p, n in triples) / len(triples)

    frame = lambda d: spark.createDataFrame([(n, x.tolist()) for n, x in d.items()], "node long, vector array<double>")
    value, gu, gi = K.gradients(R.normalised(edges), frame(u), frame(i), spark.createDataFrame(triples, "user long, item long, negative long"), 3, 2)
    assert abs(value - loss(u, i)) < 1e-12
    for side, found in ((u, gu), (i, gi)):
        got = {r["node"]: r["vector"] for r in found.collect()}
        assert set(got) == set(side)
        for n in side:
            for d in range(3):
                old, diff = side[n][d], []
                for e in (1e-6, -1e-6):
                    side[n][d] = old + e
                    diff.append(loss(u, i))
                side[n][d] = old
                assert abs(got[n][d] - (diff[0] - diff[1]) / 2e-6) < 1e-8


def test_loss_falls_and_held_out_pairs_are_found_on_a_planted_graph(spark):
    split = R.hold_out(planted(spark)).cache()
    train, held = split.where("not held_out"), split.where("held_out")
    users, items, losses = K.trained(train, size=8, layers=1, epochs=4, rate=0.1)
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False)) and losses[0] < 1.0
    got = K.recall_gate(users, items, train, held).first()
    # a random order would find a pair in 10 of 66 items
    assert got["pairs"] == 120 and got["recall"] > 0.4 and got["passed"] and got["ndcg"] > 0.2
    assert users.count() == 120 and items.where(F.size("vector") != 8).count() == 0


def test_null_ends_and_empty_graphs(spark):
    few = spark.createDataFrame([(1, 10), (None, 10), (2, None), (1, 10), (2, 11)], "user long, item long")
    users, items, losses = K.trained(few, size=2, layers=1, epochs=1)
    assert sorted(r["node"] for r in users.collect()) == [1, 2] and sorted(r["node"] for r in items.collect()) == [10, 11] and len(losses) == 1
    none = K.trained(few.limit(0), size=2, layers=1, epochs=1)
    assert none[0].count() == none[1].count() == 0 and none[2] == [0.0]
