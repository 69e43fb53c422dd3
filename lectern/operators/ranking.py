"""Graph embeddings trained on a ranking loss, and the gate on what they retrieve.

A pair (user, item) and an item that the user lacks should score apart: the loss of a triple is -log sigmoid(u.p - u.n) with
the propagated vectors of M17. All of a step is joins and sums: propagation, the triples' coefficients, the gradient of each
node's propagated vector, and that gradient carried back through the layers, which is the same propagation, as the
normalised graph is symmetric. Vectors and the optimiser's two accumulators are one table a side, written each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.recsys import negative_samples, normalised, propagate, recall_ndcg, top_k
from lectern.session import delete, materialise, scratch, table_path


def initial(edges: DataFrame, size: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(node, vector) of both sides: numbers spread evenly around 0 by hashes, so that a re-run begins alike."""
    limit = (6.0 / size) ** 0.5

    def side(column: str) -> DataFrame:
        nodes = edges.select(F.col(column).alias("node")).where("node is not null").distinct()
        unit = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(column), "node", F.lit(i)), 11).cast("double") / float(1 << 53)
        return nodes.select("node", F.array(*[(unit(i) * 2 - 1) * limit for i in range(size)]).alias("vector"))

    return side("user"), side("item")


def _summed(rows: DataFrame, size: int) -> DataFrame:
    """The sum of the arrays in `vector` of each node, one partial aggregate a dimension."""
    sums = [F.sum(F.get("vector", F.lit(i))).alias(f"d{i}") for i in range(size)]
    return rows.groupBy("node").agg(*sums).select("node", F.array(*[f"d{i}" for i in range(size)]).alias("vector"))


def gradients(graph: DataFrame, users: DataFrame, items: DataFrame, triples: DataFrame, size: int, layers: int) -> tuple[float, DataFrame, DataFrame]:
    """The mean loss of triples (user, item, negative), and its gradient by each node's own vector, as (node, vector).

    graph is that of normalised(), users and items are (node, vector). A node that no gradient reaches has none.
    """
    final_users, final_items = propagate(graph, users, items, size, layers)
    named = lambda df, n, v: df.select(F.col("node").alias(n), F.col("vector").alias(v))
    rows = triples.join(named(final_users, "user", "u"), "user").join(named(final_items, "item", "p"), "item").join(named(final_items, "negative", "n"), "negative")
    apart = F.zip_with("p", "n", lambda a, b: a - b)
    x = F.aggregate(F.zip_with("u", apart, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = materialise(rows.select("user", "item", "negative", "u", apart.alias("apart"), x.alias("x")))
    # log(1 + exp(-x)), without overflow
    total, n = scored.agg(F.sum(F.greatest(-F.col("x"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("x")))), F.count("*")).first()
    n = max(1, n)
    pull = -1.0 / (1.0 + F.exp("x")) / n
    times = lambda v, c: F.transform(v, lambda a: a * c)
    to_users = _summed(scored.select(F.col("user").alias("node"), times("apart", pull).alias("vector")), size)
    both = scored.select(F.explode(F.array(F.struct(F.col("item").alias("node"), times("u", pull).alias("vector")), F.struct(F.col("negative").alias("node"), times("u", -pull).alias("vector")))).alias("g"))
    to_items = _summed(both.select("g.*"), size)
    zero = F.array_repeat(F.lit(0.0), size)
    # propagation starts from all nodes, those without a gradient of their own with zeros
    whole = lambda nodes, g: materialise(nodes.select("node").join(g, "node", "left").select("node", F.coalesce("vector", zero).alias("vector")))
    back_users, back_items = propagate(graph, whole(users, to_users), whole(items, to_items), size, layers)
    return (total or 0.0) / n, back_users, back_items


def _stepped(state: DataFrame, gradient: DataFrame, turn: int, rate: float, first: float = 0.9, second: float = 0.999, least: float = 1e-8) -> DataFrame:
    """(node, vector, m, v) after a step of adaptive moments: running means of gradients and of their squares, without their bias."""
    joined = state.join(gradient.withColumnRenamed("vector", "g"), "node", "left").withColumn("g", F.coalesce("g", F.transform("vector", lambda x: x * 0.0)))
    m = F.zip_with("m", "g", lambda a, g: first * a + (1 - first) * g)
    v = F.zip_with("v", "g", lambda a, g: second * a + (1 - second) * g * g)
    moved = joined.select("node", "vector", m.alias("m"), v.alias("v"))
    step = lambda m, v: rate * (m / (1 - first**turn)) / (F.sqrt(v / (1 - second**turn)) + least)
    return moved.select("node", F.zip_with("vector", F.zip_with("m", "v", step), lambda x, s: x - s).alias("vector"), "m", "v")


def trained(edges: DataFrame, size: int = 64, layers: int = 3, epochs: int = 10, rate: float = 0.01, seed: int = 42, start: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """Propagated vectors of users and items after so many steps over all pairs, and the mean loss before each step.

    Every step draws new negatives, one a pair (J18). start may hold vectors to begin with, such as base_embeddings(). Pairs
    with a null end take no part. Each step's tables are deleted once the next one's vectors are written.
    """
    spark = edges.sparkSession
    pairs = materialise(edges.select("user", "item").where("user is not null and item is not null").distinct())
    graph = materialise(normalised(pairs))
    zeros = F.transform("vector", lambda x: x * 0.0)
    state = [materialise(side.select("node", "vector", zeros.alias("m"), zeros.alias("v"))) for side in start or initial(pairs, size, seed)]
    paths: list[str] = []
    losses: list[float] = []
    for turn in range(1, epochs + 1):
        new = [table_path(spark), table_path(spark)]
        with scratch(spark):
            triples = materialise(negative_samples(pairs, seed=seed + turn))
            loss, *found = gradients(graph, *[s.select("node", "vector") for s in state], triples, size, layers)
            for s, g, path in zip(state, found, new, strict=True):
                _stepped(s, g, turn, rate).write.parquet(path)
        losses.append(loss)
        state = [spark.read.schema(s.schema).parquet(path) for s, path in zip(state, new, strict=True)]
        for path in paths:
            delete(spark, path)
        paths = new
    users, items = propagate(graph, *[s.select("node", "vector") for s in state], size, layers)
    return users, items, losses


def recall_gate(users: DataFrame, items: DataFrame, train: DataFrame, held: DataFrame, k: int = 10, least: float = 0.20) -> DataFrame:
    """recall, ndcg, pairs and passed: held-out pairs among each user's k best items, those of the training pairs left out.

    Held-out pairs whose user or item has no vector are not counted.
    """
    known = held.join(users.select(F.col("node").alias("user")), "user", "left_semi").join(items.select(F.col("node").alias("item")), "item", "left_semi")
    asked = users.join(known.select(F.col("user").alias("node")).distinct(), "node", "left_semi")
    found = recall_ndcg(top_k(asked, items, k, exclude=train), known, k)
    return found.withColumn("passed", F.coalesce(F.col("recall") >= least, F.lit(False)))
