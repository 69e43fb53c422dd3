"""Graph recommender: denoising, normalised graph, embeddings, top-k, evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lectern.session import broadcast_if_small, materialise


def interactions(clicks: DataFrame, user: str = "id_student", item: str = "id_site", count: str = "sum_click") -> DataFrame:
    """(user, item, clicks) sums."""
    return clicks.where(F.col(user).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(F.sum(count).cast("long").alias("clicks"))


def denoised(pairs: DataFrame) -> DataFrame:
    """Pairs with at least their item's approximate median of clicks.

    Medians are one small row an item, joined back; both use the item's partitioning and a hot item's pairs are summed up
    on the map side first.
    """
    medians = pairs.groupBy("item").agg(F.percentile_approx("clicks", 0.5, 100_000).alias("median_clicks"))
    return pairs.join(medians, "item").where("clicks >= median_clicks").select("user", "item", "clicks")


def hold_out(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """pairs with `held_out`: one pair, picked by hash, of each user who has more than one.

    The pick is an aggregate with partial results, joined back, so that no task sorts one user's pairs.
    """
    picked = pairs.groupBy("user").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "user", "item").alias("hash"), "item")).alias("pick"), F.count("*").alias("n"))
    picked = picked.select("user", F.when(F.col("n") > 1, F.col("pick.item")).alias("pick"))
    return pairs.join(picked, "user").withColumn("held_out", F.coalesce(F.col("item") == F.col("pick"), F.lit(False))).drop("pick")


def degrees(edges: DataFrame) -> DataFrame:
    """(kind, node, degree) of users and items."""
    side = lambda k: edges.groupBy(F.col(k).alias("node")).agg(F.count("*").alias("degree")).select(F.lit(k).alias("kind"), "node", "degree")
    return side("user").unionByName(side("item"))


def normalised(edges: DataFrame) -> DataFrame:
    """(user, item, weight = 1 / sqrt(degree * degree))."""
    users = edges.groupBy("user").agg(F.count("*").alias("du"))
    items = edges.groupBy("item").agg(F.count("*").alias("di"))
    return edges.join(users, "user").join(items, "item").select("user", "item", (1.0 / F.sqrt(F.col("du") * F.col("di"))).alias("weight"))


def _weighted_sum(df: DataFrame, key: str, size: int) -> DataFrame:
    """Sum of weight * vector per key, partial sums on the map side: one aggregate a dimension."""
    sums = [F.sum(F.col("weight") * F.element_at("vector", i + 1)).alias(f"d{i}") for i in range(size)]
    return df.groupBy(F.col(key).alias("node")).agg(*sums).select("node", F.array(*[F.col(f"d{i}") for i in range(size)]).alias("vector"))


def propagate(graph: DataFrame, users: DataFrame, items: DataFrame, size: int, layers: int = 3) -> tuple[DataFrame, DataFrame]:
    """Embeddings averaged over layers 0..layers of neighbourhood propagation (M17); users, items: (node, vector).

    Each layer is two joins of the edge list with one side's vectors and a partial-sum aggregate, and is written, so the
    lineage stays one layer deep.
    """
    zero = F.array_repeat(F.lit(0.0), size)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = {"user": users.withColumnRenamed("vector", "total"), "item": items.withColumnRenamed("vector", "total")}
    layer = {"user": users, "item": items}
    for _ in range(layers):
        new = {}
        for side, other in (("user", "item"), ("item", "user")):
            spread = graph.join(layer[other].withColumnRenamed("node", other), other)
            new[side] = materialise(_weighted_sum(spread, side, size))
        layer = new
        for side in total:
            joined = total[side].join(layer[side], "node", "left")
            total[side] = materialise(joined.select("node", add(F.col("total"), F.coalesce("vector", zero)).alias("total")))
    mean = lambda df: df.select("node", F.transform("total", lambda x: x / (layers + 1)).alias("vector"))
    return mean(total["user"]), mean(total["item"])


def base_embeddings(edges: DataFrame, size: int = 64, iterations: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Implicit-feedback factors by alternating least squares as the layer-0 vectors (M18); nodes keep their ids.

    The factorisation takes ints, so both sides are numbered first and named again after it.
    """
    from pyspark.ml.recommendation import ALS

    sides = {c: numbering(edges.select(c).where(F.col(c).isNotNull()).distinct(), c) for c in ("user", "item")}
    coded = edges.select("user", "item")
    for c, codes in sides.items():
        coded = coded.join(codes.withColumnRenamed("index", f"{c}_ix"), c)
    als = ALS(userCol="user_ix", itemCol="item_ix", ratingCol="rating", implicitPrefs=True, rank=size, maxIter=iterations, seed=seed)
    model = als.fit(coded.select(F.col("user_ix").cast("int").alias("user_ix"), F.col("item_ix").cast("int").alias("item_ix"), F.lit(1.0).alias("rating")))
    vectors = {"user": model.userFactors, "item": model.itemFactors}
    out = lambda c: sides[c].join(vectors[c], F.col("index") == F.col("id")).select(F.col(c).alias("node"), F.transform("features", lambda x: x.cast("double")).alias("vector"))
    return out("user"), out("item")


def negative_samples(edges: DataFrame, per_pair: int = 1, seed: int = 42, bucket: int = 4096) -> DataFrame:
    """(user, item, negative): for each pair, per_pair items by hash that the user has no edge with.

    Items are numbered. A draw is a rank among the n - degree items that the user lacks; the item of that rank follows from
    the user's numbers: those before the last bucket of numbers that begins no later, a sum, and those within it, an array of
    at most `bucket`. So no draw fails, and no row holds all edges of a user. A user with an edge to every item has none.
    """
    pairs = edges.select("user", "item").distinct()
    items = pairs.select("item").distinct()
    n = items.count()
    numbered = materialise(numbering(items, "item"))
    placed = materialise(pairs.join(broadcast_if_small(numbered, n), "item"))
    held = materialise(placed.groupBy("user", F.floor(F.col("index") / bucket).alias("bucket")).agg(F.array_sort(F.collect_list("index")).alias("held")))
    earlier = W.partitionBy("user").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = held.select("user", "bucket", F.size("held").alias("size"))
    marks = sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0).cast("long")))
    mark = F.struct((F.col("bucket") * bucket - F.col("before")).alias("lacked"), "bucket", "before")
    users = marks.groupBy("user").agg(F.array_sort(F.collect_list(mark)).alias("marks"), F.sum("size").alias("degree")).where(F.col("degree") < n)
    drawn = placed.select("user", "item", F.explode(F.sequence(F.lit(1), F.lit(per_pair))).alias("attempt")).join(users, "user")
    drawn = drawn.withColumn("rank", F.pmod(F.xxhash64(F.lit(seed), "user", "item", "attempt"), n - F.col("degree")))
    drawn = drawn.withColumn("mark", F.get(F.col("marks"), F.size(F.filter("marks", lambda m: m["lacked"] <= F.col("rank"))) - 1))
    drawn = drawn.select("user", "item", "rank", F.col("mark.bucket").alias("bucket"), F.coalesce("mark.before", F.lit(0).cast("long")).alias("before"))
    passed = F.size(F.filter("held", lambda e, k: e - F.col("before") - k <= F.col("rank")))
    found = drawn.join(held, ["user", "bucket"], "left").select("user", "item", (F.col("rank") + F.col("before") + F.when(F.col("held").isNull(), 0).otherwise(passed)).alias("index"))
    return found.join(broadcast_if_small(numbered.withColumnRenamed("item", "negative"), n), "index").select("user", "item", "negative")


def numbering(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """(column, index): contiguous numbers from 0 in the order of the values, without one task seeing all.

    Values are range-partitioned, into as many parts as a shuffle has unless told otherwise, counted per partition, and
    offset by the partitions before.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(column).repartitionByRange(buckets, column).withColumn("_p", F.spark_partition_id())
    ranged = materialise(ranged)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("_p").orderBy(column)) - 1
    return ranged.withColumn("_i", within).join(F.broadcast(before.select("_p", "_before")), "_p").select(column, (F.col("_before") + F.col("_i")).alias("index"))


def _best(left: pa.Table, right: pa.Table, k: int, score: str) -> pa.Table:
    """The k best items of one block for each user of one block. left holds users, and pairs to leave out (with an item)."""
    users, pairs = left.filter(pc.is_valid(left["vector"])), left.filter(pc.is_null(left["vector"]))
    items = right.sort_by("item")
    matrix = lambda t: np.asarray(t["vector"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    if not users.num_rows or not items.num_rows:
        return pa.table({"user": left["user"].slice(0, 0), "item": right["item"].slice(0, 0), "score": pa.array([], pa.float64())})
    u, v = matrix(users), matrix(items)
    lengths = (np.sqrt((u * u).sum(1)), np.sqrt((v * v).sum(1)))
    out_user = pc.index_in(pairs["user"], value_set=users["user"].combine_chunks()).to_numpy(zero_copy_only=False)
    out_item = pc.index_in(pairs["item"], value_set=items["item"].combine_chunks()).to_numpy(zero_copy_only=False)
    known = ~(np.isnan(out_user.astype(float)) | np.isnan(out_item.astype(float)))
    out_user, out_item = out_user[known].astype(np.int64), out_item[known].astype(np.int64)
    order = np.argsort(out_user, kind="stable")
    out_user, out_item = out_user[order], out_item[order]
    found = []
    for low in range(0, len(u), max(1, (1 << 22) // len(v))):
        high = min(len(u), low + max(1, (1 << 22) // len(v)))
        s = u[low:high] @ v.T
        if score == "match":
            s = np.clip((s / (lengths[0][low:high, None] * lengths[1] + 1e-9) + 1) * 50, 0, 100)
        a, b = np.searchsorted(out_user, [low, high])
        s[out_user[a:b] - low, out_item[a:b]] = -np.inf
        # the product picks candidates with room for its rounding; their scores are summed again, alike wherever they stand
        least = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        room = 1e-9 * (100.0 if score == "match" else lengths[0][low:high] * lengths[1].max() + 1e-300)
        i, j = np.nonzero((s >= (least - room)[:, None]) & (s > -np.inf))
        exact = np.einsum("ij,ij->i", u[low:high][i], v[j])
        if score == "match":
            exact = np.clip((exact / (lengths[0][low:high][i] * lengths[1][j] + 1e-9) + 1) * 50, 0, 100)
        order = np.lexsort((j, -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[keep] + low, j[keep], exact[keep]))
    i, j, exact = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"user": users["user"].take(pa.array(i)), "item": items["item"].take(pa.array(j)), "score": pa.array(exact)})


def top_k(users: DataFrame, items: DataFrame, k: int = 5, score: str = "dot", exclude: DataFrame | None = None, block_bytes: int = 1 << 25) -> DataFrame:
    """(user, item, score, rank) of each user's best items (J12, W02, W11, M21); users, items: (node, vector).

    Users and items are dealt into blocks of about block_bytes of vectors. Each pair of blocks is one group: a matrix
    product scores it and the k best items of each user remain, so no pair of user and item is a row but these, and a rank
    over at most k a user and block ends it. Ties go to the smaller item. An exclusion list (user, item) goes to the group
    that scores the pair and masks it there (J19), however many items a user has on it. Null vectors are left out.
    """
    spark = users.sparkSession
    users = users.where("node is not null and vector is not null").select(F.col("node").alias("user"), "vector")
    items = items.where("node is not null and vector is not null").select(F.col("node").alias("item"), "vector")
    n_users = users.count()
    n_items, size = items.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    rows = max(1, block_bytes // (8 * max(1, size)))
    # users are few a block where there are few, to keep all cores busy
    user_blocks = max(1, -(-n_users // rows), min(spark.sparkContext.defaultParallelism, n_users // 256))
    item_blocks = max(1, -(-n_items // rows))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind, item = users.schema["user"].dataType, items.schema["item"].dataType
    left = users.select(block("user", user_blocks).alias("ub"), every(item_blocks).alias("ib"), "user", F.lit(None).cast(item).alias("item"), "vector")
    if exclude is not None:
        pairs = exclude.where("user is not null and item is not null").select(F.col("user").cast(kind).alias("user"), F.col("item").cast(item).alias("item"))
        left = left.unionByName(pairs.select(block("user", user_blocks).alias("ub"), block("item", item_blocks).alias("ib"), "user", "item", F.lit(None).cast(users.schema["vector"].dataType).alias("vector")))
    right = items.select(every(user_blocks).alias("ub"), block("item", item_blocks).alias("ib"), "item", "vector")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, k, score)

    schema = T.StructType([T.StructField("user", kind), T.StructField("item", item), T.StructField("score", T.DoubleType())])
    found = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInArrow(best, schema)
    order = W.partitionBy("user").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall_ndcg(ranked: DataFrame, held: DataFrame, k: int = 10) -> DataFrame:
    """recall and ndcg at k: a held-out pair at rank r gains 1 / log2(r + 1)."""
    hits = held.select("user", "item").join(ranked.where(F.col("rank") <= k).select("user", "item", "rank"), ["user", "item"], "left")
    gain = F.when(F.col("rank").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    return hits.agg(F.avg(F.col("rank").isNotNull().cast("int")).alias("recall"), F.avg(gain).alias("ndcg"), F.count("*").alias("pairs"))


def active_users(events: DataFrame, now, minutes: int = 15, columns: tuple[str, ...] = ("event_time", "ts")) -> DataFrame:
    """Users with an event in the last minutes, by the first timestamp column there is."""
    time = next((c for c in columns if c in events.columns), None)
    if time is None:
        raise ValueError(f"none of {columns} is a column")
    return events.where(F.col(time) >= F.lit(now).cast("timestamp") - F.expr(f"interval {minutes} minutes")).select("user").distinct()
