"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are spread over the vectors: picked farthest first from a sample by hash, none closer than a
cosine of `apart` to another. A vector is described by its `prefix` nearest pivots in order. The inverted index has a list
for each pair of pivots; a vector stands in the lists of all pairs from its prefix, so two vectors meet if they share at
least two pivots of their prefixes, wherever those stand in the order. A pair is judged once, in the list of its two first
shared pivots: shared pivots are counted in each list, and pairs that share an earlier one are left to that pair's own
list. Those judged here are verified by cosine in double precision, so nothing below the threshold is linked. Lists of
more than `block` vectors are cut into slices that meet two by two, each pair of slices in a group of its own, so no task
holds a whole list and no list is capped.

The number of pivots is `spread` times the root of the largest label's vectors, up to `max_pivots`, so that lists keep
their length and pairs compared grow with the vectors, not with their square. Pairs at the very threshold share two of six
pivots in all but about one case of a thousand; the README gives the recall measured against all rows.

Vectors with equal labels and of one length are compared; those with a null label, that are null, empty or zero, or hold
null or non-finite components link with nothing and are kept. Pivots have the commonest length; to place a vector of another length,
missing components count as 0. Exact copies are one vector until the end and count as links of each other. A repeated row
is the same vector; an id with two different vectors has a row for each, and both are vectors of their own. Rows with a null id have a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import connected_components
from lectern.session import materialise, table

SMALL = 48


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and the values before each row (n + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _spread(units: np.ndarray, count: int, apart: float) -> np.ndarray:
    """Up to count of the unit vectors, each the farthest from those before, none with a cosine of `apart` or more to another."""
    picked, nearest = [0], units @ units[0]
    while len(picked) < count and nearest.min() < apart:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[picked[-1]])
    return units[picked]


def _describe(batches: Iterator[pa.RecordBatch], shared, prefix: int) -> Iterator[pa.RecordBatch]:
    """Rows with `near`, the nearest pivots in order. With a single pivot a second one stands beside it, as near to all."""
    points = shared.value
    count = min(prefix, len(points))
    for batch in batches:
        if not batch.num_rows:
            continue
        values, before = _flat(batch.column(batch.schema.get_field_index("embedding")))
        near = np.zeros((batch.num_rows, max(2, count)), np.int32)
        near[:, 1] = 1
        for size in np.unique(np.diff(before)).tolist():
            rows = np.flatnonzero(np.diff(before) == size)
            width = min(size, points.shape[1])
            for part in np.array_split(rows, -(-len(rows) * len(points) // (1 << 22))):
                unit = _unit(values[before[part][:, None] + np.arange(size)])
                far = -(unit[:, :width] @ points[:, :width].T)
                first = np.argpartition(far, count - 1, 1)[:, :count]
                near[part, :count] = np.take_along_axis(first, np.lexsort((first, np.take_along_axis(far, first, 1)), 1), 1)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "near"])


def _linked(t: pa.Table, threshold: float) -> pa.RecordBatch:
    """Whole lists of vectors of one length, sorted by list and side; for each member with a link: its id, its links, a member it reaches."""
    key, lab, side, ids, copies, split, one, two = (t[c].to_numpy() for c in ("list", "lab", "side", "rep", "copies", "split", "one", "two"))
    values, before = _flat(t["embedding"])
    unit = _unit(values.reshape(len(key), -1))
    near = np.sort(_flat(t["near"])[0].reshape(len(key), -1), 1)
    early = near < two[:, None]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    found = [np.zeros((2, 0), np.int64)]

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        ok = (lab[i] == lab[j]) & (one[i] == one[j]) & (two[i] == two[j]) & (~split[i] | (side[i] != side[j])) & (ids[i] != ids[j])
        i, j = i[ok], j[ok]
        for low in range(0, len(i), 1 << 16):
            a, b = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
            good = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            found.append(np.stack([a[good], b[good]]))

    small = (ends - starts) <= SMALL
    row = np.concatenate([np.arange(a, b) for a, b in zip(starts[small], ends[small], strict=True)] or [np.zeros(0, np.int64)])
    end = np.repeat(ends[small], (ends - starts)[small])
    for low in range(0, len(row), 4096):
        r, e = row[low : low + 4096], end[low : low + 4096]
        n = e - r - 1
        i = np.repeat(r, n)
        j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # pivots shared before the list's second one: its first alone, or the pair belongs to another list
        count = np.zeros(len(i), np.int8)
        for k in range(near.shape[1]):
            count += (early[i, k] & (near[j] == near[i, k][:, None]).any(1)).astype(np.int8)
        verify(i[count == 1], j[count == 1])
    for a, b in zip(starts[~small], ends[~small], strict=True):
        pivots, place = np.unique(near[a:b], return_inverse=True)
        mark = np.zeros((b - a, len(pivots)), np.float32)
        mark[np.arange(b - a)[:, None], place.reshape(b - a, -1)] = early[a:b]
        # two slices are compared with each other only: the first side's rows stand before the second's
        middle = int(np.searchsorted(side[a:b], side[a], "right")) if split[a] else b - a
        for p in range(0, middle, 512):
            for q in range(middle if split[a] else p, b - a, 512):
                count = mark[p : min(p + 512, middle)] @ mark[q : min(q + 512, b - a)].T
                i, j = np.nonzero(count == 1)
                i, j = i + p, j + q
                verify(a + i[i < j], a + j[i < j])
    i, j = np.concatenate(found, 1)
    links = np.bincount(i, copies[j], len(key)) + np.bincount(j, copies[i], len(key))
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            break
        root = new
    linked = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(links[linked].astype(np.int64)), pa.array(root[linked])], ["rep", "links", "root"])


def _judge(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length and list in; links of whole lists out, a batch's worth of lists at a time."""

    def whole(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(parts)
        size = t["size"].to_numpy()
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield _linked(t.slice(a, b - a), threshold)

    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        key = t["list"].to_numpy()
        last = key[-1]
        cut = int(len(key) - np.argmax((key != last)[::-1])) if (key != last).any() else 0  # where the last list begins
        if cut:
            yield from whole([*held, t.slice(0, cut)])
            held = []
        elif held and held[-1]["list"][0].as_py() != last:
            yield from whole(held)
            held = []
        held.append(t.slice(cut))
    if held:
        yield from whole(held)


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, prefix: int = 6, spread: float = 2.0, max_pivots: int = 4096, apart: float = 0.9, block: int = 2048,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{label}`").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")).distinct()
    good = rows.where("sound").withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(17), "embedding")})
    key = ["label", "h1", "h2"]
    groups = good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.min_by("embedding", "vec_id").alias("embedding"))
    # `no` tells vectors of one id apart; it is written once and so stays
    groups = materialise(groups.withColumn("size", F.size("embedding")).withColumn("no", F.monotonically_increasing_id()))
    most = groups.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    size = (groups.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first() or [0])[0]
    count = min(max_pivots, max(1, math.ceil(spread * math.sqrt(most))))
    members = good.select(*key, "vec_id").distinct().join(groups.select(*key, "no", "rep", "copies"), key)
    if most:
        sample = groups.where(F.col("size") == size).orderBy(F.xxhash64("h1", "h2"), "rep").select("embedding").limit(4 * count).toArrow()  # at most 4 * max_pivots rows
        points = spark.sparkContext.broadcast(_spread(_unit(_flat(sample["embedding"])[0].reshape(-1, size)), count, apart))
        base = groups.select(F.col("no").alias("rep"), "label", "copies", "size", "embedding")
        schema = T.StructType([*base.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])
        described = materialise(base.mapInArrow(partial(_describe, shared=points, prefix=prefix), schema))
        width = max(2, min(prefix, len(points.value)))
        pick = lambda i: F.col("sorted")[i]
        pairs = F.array(*[F.struct(pick(i).alias("one"), pick(j).alias("two")) for i, j in combinations(range(width), 2)])
        posts = described.withColumn("sorted", F.array_sort("near")).select("rep", "label", "size", F.explode(pairs).alias("pair")).select("rep", "label", "size", "pair.*")
        at = ["label", "size", "one", "two"]
        lists = posts.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
        posts = posts.join(lists, at).withColumn("slices", F.ceil(F.col("n") / block).cast("int"))
        posts = posts.withColumn("side", F.pmod(F.xxhash64("rep"), "slices").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        listed = F.xxhash64(*at, F.least("side", "other"), F.greatest("side", "other")).alias("list")
        posts = posts.select("rep", "size", listed, F.xxhash64(F.lit(29), "label").alias("lab"), "one", "two", "side", (F.col("side") != F.col("other")).alias("split"))
        full = posts.join(described.select("rep", "copies", "embedding", "near"), "rep")
        full = full.repartition("list").sortWithinPartitions("size", "list", "side", "rep")
        linked = materialise(full.mapInArrow(partial(_judge, threshold=threshold), "rep long, links long, root long"))
        components = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        least = components.join(groups.select(F.col("no").alias("node"), F.col("rep").alias("id")), "node").groupBy("component").agg(F.min("id").alias("least"))
        components = components.join(least, "component").select("node", F.col("least").alias("component"))
        links = linked.groupBy(F.col("rep").alias("no")).agg(F.sum("links").alias("links"))
        found = links.join(components, links["no"] == components["node"], "full").select(F.coalesce("no", "node").alias("no"), "links", "component")
        members = members.join(found, "no", "left")
    else:
        members = members.withColumns({"links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    component = F.coalesce("component", "rep")
    done = members.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return done.unionByName(alone)


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_vector_dedup": op1_vector_dedup}
ORACLES = {
    "op1_vector_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] e, len(embedding) n from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and list_bool_and([x is not null and isfinite(x) for x in embedding]) and list_sum([x::double * x::double for x in embedding]) > 0
), l as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.n = b.n and a.vec_id <> b.vec_id
  where case when a.n = b.n then list_cosine_similarity(a.e, b.e) else 0 end >= 0.98
), r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a)
select vec_id, (select count(*) from l where l.a = vec_id) n_links, (select min(b) from r where r.a = vec_id) component_id,
  vec_id = (select min(b) from r where r.a = vec_id) kept
from embeddings
"""
}
