"""Hard negatives by threshold joins with an inverted index over suffix norms.

Vectors are integers, floor(scale * x). An anchor asks for windows of scores: the best rows of its label (its positives),
then, for each positive, the best rows of other labels between two shares of the positive's score. A window is filled by a
threshold join: all rows with a score of at least a threshold, which is lowered until the window is full or its lower end
is reached.

Rows are dealt into blocks of bounded size and every anchor visits every block: a stated query set against all rows, in
blocks. A block's index holds, dimension by dimension in the order of their energy, the rows that need the dimension: one
is left out of all its trailing dimensions together, as far as their norm times the anchors' norm there stays below the
lowest threshold asked. Rows stand in the order of how many dimensions they need, so that each dimension's list is a slice.
Partial scores are accumulated a few dimensions at a time; after each, rows are dropped whose partial score plus the
product of the remaining norms stays below every anchor's threshold. What survives is scored exactly, in 64-bit integers.

A pilot over one block in 64 lowers each anchor's threshold until the block fills its windows. As a window's k-th best of
some rows is never better than that of all, the pilot's thresholds hold for the pass over all blocks, which returns about
64 times k rows a window at most, k a block, and no more at any table size. Equal vectors of a label are one row with their
k + 1 smallest ids, equal anchors one query, so a group with a third of all rows is one row.

Rows with a null label, id or vector, or with null or non-finite components take no part, nor do empty vectors; a vector
is compared with those of its length. A repeated row is one row; an id with different vectors or labels has a row for each,
and rows of the anchor's own id are never its partners. Scores are those of 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import materialise, table

LEAST, MOST = -(1 << 63), (1 << 63) - 1
STEP, CHUNK = 8, 64


class Index:
    """Rows of a block by dimension, with the norms of what remains behind each."""

    def __init__(self, ints: np.ndarray) -> None:
        self.ints = ints
        values = ints.astype(np.float64)
        self.order = np.argsort(-(values * values).sum(0), kind="stable")
        self.values, self.tails = self.by_dimension(ints)

    def by_dimension(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in the index's order of dimensions, and the norm from each dimension on (one more column than dimensions)."""
        values = ints.astype(np.float64)[:, self.order]
        tails = np.sqrt(np.cumsum((values * values)[:, ::-1], 1)[:, ::-1])
        return values, np.c_[tails, np.zeros(len(values))]

    def reaching(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (anchor, row, score) with an exact score of at least the anchor's threshold."""
        x, tails = self.by_dimension(anchors)
        slack = 1e-9 * tails[:, 0].max(initial=0) * self.tails[:, 0].max(initial=0) + 1
        least = least.astype(np.float64) - slack
        width = x.shape[1]
        needed = (self.tails[:, :width] * tails[:, :width].max(0) >= least.min()).sum(1)  # dimensions with the row in their list
        rows = np.argsort(-needed, kind="stable")
        needed = needed[rows]
        sums = np.zeros((len(x), len(rows)))
        for low in range(0, width, STEP):
            high = min(low + STEP, width)
            listed = int(np.searchsorted(-needed, -low, "left"))
            sums[:, :listed] += x[:, low:high] @ self.values[rows[:listed], low:high].T
            alive = (sums[:, :listed] + tails[:, high, None] * self.tails[rows[:listed], high] >= least[:, None]).any(0)
            if alive.mean() < 0.75 if listed else False:
                keep = np.r_[np.flatnonzero(alive), np.arange(listed, len(rows))]
                rows, needed, sums = rows[keep], needed[keep], sums[:, keep]
        ends = np.minimum(-(-needed // STEP) * STEP, width)  # as far as the row's partial score goes
        i, j = np.nonzero(sums + tails[:, ends] * self.tails[rows, ends] >= least[:, None])
        score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", anchors[i[a : a + 65536]], self.ints[rows[j[a : a + 65536]]]) for a in range(0, len(i), 65536))])
        return i, rows[j], score


def _within(index: Index, own: np.ndarray, first: np.ndarray, sizes: np.ndarray, asked: dict, k: int, same: bool, lower: bool) -> Iterator[tuple]:
    """A chunk of queries against one index: query, window, row and score of the k best rows there, by score and smallest id."""
    anchors, labels, tops, floors = asked["ints"], asked["label"], asked["tops"], asked["floors"]
    norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))[:, None] * index.tails[:, 0].max()
    live = tops >= floors
    for share in (0.5, 0.25, 0.125, 0.0, None) if lower else (None,):  # of the largest score that the norms allow
        if not live.any():
            break
        lows = asked["lows"] if share is None else np.maximum(floors, np.minimum(tops, np.minimum(norms * share, 4e18).astype(np.int64)))
        some = np.flatnonzero(live.any(1))
        i, j, score = index.reaching(anchors[some], np.where(live, lows, MOST)[some].min(1))
        good = (own[j] == labels[some][i]) == same
        i, j, score = some[i[good]], j[good], score[good]
        for w in range(tops.shape[1]):
            inside = (score <= tops[i, w]) & (score >= lows[i, w]) & live[i, w]
            a, b, s = i[inside], j[inside], score[inside]
            order = np.lexsort((first[b], -s, a))
            a, b, s = a[order], b[order], s[order]
            filled = (np.bincount(a, sizes[b], len(anchors)) >= k) | (lows[:, w] <= floors[:, w]) | (share is None)
            keep = (np.arange(len(a)) - np.searchsorted(a, a) < k) & filled[a]
            yield a[keep], np.full(keep.sum(), w, np.int32), b[keep], s[keep]
            live[filled, w] = False


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(batches: Iterator[pa.RecordBatch], k: int, same: bool, lower: bool) -> Iterator[pa.RecordBatch]:
    """Blocks in, the rows of each first, then the queries that visit it; (q, win, score, ids) out."""

    def answered(parts: list[pa.Table], queries: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(parts)
        ints, own = _lists(rows["ints"]), rows["label"].to_numpy()
        ids = rows["ids"].combine_chunks()
        first, sizes = np.array([x[0] for x in ids.to_pylist()]), ids.value_lengths().to_numpy(zero_copy_only=False)
        labels = queries["label"].to_numpy()
        cuts = [(np.arange(len(own)), np.arange(len(labels)))]
        if same:
            cuts = [(np.flatnonzero(own == x), np.flatnonzero(labels == x)) for x in np.unique(labels)]
        asked = {"ints": _lists(queries["ints"]), "label": labels, **{c: _lists(queries[c]) for c in ("tops", "floors", "lows")}}
        key = queries["key"].to_numpy()
        for mine, theirs in cuts:
            if not len(mine):
                continue
            index = Index(ints[mine])
            theirs = theirs[np.argsort(asked["lows"][theirs].min(1), kind="stable")]  # queries of like thresholds share an index
            for low in range(0, len(theirs), CHUNK):
                chunk = theirs[low : low + CHUNK]
                for a, w, b, s in _within(index, own[mine], first[mine], sizes[mine], {c: x[chunk] for c, x in asked.items()}, k, same, lower):
                    yield pa.RecordBatch.from_arrays([pa.array(key[chunk[a]]), pa.array(w), pa.array(s), ids.take(pa.array(mine[b]))], ["q", "win", "score", "ids"])

    block, held = None, []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        size, cell, query = (t[c].to_numpy() for c in ("size", "cell", "query"))
        new = (size[1:] != size[:-1]) | (cell[1:] != cell[:-1]) | (query[1:] != query[:-1])
        cuts = np.r_[0, np.flatnonzero(new) + 1, len(cell)] if len(cell) else np.zeros(1, int)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (size[a], cell[a]) != block:
                block, held = (size[a], cell[a]), []
            if not query[a]:
                held.append(t.slice(a, b - a))
            elif held:
                yield from answered(held, t.slice(a, b - a))


def _windows_filled(groups: DataFrame, queries: DataFrame, upto: int, k: int, same: bool, lower: bool) -> DataFrame:
    """q, win, rank, id and score of the k best rows in each window, over the first `upto` of the cells."""
    none = F.lit(None).cast("array<long>")
    rows = groups.where(F.col("cell") < upto).select("size", "cell", F.lit(0).alias("query"), F.col("g").alias("key"), "label", "ints", "ids", none.alias("tops"), none.alias("floors"), none.alias("lows"))
    visits = queries.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(upto - 1))))
    visits = visits.select("size", "cell", F.lit(1).alias("query"), F.col("q").alias("key"), "label", "ints", none.alias("ids"), "tops", "floors", "lows")
    met = rows.unionByName(visits).repartition("size", "cell").sortWithinPartitions("size", "cell", "query")
    found = met.mapInArrow(partial(_search, k=k, same=same, lower=lower), "q long, win int, score long, ids array<long>")
    first = W.partitionBy("q", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("id", F.explode("ids")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("q", "win", "rank", "id", "score")


def _filled(groups: DataFrame, queries: DataFrame, cells: int, k: int, same: bool) -> DataFrame:
    """The pilot, then all cells from its thresholds on."""
    start = queries.withColumn("lows", F.col("floors"))
    pilot = _windows_filled(groups, start, -(-cells // 64), k, same, True)
    full = pilot.groupBy("q", "win").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    known = full.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("win", "low"))).alias("known"))
    found = start.join(materialise(known), "q", "left")
    lows = F.transform("floors", lambda x, i: F.coalesce(F.element_at("known", i), x))
    return _windows_filled(groups, found.withColumn("lows", lows).drop("known"), cells, k, same, False)


def hard_negatives(
    vectors: DataFrame, anchor: object, positives: int = 5, negatives: int = 10, shares: tuple[int, int] = (30, 90), scale: int = 256, block_rows: int = 1 << 16,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for every anchor, as the module says.

    anchor is a condition on the column vec_id of the rows. A negative's score is between the two shares, in hundredths, of
    its positive's score; equal scores come by ascending id.
    """
    low, high = shares
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("e"), F.col(f"`{label}`").cast("long").alias("label"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & ~bad)
    ints = F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = rows.select("vec_id", "label", ints.alias("ints")).distinct()
    keep = max(positives, negatives) + 1
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("label", "ints").orderBy("vec_id"))).where(F.col("r") <= keep)
    groups = ranked.groupBy("label", "ints").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    groups = materialise(groups.select(F.monotonically_increasing_id().alias("g"), "label", F.size("ints").alias("size"), "ints", "ids"))
    n = groups.count()
    # blocks of bounded size; on small tables as many as tasks can run, if they have 1,024 rows each
    cells = max(1, math.ceil(n / block_rows), min(math.ceil(n / 1024), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    groups = groups.withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(cells)).cast("int"))
    anchors = materialise(rows.where(anchor).join(groups.select("g", "label", "ints"), ["label", "ints"]).select(F.col("vec_id").alias("anchor_id"), F.col("g").alias("q")))
    leads = materialise(groups.join(anchors.select(F.col("q").alias("g")).distinct(), "g", "left_semi").select(F.col("g").alias("q"), "label", "size", "ints"))
    one = lambda x: F.array(F.lit(x).cast("long"))
    same = _filled(groups, leads.withColumns({"tops": one(MOST), "floors": one(LEAST)}), cells, positives + 1, True)
    best = materialise(same.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best")))

    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    pairs = anchors.join(best, "q").select("q", "anchor_id", F.explode(others).alias("p"))
    pairs = pairs.select("q", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")).where("positive_score >= 0")
    scores = F.array_sort(F.array_distinct(F.filter(F.transform("best", lambda x: x["score"]), lambda s: s >= 0)))
    asked = leads.join(best.select("q", scores.alias("scores")).where(F.size("scores") > 0), "q")
    # 100 * score <= high * p and >= low * p, in whole numbers; windows that an anchor lacks are empty
    part = lambda p, share: p.cast("decimal(20,0)") * share / 100
    padded = lambda c, x: F.concat(c, F.array_repeat(F.lit(x).cast("long"), positives + 1 - F.size("scores")))
    tops, floors = F.transform("scores", lambda p: F.floor(part(p, high)).cast("long")), F.transform("scores", lambda p: F.ceil(part(p, low)).cast("long"))
    asked = asked.withColumns({"tops": padded(tops, LEAST), "floors": padded(floors, MOST)})
    found = _filled(groups, asked.select("q", "label", "size", "ints", "tops", "floors"), cells, negatives, False)
    named = found.join(asked.select("q", "scores"), "q").select("q", F.element_at("scores", F.col("win") + 1).alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    lists = named.groupBy("q", "positive_score").agg(F.collect_list(F.struct("rank", "negative_id", "negative_score")).alias("found"))
    out = pairs.join(lists, ["q", "positive_score"]).withColumn("x", F.explode("found"))
    return out.select("anchor_id", "positive_id", F.col("x.rank").alias("rank"), F.col("x.negative_id").alias("negative_id"), "positive_score", F.col("x.negative_score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {
    "op11_hard_negatives": """
with v as (
  select distinct vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label, [floor(256 * x::double) for x in embedding] e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and list_bool_and([x is not null and isfinite(x) for x in embedding])
), s as (
  select a.vec_id anchor_id, b.vec_id other, a.label = b.label same, list_inner_product(a.e, b.e)::bigint score
  from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 100 = 0
), p as (
  select anchor_id, other positive_id, score positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
), n as (
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as rank, other negative_id, positive_score, score negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
}
