"""Multiclass gradient-boosted trees grown from histograms, with early stopping, refit and explanations.

Features are cut into up to 255 bins once. A round grows one small tree a class on the gradients of the weighted softmax
loss; each level of all its trees is one job, in which tasks add their rows to histograms by class, node, feature and bin,
which Spark sums, and SQL finds the best cut of each node. Rows never leave the executors: what the driver gets is a cut for
each node of a level, and what tasks get is the trees so far. Scores of finished rounds are written with the rows from time
to time, so that tasks apply only the newest trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.ranges import placed
from lectern.session import materialise

HELD = ("_y", "_w", "_valid", "_bins", "_raw")


@dataclass
class Tree:
    """A binary tree of fixed depth: node i has the children 2 i + 1 and 2 i + 2; a node without a feature is a leaf."""

    feature: np.ndarray
    cut: np.ndarray  # rows whose bin is up to this go left
    value: np.ndarray  # what a row's score gains if it stops at this node

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            f = self.feature[at]
            step = 2 * at + 1 + (bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[at])
            at = np.where(f < 0, at, step)
        return at


@dataclass
class Boosted:
    """How features become bins, and the trees of each round, one a class."""

    classes: list[str]
    numbers: list[str]
    labels: list[str]
    edges: list[np.ndarray]
    fills: list[float]
    codes: list[dict[str, int]]
    priors: np.ndarray
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *self.labels]

    def binned(self, batch: pa.RecordBatch) -> np.ndarray:
        """A row's bins; a missing number is the median, a label that was not learned the bin 0."""
        out = np.zeros((batch.num_rows, len(self.features)), np.uint8)
        for j, c in enumerate(self.numbers):
            x = batch[f"_f{j}"].to_numpy(zero_copy_only=False).astype(np.float64)
            out[:, j] = np.searchsorted(self.edges[j], np.where(np.isnan(x), self.fills[j], x), "left")
        for j, c in enumerate(self.labels, len(self.numbers)):
            codes = self.codes[j - len(self.numbers)]
            out[:, j] = [codes.get(x, 0) for x in batch[f"_f{j}"].to_pylist()]
        return out

    def added(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the rounds from `first` on add to each class's score."""
        out = np.zeros((len(bins), len(self.classes)))
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.leaves(bins, self.depth)]
        return out

    def paths(self, bins: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """Of class k: what each feature adds to each row's score along the trees' paths, and the score at the roots.

        Each step from a node to its child adds the difference of their values to the node's feature, so that a row's
        contributions sum to its score less the score at the roots.
        """
        out, base = np.zeros((len(bins), len(self.features))), float(self.priors[k])
        row = np.arange(len(bins))
        for trees in self.rounds:
            tree, at = trees[k], np.zeros(len(bins), np.int64)
            base += float(tree.value[0])
            for _ in range(self.depth):
                f = tree.feature[at]
                to = np.where(f < 0, at, 2 * at + 1 + (bins[row, np.maximum(f, 0)] > tree.cut[at]))
                np.add.at(out, (row, np.maximum(f, 0)), tree.value[to] - tree.value[at])
                at = to
        return out, base


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch["_bins"]
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _raw_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch["_raw"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _features(df: DataFrame, model: Boosted) -> list:
    return [F.col(c).cast("double" if j < len(model.numbers) else "string").alias(f"_f{j}") for j, c in enumerate(model.features)]


def prepared(df: DataFrame, numbers: list[str], labels: list[str], target: str, bins: int = 64, most_labels: int = 200, depth: int = 3) -> Boosted:
    """Bins, medians, label codes and class shares of the training rows; all are bounded, whatever the table's size.

    Labels beyond the most_labels most frequent ones share the bin of unknown ones. Classes are in alphabetical order.
    """
    cuts = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(q) for q in (0.5, *cuts)]), 10_000).alias(f"q{j}") for j, c in enumerate(numbers)], F.count("*").alias("n")).first()
    counts = df.where(F.col(target).isNotNull()).groupBy(target).count().orderBy(target).collect()  # a row a class
    codes = []
    for c in labels:
        often = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(most_labels).collect()
        codes.append({v: i + 1 for i, v in enumerate(sorted(r["v"] for r in often))})
    quantiles = [row[f"q{j}"] or [0.0] for j in range(len(numbers))]
    # balanced weights make all classes as likely at the start
    priors = np.zeros(len(counts))
    return Boosted([r[target] for r in counts], numbers, labels, [np.unique(np.array(q[1:], float)) for q in quantiles], [float(q[0]) for q in quantiles], codes, priors, depth)


def _rows(df: DataFrame, model: Boosted, target: str, valid) -> DataFrame:
    """Written once: class number, balanced weight, whether the row is for validation, bins and scores so far."""
    counts = {r[target]: r["count"] for r in df.where(~valid).groupBy(target).count().collect()}
    total = sum(counts.get(c, 0) for c in model.classes)
    y = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col(target)).cast("int") - 1
    weight = F.array(*[F.lit(total / (len(model.classes) * counts[c]) if counts.get(c) else 0.0) for c in model.classes])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = model.binned(batch)
            start = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(model.classes)), pa.array(np.tile(model.priors, len(rows))))
            yield pa.RecordBatch.from_arrays([batch["_y"], batch["_w"], batch["_valid"], pa.array([r.tobytes() for r in rows], pa.binary()), start], list(HELD))

    kept = df.where(F.col(target).isin(model.classes)).select(y.alias("_y"), F.element_at(weight, y + 1).alias("_w"), valid.alias("_valid"), *_features(df, model))
    return materialise(kept.mapInArrow(bins, "_y int, _w double, _valid boolean, _bins binary, _raw array<double>"))


def _histograms(rows: DataFrame, model: Boosted, first: int, trees: list[Tree], level: int) -> DataFrame:
    """(k, node, feature, bin) sums of gradients, second derivatives and rows over the nodes of a level; k = -1 has the loss of the validation rows."""
    width, classes = len(model.features), len(model.classes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = 2**level - 1
        sums = np.zeros((3, classes, 2**level * width * 256))
        loss = np.zeros(2)
        for batch in batches:
            bins, y, w = _bins_of(batch, width), batch["_y"].to_numpy(), batch["_w"].to_numpy()
            valid = batch["_valid"].to_numpy(zero_copy_only=False).astype(bool)
            p = _softmax(_raw_of(batch) + model.added(bins, first))
            if level == 0:
                loss += [-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)))[valid].sum(), w[valid].sum()]
            bins, y, w, p = bins[~valid], y[~valid], w[~valid], p[~valid]
            for k, tree in enumerate(trees):
                at = tree.leaves(bins, level)
                here = at >= low
                place = (((at - low)[here, None] * width + np.arange(width)) * 256 + bins[here]).ravel()
                g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
                for i, x in enumerate((g, h, np.ones(len(g)))):
                    sums[i, k] += np.bincount(place, np.repeat(x[here], width), sums.shape[2])
        k, place = np.nonzero(sums[2])
        node, feature, cell = place // (width * 256) + low, place // 256 % width, place % 256
        found = [k, node, feature, cell, *(s[k, place] for s in sums)]
        if loss[1]:
            found = [np.r_[x, v] for x, v in zip(found, (-1, 0, 0, 0, loss[0], loss[1], 0), strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(found, kinds, strict=True)], ["k", "node", "feature", "bin", "g", "h", "n"])

    # one exchange serves the sums, the running sums and the best cut; tasks have added up their rows before it
    parts = rows.mapInArrow(add, "k int, node int, feature int, bin int, g double, h double, n double").repartition("k", "node")
    return parts.groupBy("k", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_cuts(histograms: DataFrame, l2: float, least_rows: int) -> DataFrame:
    """For each class and node: sums of its rows, and the feature and bin whose cut gains most, if any gains.

    The gain of a cut is GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2); of equal gains the first feature and bin win.
    """
    upto = W.partitionBy("k", "node", "feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("k", "node", "feature")
    c = histograms.withColumns({f"{x}l": F.sum(x).over(upto) for x in "ghn"}).withColumns({f"{x}t": F.sum(x).over(whole) for x in "ghn"})
    part = lambda g, h: g * g / (h + l2)
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - part(F.col("gt"), F.col("ht"))
    may = (F.col("nl") >= least_rows) & (F.col("nt") - F.col("nl") >= least_rows) & (gain > 1e-12)
    best = F.max(F.when(may, F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "gl", "hl")))
    found = c.groupBy("k", "node").agg(best.alias("b"), F.max(F.when(F.col("feature") == 0, F.struct("gt", "ht"))).alias("t"))
    return found.select("k", "node", "t.gt", "t.ht", "b.gain", (-F.col("b.feature")).alias("feature"), (-F.col("b.bin")).alias("bin"), "b.gl", "b.hl")


def _grown(rows: DataFrame, model: Boosted, rounds: int, rate: float, l2: float, least_rows: int, patience: int | None, kept_rounds: int = 12) -> Boosted:
    """Rounds until the loss of the validation rows has not fallen for `patience` rounds, or so many where patience is None."""
    first = 0
    size = 2 ** (model.depth + 1) - 1
    for turn in range(rounds + 1):
        trees = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in model.classes]
        for level in range(model.depth):
            if turn == rounds and (level or patience is None):
                break  # the last turn is for the loss alone
            cuts = best_cuts(_histograms(rows, model, first, trees, level), l2, least_rows).collect()  # a row for each class and node of the level
            for c in cuts:
                if c["k"] < 0:
                    model.losses.append(c["gt"] / c["ht"])
                    continue
                tree, node = trees[c["k"]], c["node"]
                tree.value[node] = -rate * c["gt"] / (c["ht"] + l2)
                if c["feature"] is not None:
                    tree.feature[node], tree.cut[node] = c["feature"], c["bin"]
                    tree.value[2 * node + 1] = -rate * c["gl"] / (c["hl"] + l2)
                    tree.value[2 * node + 2] = -rate * (c["gt"] - c["gl"]) / (c["ht"] - c["hl"] + l2)
            if not any((t.feature[2**level - 1 : 2 ** (level + 1) - 1] >= 0).any() for t in trees):
                break
        if turn == rounds or (patience is not None and len(model.losses) - 1 - int(np.argmin(model.losses)) >= patience):
            break
        if all(t.feature[0] < 0 for t in trees):
            break  # nothing is left to learn
        model.rounds.append(trees)
        if len(model.rounds) - first >= kept_rounds:
            rows, first = _with_scores(rows, model, first), len(model.rounds)
    return model


def _with_scores(rows: DataFrame, model: Boosted, first: int) -> DataFrame:
    width = len(model.features)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw_of(batch) + model.added(_bins_of(batch, width), first)
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]), pa.array(raw.ravel()))
            yield pa.RecordBatch.from_arrays([batch[c] for c in HELD[:-1]] + [scores], list(HELD))

    return materialise(rows.mapInArrow(add, rows.schema))


def fit(df: DataFrame, numbers: list[str], labels: list[str], target: str = "target_class", key: str = "id_student", rounds: int = 40, patience: int = 4, rate: float = 0.3, l2: float = 1.5, least_rows: int = 20, depth: int = 3, bins: int = 64, seed: int = 42) -> Boosted:
    """Trees for every row of df: first with a fifth of each class held out for early stopping, then again over all rows with
    1.15 times the best number of rounds (M06). Rows are held out by the hash of class and key. Rows without a class take no part."""
    known = df.where(F.col(target).isNotNull())
    start = prepared(known, numbers, labels, target, bins, depth=depth)
    valid = F.pmod(F.xxhash64(F.lit(seed), target, key), F.lit(5)) == 0
    rows = _rows(known, start, target, valid)
    stopped = _grown(rows, replace(start, rounds=[], losses=[]), rounds, rate, l2, least_rows, patience)
    best = int(np.argmin(stopped.losses)) if stopped.losses else len(stopped.rounds)
    every = _rows(known, start, target, F.lit(False))
    whole = _grown(every, replace(start, rounds=[], losses=[]), max(1, math.floor(best * 1.15)), rate, l2, least_rows, None)
    return replace(whole, losses=stopped.losses)


def _applied(df: DataFrame, model: Boosted, keep: list[str], rows, schema: T.StructType) -> DataFrame:
    """rows(bins, batch) of df's rows, as columns after those kept."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = rows(model.binned(batch), batch)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *arrays], schema.names)

    return df.select(*keep, *_features(df, model)).mapInArrow(apply, schema)


def scored(model: Boosted, df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, prob_<class> for each class, predicted_class and at_risk_probability = P(Withdrawn) + P(Fail)."""
    names = model.classes
    double = lambda n: T.StructField(n, T.DoubleType())
    schema = T.StructType([*[df.schema[k] for k in keys], *[double(f"prob_{n}") for n in names], T.StructField("predicted_class", T.StringType()), double("at_risk_probability")])

    def rows(bins: np.ndarray, _: pa.RecordBatch) -> list[pa.Array]:
        p = _softmax(model.priors + model.added(bins))
        risk = p[:, [i for i, n in enumerate(names) if n in ("Withdrawn", "Fail")]].sum(1)
        return [*(pa.array(p[:, i].copy()) for i in range(len(names))), pa.array([names[i] for i in p.argmax(1)]), pa.array(risk)]

    return _applied(df, model, keys, rows, schema)


def path_contributions(model: Boosted, df: DataFrame, keys: list[str], of: str) -> DataFrame:
    """keys, feature, contribution, and the row's score and base, for the score of one class before the softmax."""
    k = model.classes.index(of)
    double = lambda n: T.StructField(n, T.DoubleType())
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField("parts", T.ArrayType(T.DoubleType())), double("score"), double("base")])

    def rows(bins: np.ndarray, _: pa.RecordBatch) -> list[pa.Array]:
        parts, base = model.paths(bins, k)
        score = model.priors[k] + model.added(bins)[:, k]
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel()))
        return [listed, pa.array(score), pa.array(np.full(len(parts), base))]

    found = _applied(df, model, keys, rows, schema)
    each = F.transform(F.col("parts"), lambda x, i: F.struct(F.array(*[F.lit(c) for c in model.features])[i].alias("feature"), x.alias("contribution")))
    return found.select(*keys, F.inline(each), "score", "base")


def permutation_importance(model: Boosted, df: DataFrame, key: list[str], target: str = "target_class", seed: int = 42) -> DataFrame:
    """(feature, importance): how much the mean log loss rises when a feature's values are dealt to other rows.

    Rows are numbered once, by range partitions, in the order of a hash of their key; a feature's values then come from the
    row half the table on, one feature at a time. Each row is joined with one other, and losses are summed in tasks.
    """
    names, width = model.classes, len(model.features)
    known = df.where(F.col(target).isin(names))
    y = F.array_position(F.array(*[F.lit(c) for c in names]), F.col(target)).cast("int") - 1
    mixed = known.select(F.lit(0).alias("_g"), F.xxhash64(F.lit(seed), *key).alias("_h"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], y.alias("_y"), *_features(known, model))
    schema = T.StructType([T.StructField("_y", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_all", T.LongType()), T.StructField("_bins", T.BinaryType())])
    numbered = placed(mixed, ["_g"], ["_h", *[f"_k{i}" for i in range(len(key))]])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["_y"], batch["place"], batch["n"], pa.array([r.tobytes() for r in model.binned(batch)], pa.binary())], schema.names)

    rows = materialise(numbered.select("_y", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"), *[f"_f{j}" for j in range(width)]).mapInArrow(bins, schema))
    other = rows.select(F.pmod(F.col("_at") + F.floor(F.col("_all") / 2), "_all").alias("_at"), F.col("_bins").alias("_dealt"))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(width + 1), 0
        for batch in batches:
            own, dealt = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, width) for c in ("_bins", "_dealt"))
            truth, n = batch["_y"].to_numpy(), n + batch.num_rows
            for j in range(width + 1):  # the last is the loss as it is
                seen = own.copy()
                if j < width:
                    seen[:, j] = dealt[:, j]
                p = _softmax(model.priors + model.added(seen))
                sums[j] -= np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-15)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(sums[:width] - sums[width]), pa.array(np.full(width, n, np.int64))], ["j", "rise", "n"])

    summed = rows.join(other, "_at").select("_y", "_bins", "_dealt").mapInArrow(losses, "j int, rise double, n long").groupBy("j").agg((F.sum("rise") / F.sum("n")).alias("importance"))
    return summed.select(F.array(*[F.lit(c) for c in model.features])[F.col("j")].alias("feature"), "importance")
