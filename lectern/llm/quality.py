"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

Features are indicators of hashed byte 3-grams and word 1- and 2-grams of the whole text, letter case kept,
and of a word three times in a row, whatever the word. Each is
scaled by its class log-count ratio; a row has unit length. Dual coordinate descent fits the hinge loss with class
weights that even out the classes, and the weights are drawn towards their mean size by `interpolation`.

The fit takes a bounded sample, labelled rows of each class in the order of their hash: at most `per_class`, and no more
than have `max_features` features together (but one at least), so that the one task that fits holds some 60 bytes for each
of 2 * `max_features` however long the texts are. Scoring reads every text whole. A null or empty text has the bias alone as its score. Repeated rows are scored each. Null labels and
labels other than 0 and 1 teach nothing; with no labels, or one class alone, the score is that class's share (0.5 with
none). Only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.ragged import WHITE, blocks, buffers, mix
from lectern.session import broadcast_if_small, materialise, table

BITS = 18
SIZE = 1 << BITS
#: Value of the constant feature: small, so that short texts, which have little else, are not judged by it.
BIAS = 0.03


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, one after the other, and the features before each text (n + 1)."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    number = np.repeat(np.arange(n), np.diff(offsets))
    wide = data.astype(np.uint64)
    gram = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)
    same = number[:-2] == number[2:]
    gram, gram_owner = gram[same], number[:-2][same]
    word, before = cased_words(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(before))
    together = owner[:-1] == owner[1:]
    pair = (word[:-1] * np.uint64(0x9FB21C651E98DF25) + word[1:])[together]
    again = (word[:-1] == word[1:]) & together
    twice = np.flatnonzero(again[:-1] & again[1:])  # the word 3-gram "x x x", whatever x is
    hashed = np.concatenate([mix(gram + np.uint64(1 << 40)), word, mix(pair), np.full(len(twice), mix(np.array([3], np.uint64)))])
    keys = np.sort(np.concatenate([gram_owner, owner, owner[:-1][together], owner[twice]]) << BITS | (hashed >> np.uint64(64 - BITS)).astype(np.int64))
    if len(keys):
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    return keys & (SIZE - 1), np.searchsorted(keys >> BITS, np.arange(n + 1))


def cased_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes that tell upper from lower case."""
    from lectern.llm import ragged

    word, before = ragged.words(data, offsets, WHITE)
    # ragged.words folds case: add, for each word, how many of its bytes are capitals
    capital = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
    inside = ~WHITE[data]
    begin = inside.copy()
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    capitals = capital[np.flatnonzero(end) + 1] - capital[np.flatnonzero(begin)]
    return mix(word + np.minimum(capitals, 2).astype(np.uint64)), before


def fit(index: np.ndarray, before: np.ndarray, label: np.ndarray, smoothing: float, cost: float, epochs: int, interpolation: float, seed: int) -> np.ndarray:
    """Weights on indicators, their log-count ratios and, last, the bias. index and before are as features() returns them, label is 0 or 1."""
    n = len(label)
    sign = np.where(label == 1, 1.0, -1.0)
    owner = np.repeat(np.arange(n), np.diff(before))
    # smoothing in proportion to class sizes: a feature never seen has a ratio of 0, whichever class is larger
    size = np.array([(label == c).sum() for c in (0, 1)], float)
    counts = [np.bincount(index[label[owner] == c], minlength=SIZE) + 2 * smoothing * size[c] / n for c in (0, 1)]
    ratio = np.log(counts[1] / size[1]) - np.log(counts[0] / size[0])
    length = np.sqrt(np.bincount(owner, ratio[index] ** 2, n)) + 1e-12
    value = ratio[index] / length[owner]
    balance = n / (2.0 * np.array([max(1, (label == 0).sum()), max(1, (label == 1).sum())]))
    upper = cost * balance[label]
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(n)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(n).tolist():
            at, x = index[before[i] : before[i + 1]], value[before[i] : before[i + 1]]
            slope = sign[i] * (w[at] @ x + bias * BIAS) - 1.0
            new = min(max(alpha[i] - slope / (x @ x + BIAS**2), 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[at] += step * x
                bias += step * BIAS
                alpha[i] = new
    mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
    return np.r_[((1 - interpolation) * mean + interpolation * w) * ratio, ratio, bias * BIAS]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, the text's distinct features, at most 4 * SIZE bytes a row however long the text, and their number; a block of texts at a time."""
    for batch in batches:
        data, offsets, _ = buffers(batch.column(2))
        for a, b in blocks(offsets):
            index, before = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            rows = [index[x:y].astype(np.int32).tobytes() for x, y in zip(before, before[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(rows, pa.binary()), pa.array(np.diff(before))], ["id", "label", "features", "n"])


def _fit_group(group: pa.Table, options: dict) -> pa.Table:
    group = group.sort_by("id")
    label = group["label"].to_numpy().astype(np.int64)
    data, offsets, _ = buffers(group["features"].cast(pa.large_binary()))
    model = fit(np.frombuffer(data.tobytes(), np.int32).astype(np.int64), offsets // 4, label, **options)
    return pa.table({"model": pa.array([model.tobytes()], pa.binary())})


def train(documents: DataFrame, labels: DataFrame, per_class: int = 3000, max_features: int = 1 << 23, smoothing: float = 1.0, cost: float = 4.0, epochs: int = 8, interpolation: float = 0.75, seed: int = 5) -> np.ndarray:
    """documents(id, text), labels(id, label) -> the model, as fit() returns it."""
    usable = labels.where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").cast("int").alias("label"))
    chosen = [usable.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(2 * per_class) for c in (0, 1)]
    chosen = materialise(chosen[0].unionByName(chosen[1]))
    found = documents.join(broadcast_if_small(chosen, chosen.count()), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
    schema = T.StructType([found.schema["id"], found.schema["label"], T.StructField("features", T.BinaryType()), T.StructField("n", T.LongType())])
    found = materialise(found.select("id", "label", "text").mapInArrow(_featured, schema))
    last: dict[int, int] = {}
    kinds: dict[int, tuple[int, int]] = {}
    for label, place, n in sorted(tuple(r) for r in found.select("label", F.xxhash64("id"), "n").collect()):  # at most 4 * per_class small rows
        rows, total = kinds.get(label, (0, 0))
        if not rows or (rows < per_class and total + n <= max_features):
            last[label] = place
        kinds[label] = (rows + 1, total + n)
    if len(kinds) < 2:
        return np.r_[np.zeros(2 * SIZE), {(): 0.0, (0,): -50.0, (1,): 50.0}[tuple(kinds)]]
    taken = [(F.col("label") == c) & (F.xxhash64("id") <= F.lit(place)) for c, place in last.items()]
    sample = found.where(taken[0] | taken[1]).select("id", "label", "features")
    options = {"smoothing": smoothing, "cost": cost, "epochs": epochs, "interpolation": interpolation, "seed": seed}

    def work(group: pa.Table) -> pa.Table:
        return _fit_group(group, options)

    row = sample.groupBy(F.lit(0).alias("all")).applyInArrow(work, "model binary").first()
    return np.frombuffer(row["model"], np.float64)


def _score(batches: Iterator[pa.RecordBatch], shared, slope: float) -> Iterator[pa.RecordBatch]:
    model = shared.value
    weight, square, bias = model[:SIZE], model[SIZE : 2 * SIZE] ** 2, model[-1]
    for batch in batches:
        data, offsets, _ = buffers(batch.column(1))
        out = np.zeros(batch.num_rows)
        for a, b in blocks(offsets):
            index, before = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            owner = np.repeat(np.arange(b - a), np.diff(before))
            size = np.sqrt(np.bincount(owner, square[index], b - a)) + 1e-12
            out[a:b] = np.bincount(owner, weight[index], b - a) / size + bias
        scores = pa.array(1.0 / (1.0 + np.exp(-slope * np.clip(out, -50, 50))))
        kept = [batch.column(i) for i in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *kept, scores], ["id", *batch.schema.names[2:], "score"])


def score(documents: DataFrame, model: np.ndarray, slope: float = 2.0, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """id, the columns to keep, and the score under a name: the logistic function of slope times the margin, so 0.5 is the separating plane."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    fields = [rows.schema["id"], *[rows.schema[f"k{i}"] for i in range(len(keep))]]
    scored = rows.mapInArrow(partial(_score, shared=shared, slope=slope), T.StructType([*fields, T.StructField("score", T.DoubleType())]))
    return scored.toDF(doc_id, *keep, name)


def learned_from(documents: DataFrame, labels: DataFrame, **options) -> np.ndarray:
    """The model learned from labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    said = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return train(documents.select(F.col("doc_id").alias("id"), "text"), said, **options)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned_from(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
