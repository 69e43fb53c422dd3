"""Bayesian knowledge tracing: input, trace and fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.folds import GUESS, LEARN, PRIOR, SLIP, bkt_trace, moved, trellis
from lectern.operators.ranges import pieces, placed
from lectern.session import materialise

#: Answers of a learner's sequence in one row; longer ones are cut, and a state is carried from piece to piece.
PIECE = 4096
KEYS = ["user_id", "skill_name"]


def answers(submissions: DataFrame, definitions: DataFrame, pass_mark: float = 50.0, student: str = "id_student") -> DataFrame:
    """Graded answers in order: no exams, known assessments, scored; a skill is module and assessment type."""
    defined = definitions.where("assessment_type <> 'Exam'").select("id_assessment", "code_module", "assessment_type")
    joined = submissions.dropna(subset=[student, "id_assessment", "score", "date_submitted"]).join(defined, "id_assessment")
    rows = joined.select(
        F.col(student).alias("user_id"), F.concat_ws("_", "code_module", "assessment_type").alias("skill_name"),
        (F.col("score") >= pass_mark).cast("int").alias("correct"), "date_submitted", "id_assessment", "score",
    )
    # numbered by ranges and offsets, so that a learner with half of all answers is many tasks
    return placed(rows, KEYS, ["date_submitted", "id_assessment", "score"]).withColumn("order_id", (F.col("place") + 1).cast("int")).drop("place", "n")


def sequences(graded: DataFrame, size: int = PIECE) -> DataFrame:
    """A row for each piece of a learner's answers to a skill, in order."""
    return pieces(graded, KEYS, ["order_id"], "correct", size).withColumnRenamed("values", "answers")


def carried(cut: DataFrame, size: int) -> DataFrame:
    """(user_id, skill_name, piece, known, end): for sequences of several pieces, P(known) before each piece, and what the
    later pieces say of the states (unknown, known) after it, null after the last. cut has pieces and parameters.

    A piece acts on the two states as a triangular matrix, so one small matrix a piece is all that meets in a row.
    """
    rows = cut.where(F.col("n") > size).withColumn("m", trellis(F.col("answers"), F.col("learn"), F.col("guess"), F.col("slip")))
    packed = F.array_sort(F.collect_list(F.struct("piece", "m.x", "m.y", "m.z")))
    by = rows.groupBy(*KEYS).agg(packed.alias("ms"), F.first("prior").alias("prior"))
    start = F.struct(F.col("prior").cast("double").alias("known"), F.array().cast("array<double>").alias("out"))
    ahead = F.aggregate("ms", start, lambda s, m: F.struct(moved(s["known"], m).alias("known"), F.array_append(s["out"], s["known"]).alias("out")))["out"]
    none = F.struct(F.lit(1.0).alias("u"), F.lit(1.0).alias("k"), F.array().cast("array<array<double>>").alias("out"))

    def back(s: Column, m: Column) -> Column:
        k, u = s["k"] * m["x"], s["k"] * m["y"] + s["u"] * m["z"]
        return F.struct((u / (u + k)).alias("u"), (k / (u + k)).alias("k"), F.array_append(s["out"], F.array(s["u"], s["k"])).alias("out"))

    behind = F.reverse(F.aggregate(F.reverse("ms"), none, back)["out"])
    each = F.arrays_zip(F.col("ms"), ahead.alias("known"), behind.alias("end"))
    found = by.select(*KEYS, F.size("ms").alias("last"), F.explode(each).alias("x"))
    return found.select(*KEYS, F.col("x.ms.piece").alias("piece"), F.col("x.known").alias("known"), F.when(F.col("x.ms.piece") + 1 < F.col("last"), F.col("x.end")).alias("end"))


def predict(graded: DataFrame, parameters: DataFrame | None = None, size: int = PIECE) -> DataFrame:
    """Per answer: p_known_before, p_correct and p_known_after, with the skill's parameters, or the defaults."""
    found = sequences(graded, size)
    values: dict[str, float] = {"prior": PRIOR, "learn": LEARN, "guess": GUESS, "slip": SLIP}
    if parameters is not None:
        found = found.join(parameters.select("skill_name", *values), "skill_name", "left").withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in values.items()})
    else:
        found = found.withColumns({k: F.lit(v) for k, v in values.items()})
    found = materialise(found)
    found = found.join(carried(found, size).drop("end"), [*KEYS, "piece"], "left").withColumn("prior", F.coalesce("known", "prior"))
    trace = bkt_trace(F.col("answers"), *[F.col(k) for k in values])
    return found.select(*KEYS, "piece", F.posexplode(trace).alias("place", "t")).select(
        *KEYS, (F.col("piece") * size + F.col("place") + 1).cast("int").alias("order_id"), "t.answer", "t.p_known_before", "t.p_correct", "t.p_known_after"
    )


STATISTICS = ("learner_n", "prior_k", "learn_k", "learn_n", "guess_k", "guess_n", "slip_k", "slip_n")


def expected(values: np.ndarray, bounds: np.ndarray, prior: np.ndarray, learn: np.ndarray, guess: np.ndarray, slip: np.ndarray, end: np.ndarray, first: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Expected counts of pieces of learners' sequences by forward and backward passes, in the order of STATISTICS, a row a piece.

    values holds the answers of all pieces, bounds where each begins and the last one ends. prior is P(known) before the
    piece; end, where a piece follows, is what is behind it says of (unknown, known) then, else NaN. Pieces step through
    time together, longest first, so that at each time those that still run stand in front; so many answers at once as
    `most` says.
    """
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), len(STATISTICS)))
    order = np.argsort(-sizes, kind="stable")
    low = 0
    while low < len(order) and sizes[order[low]]:
        rows = order[low : low + max(1, most // int(sizes[order[low]]))]
        rows = rows[sizes[rows] > 0]
        out[rows] = _together(values, bounds[rows], sizes[rows], *(x[rows] for x in (prior, learn, guess, slip, end, first)))
        low += len(rows)
    return out


def _together(values: np.ndarray, starts: np.ndarray, n: np.ndarray, prior: np.ndarray, learn: np.ndarray, guess: np.ndarray, slip: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    count, most = len(n), int(n[0])
    time = np.arange(most)
    inside = time[:, None] < n
    right = np.zeros((most, count), bool)
    right[inside] = values[(starts + time[:, None])[inside]] == 1
    emit = np.stack([np.where(right, guess, 1 - guess), np.where(right, 1 - slip, slip)], 2)
    running = inside.sum(1)
    ahead, back = np.zeros((most, count, 2)), np.ones((most, count, 2))
    state = np.stack([1 - prior, prior], 1)
    for t in range(most):
        c = running[t]
        x = state[:c] * emit[t, :c]
        x /= x.sum(1, keepdims=True)
        ahead[t, :c] = x
        state[:c, 0], state[:c, 1] = x[:, 0] * (1 - learn[:c]), x[:, 0] * learn[:c] + x[:, 1]
    last, row = n - 1, np.arange(count)
    follows = ~np.isnan(end[:, 0])
    e0, e1 = np.where(follows, end[:, 0], 1.0), np.where(follows, end[:, 1], 1.0)
    back[last, row, 0], back[last, row, 1] = np.where(follows, (1 - learn) * e0 + learn * e1, 1.0), e1
    learned, unknown = np.zeros(count), np.zeros(count)
    for t in range(most - 2, -1, -1):
        c = running[t + 1]
        y = emit[t + 1, :c] * back[t + 1, :c]
        b = np.stack([(1 - learn[:c]) * y[:, 0] + learn[:c] * y[:, 1], y[:, 1]], 1)
        whole = (ahead[t, :c] * b).sum(1)
        learned[:c] += ahead[t, :c, 0] * learn[:c] * y[:, 1] / whole
        unknown[:c] += ahead[t, :c, 0] * b[:, 0] / whole
        back[t, :c] = b / b.sum(1, keepdims=True)
    posterior = ahead * back
    posterior /= np.maximum(posterior.sum(2, keepdims=True), 1e-300)
    x = ahead[last, row]
    over = x[:, 0] * ((1 - learn) * e0 + learn * e1)
    whole = over + x[:, 1] * e1
    learned += np.where(follows, x[:, 0] * learn * e1 / whole, 0.0)
    unknown += np.where(follows, over / whole, 0.0)
    wrong = inside & ~right
    return np.stack([
        first.astype(float), np.where(first, posterior[0, :, 1], 0.0), learned, unknown,
        (posterior[..., 0] * right).sum(0), (posterior[..., 0] * inside).sum(0), (posterior[..., 1] * wrong).sum(0), (posterior[..., 1] * inside).sum(0),
    ], 1)


def fit(graded: DataFrame, rounds: int = 10, size: int = PIECE) -> DataFrame:
    """Prior, learn, guess and slip of every skill by expectation maximisation, all skills at once.

    The expectation step runs over pieces of learners' sequences in tasks and emits sums per batch and skill, so a skill with a
    third of all answers is spread over all tasks; Spark adds them up. Parameters are a row a skill. Guess and slip
    stay below one half, which fixes what 'known' means.
    """
    found = materialise(sequences(graded, size))
    start = {"prior": PRIOR, "learn": LEARN, "guess": GUESS, "slip": SLIP}
    parameters = materialise(found.select("skill_name").distinct().withColumns({k: F.lit(v) for k, v in start.items()}))

    def expect(batches):
        for batch in batches:
            answers_ = batch["answers"]
            bounds = np.r_[0, np.cumsum(answers_.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            end = np.array([x or (np.nan, np.nan) for x in batch["end"].to_pylist()], float).reshape(-1, 2)
            numbers = [batch[c].to_numpy(zero_copy_only=False) for c in start]
            counts = expected(answers_.flatten().to_numpy(zero_copy_only=False), bounds, *numbers, end, batch["first"].to_numpy(zero_copy_only=False).astype(bool))
            skills, at = np.unique(np.array(batch["skill_name"].to_pylist(), object).astype(str), return_inverse=True)
            sums = [np.bincount(at, counts[:, i], len(skills)) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([pa.array(skills.tolist(), pa.string()), *(pa.array(x, pa.float64()) for x in sums)], ["skill_name", *STATISTICS])

    schema = "skill_name string, " + ", ".join(f"{s} double" for s in STATISTICS)
    clamp = lambda k, n, high: F.least(F.greatest(F.coalesce(F.try_divide(k, n), F.lit(0.0)), F.lit(1e-3)), F.lit(high))
    for _ in range(rounds):
        cut = found.join(parameters, "skill_name")
        cut = cut.join(carried(cut, size), [*KEYS, "piece"], "left").withColumn("prior", F.coalesce("known", "prior"))
        counted = cut.select("skill_name", "answers", *start, "end", (F.col("piece") == 0).alias("first")).mapInArrow(expect, schema)
        summed = counted.groupBy("skill_name").agg(*[F.sum(s).alias(s) for s in STATISTICS])
        parameters = materialise(summed.select(
            "skill_name", clamp(F.col("prior_k"), F.col("learner_n"), 0.999).alias("prior"), clamp(F.col("learn_k"), F.col("learn_n"), 0.999).alias("learn"),
            clamp(F.col("guess_k"), F.col("guess_n"), 0.49).alias("guess"), clamp(F.col("slip_k"), F.col("slip_n"), 0.49).alias("slip"),
        ))
    return parameters
