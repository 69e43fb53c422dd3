"""Recursive per-sequence computations as folds over ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIOR, LEARN, GUESS, SLIP = 0.40, 0.15, 0.20, 0.10


def bkt_step(known: Column, correct: Column, learn: Column | float = LEARN, guess: Column | float = GUESS, slip: Column | float = SLIP) -> Column:
    """P(known) after one answer: Bayes' rule on the answer, then the chance of learning."""
    learn, guess, slip = (x if isinstance(x, Column) else F.lit(x) for x in (learn, guess, slip))
    right = known * (1.0 - slip) / (known * (1.0 - slip) + (1.0 - known) * guess)
    wrong = known * slip / (known * slip + (1.0 - known) * (1.0 - guess))
    seen = F.when(correct == 1, right).otherwise(wrong)
    return seen + (1.0 - seen) * learn


def bkt_trace(answers: Column, prior: Column | float = PRIOR, learn=LEARN, guess=GUESS, slip=SLIP) -> Column:
    """For each answer (0 or 1) in order: p_known_before, p_correct, p_known_after."""
    prior, guess_, slip_ = (x if isinstance(x, Column) else F.lit(x) for x in (prior, guess, slip))
    kind = "array<struct<answer:int,p_known_before:double,p_correct:double,p_known_after:double>>"
    start = F.struct(prior.cast("double").alias("known"), F.array().cast(kind).alias("trace"))

    def step(state: Column, answer: Column) -> Column:
        known = state["known"]
        after = bkt_step(known, answer, learn, guess, slip)
        said = F.struct(
            answer.cast("int").alias("answer"), known.alias("p_known_before"),
            (known * (1.0 - slip_) + (1.0 - known) * guess_).alias("p_correct"), after.alias("p_known_after"),
        )
        return F.struct(after.alias("known"), F.array_append(state["trace"], said).alias("trace"))

    return F.aggregate(answers, start, step)["trace"]


def online_mastery(prior: Column, score: Column, answers: int = 20) -> Column:
    """Mastery after a submission: round(answers * score / 100) right answers, then the wrong ones."""
    right = F.bround(F.lit(float(answers)) * score / 100.0).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(answers)), prior.cast("double"), lambda known, i: bkt_step(known, F.when(i <= right, 1).otherwise(0)))


def trellis(answers: Column, learn: Column | float = LEARN, guess: Column | float = GUESS, slip: Column | float = SLIP) -> Column:
    """What a run of answers does to the weights (known, unknown), as a triangular matrix x, y, z: known becomes
    x * known + y * unknown, unknown becomes z * unknown. It is scaled, as only the ratio of weights counts."""
    learn, guess, slip = (x if isinstance(x, Column) else F.lit(x) for x in (learn, guess, slip))

    def step(m: Column, answer: Column) -> Column:
        known = F.when(answer == 1, 1.0 - slip).otherwise(slip)
        unknown = F.when(answer == 1, guess).otherwise(1.0 - guess)
        return scaled(known * m["x"], known * m["y"] + unknown * learn * m["z"], unknown * (1.0 - learn) * m["z"])

    return F.aggregate(answers, _unit(), step)


def scaled(x: Column, y: Column, z: Column) -> Column:
    size = x + y + z
    return F.struct((x / size).alias("x"), (y / size).alias("y"), (z / size).alias("z"))


def _unit() -> Column:
    return F.struct(F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("z"))


def moved(known: Column, m: Column) -> Column:
    """P(known) after what a matrix of trellis() stands for."""
    to = m["x"] * known + m["y"] * (1.0 - known)
    return to / (to + m["z"] * (1.0 - known))


def after_submission(known: float, score: float, answers: int = 20) -> float:
    """online_mastery() in plain Python, for folds over rows; a score that is no number changes nothing."""
    if score != score:
        return known
    right = round(answers * score / 100.0)
    for i in range(answers):
        if i < right:
            seen = known * (1 - SLIP) / (known * (1 - SLIP) + (1 - known) * GUESS)
        else:
            seen = known * SLIP / (known * SLIP + (1 - known) * (1 - GUESS))
        known = seen + (1 - seen) * LEARN
    return known
