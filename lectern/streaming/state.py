"""Keyed online state of learners on a stream (O01-O05): click features, scores, mastery and risk shift."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.folds import PRIOR, after_submission

OUTPUT = (
    "effective_id string, total_clicks double, active_days double, avg_daily_clicks double, max_clicks_day double, engagement_span double, "
    "recent_weekly_rate double, engagement_momentum double, submission_count long, avg_score double, min_score double, mastery double, risk_shift double"
)
STATE = "clicks array<double>, scores array<double>"
START = ([0.0] * 6, [0.0, 0.0, 100.0, PRIOR, 0.0])


def click(state: list[float], count: float) -> list[float]:
    """total, active days, average, maximum, span, recent rate after one click event."""
    total, days, _, most, span, recent = state
    total, days = total + count, max(1.0, days + 0.1)
    return [total, days, total / days, max(most, count), span + 1.0, (6.0 * recent + count) / 7.0]


def submission(state: list[float], score: float, answers: int = 20) -> list[float]:
    """count, mean, minimum, mastery, risk shift after one submission."""
    n, mean, least, known, shift = state
    return [n + 1, (mean * n + score) / (n + 1), min(least, score), after_submission(known, score, answers), shift + (0.05 if score >= 50 else -0.10)]


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    clicks, scores = (list(x) for x in (state.get if state.exists else START))
    rows = pd.concat(list(frames)).sort_values(["event_ts", "json_payload"])
    for kind, count, score in zip(rows["route"], rows["count"], rows["score"], strict=True):
        if kind == "clicks" and pd.notna(count):
            clicks = click(clicks, float(count))
        elif kind == "assessment" and pd.notna(score):
            scores = submission(scores, float(score))
    state.update((clicks, scores))
    newest = rows["event_ts"].max()
    state.setTimeoutTimestamp(max(0 if pd.isna(newest) else int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle)
    n = int(scores[0])
    yield pd.DataFrame([[key[0], *clicks, clicks[5] - clicks[2], n, scores[1] if n else None, scores[2] if n else None, scores[3], scores[4]]], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def learner_state(routed_rows: DataFrame, idle_days: float = 400.0) -> DataFrame:
    """A row for each learner in each micro-batch that has events of theirs: all online features after it.

    Within a batch events apply in order of time; across batches, in order of arrival. Once the newest event of the stream
    is idle_days ahead, the state of a learner is dropped, and an event as late as that with it; so states are bounded by the
    learners active in that span, some 200 bytes each. Run in update mode.
    """
    from functools import partial

    from pyspark.sql import functions as F

    rows = routed_rows.where("route <> 'rejected' and effective_id is not null").select("effective_id", "route", F.coalesce("clicks", "sum_click").alias("count"), "score", "event_ts", "json_payload")
    rows = rows.withWatermark("event_ts", f"{idle_days * 86_400:.0f} seconds")
    update = partial(_update, idle=max(1, int(idle_days * 86_400_000)))
    return rows.groupBy("effective_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
