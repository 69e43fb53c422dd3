"""Mastery, scores and progress of every chapter as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lectern.functions.folds import PRIOR, after_submission
from lectern.session import rocksdb_states
from lectern.streaming.sinks import upserts

OUTPUT = (
    "learner string, chapter string, kind string, mastery double, submissions long, latest_score double, correct int, total int, updated_at timestamp, "
    "submission_count long, avg_score double, min_score double, risk_shift double"
)
#: What an initial state may hold: a row for each learner and chapter, as chapter_table() gives them.
INITIAL = ("mastery", "submissions", "latest_score", "updated_at")


def _time(ms: int | None) -> datetime | None:
    return None if ms is None else datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


class ChapterMastery(StatefulProcessor):
    """State of one learner: a map of chapters, running scores, and submissions that the watermark has not passed yet.

    Submissions wait in a list until the watermark passes them, and are then applied in the order of their time, so results
    do not depend on the order of arrival. A timer stands at the earliest that waits; another one, `idle` milliseconds behind
    the newest submission, ends the learner: a row of kind `expired` says so, and all state of the learner goes.
    """

    def __init__(self, idle: int, questions: int = 20) -> None:
        self.idle, self.questions = idle, questions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, tie long, chapter string, score double")
        self.chapters = handle.getMapState("chapters", "chapter string", "mastery double, submissions long, latest double, ms long")
        self.scores = handle.getValueState("scores", "n long, total double, least double, shift double")
        self.newest = handle.getValueState("newest", "ms long")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: TimerValues) -> None:
        """A chapter as the mastery table has it; running scores begin with the stream."""
        r = initialState
        at = None if r["updated_at"] is None else int(r["updated_at"].replace(tzinfo=UTC).timestamp() * 1000)
        self.chapters.updateValue((r["chapter"],), (PRIOR if r["mastery"] is None else r["mastery"], r["submissions"] or 0, r["latest_score"], at))
        if at is not None and (not self.newest.exists() or self.newest.get()[0] < at):
            self.newest.update((at,))
            self.handle.registerTimer(at + self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r["ms"], r["tie"], r["chapter"], r["score"]) for r in rows]
        if not new:
            return
        self.waiting.appendList(new)
        self.handle.registerTimer(min(x[0] for x in new))
        last = max(x[0] for x in new)
        if not self.newest.exists() or self.newest.get()[0] < last:
            self.newest.update((last,))
            self.handle.registerTimer(last + self.idle)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((x for x in held if x[0] <= now), key=lambda x: (x[0], x[1], x[2] or ""))
        if due:
            rest = [x for x in held if x[0] > now]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(x[0] for x in rest))
            else:
                self.waiting.clear()
            yield from self._applied(key[0], due)
        elif not held and self.newest.exists() and self.newest.get()[0] + self.idle <= now:
            for state in (self.waiting, self.chapters, self.scores, self.newest):
                state.clear()
            yield Row(learner=key[0], chapter=None, kind="expired", mastery=None, submissions=None, latest_score=None, correct=None, total=None, updated_at=_time(now), submission_count=None, avg_score=None, min_score=None, risk_shift=None)

    def _applied(self, learner: str, due: list[tuple]) -> Iterator[Row]:
        """Submissions in order; a row for each chapter they touch. One without a score counts and changes nothing else."""
        n, total, least, shift = self.scores.get() if self.scores.exists() else (0, 0.0, 100.0, 0.0)
        touched: dict[str, tuple] = {}
        for ms, _, chapter, score in due:
            if chapter not in touched:
                touched[chapter] = self.chapters.getValue((chapter,)) if self.chapters.containsKey((chapter,)) else (PRIOR, 0, None, None)
            known, count, latest, at = touched[chapter]
            if score is None or score != score:
                touched[chapter] = (known, count + 1, latest, ms)
                continue
            touched[chapter] = (after_submission(known, score, self.questions), count + 1, score, ms)
            n, total, least, shift = n + 1, total + score, min(least, score), shift + (0.05 if score >= 50 else -0.10)
        self.scores.update((n, total, least, shift))
        for chapter, (known, count, latest, ms) in touched.items():
            self.chapters.updateValue((chapter,), (known, count, latest, ms))
            correct = None if latest is None else round(latest * self.questions / 100.0)
            yield Row(learner=learner, chapter=chapter, kind="update", mastery=float(known), submissions=count, latest_score=latest, correct=correct, total=self.questions, updated_at=_time(ms), submission_count=n, avg_score=total / n if n else None, min_score=least if n else None, risk_shift=shift)

    def close(self) -> None:
        pass


def chapter_states(submissions: DataFrame, delay: str = "10 minutes", idle_days: float = 400.0, initial: DataFrame | None = None, learner: str = "id_student", chapter: str = "chapter", score: str = "score", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """A row for each learner and chapter whose submissions the watermark has passed, and one for each learner that expires.

    Submissions later than the watermark are dropped by Spark and counted in the query's progress. Those without learner,
    chapter or time take no part. Run in update mode, started inside rocksdb_states(), as keep() does: Spark's usual state
    store has no room for several states of a key. initial(learner, chapter, mastery, submissions, latest_score, updated_at),
    such as a batch result, is where the first run begins.
    """
    known = submissions.where(F.col(learner).isNotNull() & F.col(chapter).isNotNull() & F.col(time).isNotNull())
    rows = known.select(
        F.col(learner).cast("string").alias("learner"), F.col(chapter).cast("string").alias("chapter"), F.col(score).cast("double").alias("score"),
        F.col(time).cast("timestamp").alias("at"), F.unix_millis(F.col(time).cast("timestamp")).alias("ms"), F.col(tie).cast("long").alias("tie"),
    )
    start = None if initial is None else initial.select(F.col("learner").cast("string").alias("learner"), F.col("chapter").cast("string").alias("chapter"), *INITIAL).groupBy("learner")
    processor = ChapterMastery(max(1, int(idle_days * 86_400_000)))
    return rows.withWatermark("at", delay).groupBy("learner").transformWithState(processor, OUTPUT, "Update", "EventTime", initialState=start)


def keep(states: DataFrame, path: str, checkpoint: str, once: bool = False, seconds: int = 10, buckets: int = 64) -> StreamingQuery:
    """Rows of chapter_states() into a table by learner and chapter, in a session of any state store.

    A chapter's number of submissions only grows while its learner stays, so the largest is the latest; rows of learners
    that expired stay as they were.
    """
    with rocksdb_states(states.sparkSession):
        return upserts(states.where("kind = 'update'"), path, ["learner", "chapter"], "submissions", checkpoint, once, seconds, buckets)
