"""Per-learner online features, sessions, progress and profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lectern.functions.folds import PRIOR, after_submission
from lectern.functions.text import clip
from lectern.operators.ranges import placed, running


def online_clicks(clicks: DataFrame, student: str = "id_student", order: tuple[str, ...] = ("ts", "event_id"), value: str = "clicks") -> DataFrame:
    """Final online click features of each learner.

    Event by event, active_days grows by 0.1 from 1, the recent rate r becomes (6 r + clicks) / 7; from an event's place in
    its learner's history both are sums, so a history is added up in parts and never stands in one row.
    """
    c = F.col("_c")
    rows = placed(clicks.where(F.col(value).isNotNull()).select(student, *order, F.col(value).cast("double").alias("_c")), [student], [*order])
    weight = F.pow(F.lit(6.0 / 7.0), (F.col("n") - 1 - F.col("place")).cast("double")) / 7.0
    found = rows.groupBy(student).agg(F.sum(c).alias("total_clicks"), F.count("*").alias("n"), F.max(c).alias("most"), F.sum(c * weight).alias("recent_weekly_rate"))
    days = 1.0 + (F.col("n") - 1) * 0.1
    average = F.col("total_clicks") / days
    return found.select(
        student, "total_clicks", days.alias("active_days"), average.alias("avg_daily_clicks"), F.greatest(F.lit(0.0), "most").alias("max_clicks_day"),
        F.col("n").cast("double").alias("engagement_span"), "recent_weekly_rate", (F.col("recent_weekly_rate") - average).alias("engagement_momentum"),
    )


def online_scores(submissions: DataFrame, student: str = "id_student", order: tuple[str, ...] = ("ts", "event_id"), score: str = "score") -> DataFrame:
    """Each submission with the running count, mean and minimum (W07, O03), by ranges and offsets, so that a learner with half
    of all submissions is many tasks. Those without a learner have nothing to run over and are left out; a submission without a score counts and changes nothing else."""
    rows = submissions.where(F.col(student).isNotNull())
    value = F.col(score).cast("double")
    rows = rows.withColumns({"_one": F.lit(1).cast("long"), "_some": value.isNotNull().cast("long"), "_sum": F.coalesce(value, F.lit(0.0)), "_least": value})
    found = running(rows, [student], [*order], ["_one", "_some", "_sum"], ["_least"])
    mean = F.try_divide("_sum_upto", "_some_upto")
    return found.select(*submissions.columns, F.col("_one_upto").alias("submission_count"), mean.alias("avg_score"), F.col("_least_least").alias("min_score"), mean.alias("weighted_avg"))


def mastery_updates(submissions: DataFrame, keys: list[str], order: list[str], score: str = "score", prior: float = PRIOR) -> DataFrame:
    """Mastery after all of a learner's submissions to a chapter.

    Mastery near 1 is rounded to 1 and stays there, so a submission needs the number before it: rows come sorted, a task
    holds one number, and a learner's submissions to a chapter follow each other in one task. A submission without a score
    counts and changes nothing.
    """
    rows = submissions.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(score).cast("double").alias("_score"))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("mastery", T.DoubleType()), T.StructField("submissions", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, count = None, prior, 0
        done: list[tuple] = []
        types = None

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), [*types, pa.float64(), pa.int64()], strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for *k, s in zip(*[batch[c].to_pylist() for c in (*keys, "_score")], strict=True):
                if k != key:
                    if key is not None:
                        done.append((*key, known, count))
                    key, known, count = k, prior, 0
                known, count = known if s is None else after_submission(known, s), count + 1
            if len(done) > 10_000:
                yield out()
        if key is not None:
            done.append((*key, known, count))
            yield out()

    places = [f"_o{i}" for i in range(len(order))]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *places).select(*keys, "_score").mapInArrow(fold, schema)


def shifted_risk(base: DataFrame, submissions: DataFrame, student: str = "id_student", score: str = "score", risk: str = "risk") -> DataFrame:
    """Risk less the sum of +0.05 for passes and -0.10 for fails, within 0 and 1."""
    shift = submissions.groupBy(student).agg(F.sum(F.when(F.col(score) >= 50, 0.05).otherwise(-0.10)).alias("shift"))
    moved = base.join(shift, student, "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    return moved.withColumn("risk", clip(F.col(risk) - F.col("shift"), 0.0, 1.0))


def progress(submissions: DataFrame, keys: list[str], order: list[str], score: str = "score", questions: int = 20) -> DataFrame:
    """Latest score, submissions, right answers and time per learner and chapter."""
    last = F.max(F.struct(*order, F.col(score).alias("_score")))
    out = submissions.groupBy(*keys).agg(last.alias("last"), F.count("*").alias("submissions"))
    return out.select(*keys, F.col("last._score").alias("latest_score"), "submissions", F.bround(F.col("last._score") * questions / 100.0).cast("int").alias("correct"), F.lit(questions).alias("total"), F.col(f"last.{order[0]}").alias("updated_at"))


def merged_progress(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """More submissions win, then the later time, then the remote set."""
    both = local.withColumn("_source", F.lit(0)).unionByName(remote.withColumn("_source", F.lit(1)))
    order = W.partitionBy(*keys).orderBy(F.desc("submissions"), F.desc("updated_at"), F.desc("_source"))
    return both.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_source")


def event_counts(events: DataFrame, kinds: list[str], student: str = "user_id", kind: str = "event_type") -> DataFrame:
    """Events of each kind and in all per learner."""
    return events.groupBy(student).agg(F.count("*").alias("events"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def weekly_minutes(clicks: Column, submissions: Column) -> Column:
    """round(clicks * 2.5 + submissions * 12)."""
    return F.bround(clicks * 2.5 + submissions * 12.0).cast("long")


def activity_levels(events: DataFrame, last_day, days: int = 182, student: str = "user_id", time: str = "ts") -> DataFrame:
    """A level of 1 to 5 for each learner and UTC day of the calendar, by the learner's busiest day."""
    daily = events.withColumn("day", F.to_date(time)).groupBy(student, "day").agg(F.count("*").alias("events"))
    return levels_of(daily, last_day, days, student)


def levels_of(daily: DataFrame, last_day, days: int = 182, student: str = "user_id") -> DataFrame:
    """activity_levels() from counts by day, such as a stream keeps them."""
    end = F.to_date(F.lit(last_day))
    daily = daily.where((F.col("day") <= end) & (F.col("day") > F.date_sub(end, days))).select(student, "day", "events")
    most = daily.groupBy(student).agg(F.max("events").alias("most"))
    calendar = most.withColumn("day", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    filled = calendar.join(daily, [student, "day"], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    level = F.least(F.greatest(F.bround(F.col("events") * 4.0 / F.col("most")).cast("int") + 1, F.lit(1)), F.lit(5))
    return filled.select(student, "day", "events", level.alias("level"))


def newest(events: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    """The newest n events per key, numbered."""
    return events.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def session_minutes(kind: Column, seconds: Column, clicks: Column) -> Column:
    """ceil(seconds / 60), at least 1; without a duration 15 for assessments, else clicks * 3 within 1 and 20."""
    return F.when(seconds > 0, F.greatest(F.lit(1), F.ceil(seconds / 60.0))).when(kind == "assessment", F.lit(15)).otherwise(F.least(F.lit(20), F.greatest(F.lit(1), clicks * 3))).cast("long")


def recent_sessions(events: DataFrame, n: int = 4, student: str = "user_id") -> DataFrame:
    """The newest n sessions of a learner, one per kind and label; events need kind, label, ts, event_id."""
    newest_of = W.partitionBy(student, "kind", "label").orderBy(F.desc("ts"), F.desc("event_id"))
    unique = events.withColumn("_rn", F.row_number().over(newest_of)).where("_rn = 1").drop("_rn")
    return newest(unique, n, [student], [F.desc("ts"), F.desc("event_id")])


def titles(events: DataFrame, item: str, title: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last non-empty title of each item."""
    named = events.where(F.length(F.trim(title)) > 0)
    return named.groupBy(item).agg(F.max_by(title, F.struct(time, tie)).alias("title"))


def activity_labels(events: DataFrame, overrides: DataFrame, metadata: DataFrame, item: str) -> DataFrame:
    """The event's own title, else the override, else the metadata's, else the id."""
    joined = events.join(overrides.withColumnRenamed("title", "_override"), item, "left").join(metadata.select(item, F.col("title").alias("_known")), item, "left")
    own = F.when(F.length(F.trim("title")) > 0, F.col("title"))
    return joined.withColumn("label", F.coalesce(own, "_override", "_known", F.col(item).cast("string"))).drop("_override", "_known")


def seeded_mastery(students: DataFrame, mastery: DataFrame, chapters: tuple[str, ...] = ("C1", "C2", "C3", "C4", "C5", "C6"), default: float = 0.40, student: str = "id_student") -> DataFrame:
    """(student, chapter, mastery): a default, overwritten where a skill's name holds the chapter."""
    grid = students.select(student).distinct().withColumn("chapter", F.explode(F.array(*[F.lit(c) for c in chapters])))
    named = mastery.select(student, "mastery", "skill_name", F.explode(F.array(*[F.when(F.col("skill_name").contains(c), F.lit(c)) for c in chapters])).alias("chapter")).where("chapter is not null")
    known = named.groupBy(student, "chapter").agg(F.max_by("mastery", "skill_name").alias("known"))
    return grid.join(known, [student, "chapter"], "left").select(student, "chapter", F.coalesce("known", F.lit(default)).alias("mastery"))


def shifted_user(user_vectors: DataFrame, events: DataFrame, item_vectors: DataFrame, rate: float = 0.3, unit: bool = False) -> DataFrame:
    """User vectors moved by each item they interacted with, in order, and of unit length after each if asked.

    Both vector tables are (node, vector); users without an interaction are left out. Rows come sorted by user and time,
    the user's own vector first, and a task holds one vector: a step on unit length needs the one before it, so a user's
    steps follow each other in one task, in memory for one batch of rows.
    """
    own = user_vectors.select(F.col("node").alias("user"), F.lit(None).cast(events.schema["ts"].dataType).alias("ts"), F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), "vector", F.lit(0).alias("kind"))
    moves = events.join(item_vectors.select(F.col("node").alias("item"), "vector"), "item").select("user", "ts", "event_id", "vector", F.lit(1).alias("kind"))
    schema = T.StructType([own.schema["user"], T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, vector, steps = None, None, 0
        done: list[tuple] = []

        def close() -> None:
            if vector is not None and steps:
                done.append((user, vector.tolist()))

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"user": [u for u, _ in done], "vector": [v for _, v in done]}, schema=types)
            done.clear()
            return batch

        types = None
        for batch in batches:
            types = pa.schema([pa.field("user", batch.schema.field("user").type), pa.field("vector", pa.list_(pa.float64()))])
            for u, kind, v in zip(batch["user"].to_pylist(), batch["kind"].to_pylist(), batch["vector"], strict=True):
                if u != user:
                    close()
                    user, vector, steps = u, None, 0
                move = np.asarray(v.values, np.float64)
                if kind == 0:
                    vector = move
                elif vector is not None:
                    vector = vector + rate * move
                    vector = vector / (np.sqrt((vector * vector).sum()) + 1e-9) if unit else vector
                    steps += 1
            if len(done) > 1000:
                yield out()
        close()
        if done:
            yield out()

    rows = own.unionByName(moves).where("user is not null and vector is not null")
    return rows.repartition("user").sortWithinPartitions("user", "kind", "ts", "event_id").select("user", "kind", "vector").mapInArrow(fold, schema)


def profile(risk: DataFrame, mastery: DataFrame, progress_: DataFrame, ranked: DataFrame, student: str = "id_student") -> DataFrame:
    """One nested row a learner: risk, mastery by chapter, progress, recommendations."""
    m = mastery.groupBy(student).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", "mastery")))).alias("mastery"))
    p = progress_.groupBy(student).agg(F.array_sort(F.collect_list(F.struct("chapter", "latest_score", "submissions"))).alias("progress"))
    r = ranked.groupBy(student).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("recommended"))
    return risk.join(m, student, "left").join(p, student, "left").join(r, student, "left")
