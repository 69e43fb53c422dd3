"""Streaming sinks and the three-query job."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.ml import scored
from lectern.operators.recsys import top_k
from lectern.sources.upserts import upsert
from lectern.streaming.events import as_click_rows, assessments, rejects, sessions


def append(df: DataFrame, path: str, checkpoint: str, once: bool = False, seconds: int = 10) -> StreamingQuery:
    """Append to a Parquet table, every few seconds or once over what is there."""
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def _run(batch: DataFrame) -> str:
    """The id of the query that a batch belongs to: it stands in the checkpoint, so a restart has it and a new query another."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _keyed(path: str, batch: DataFrame, batch_id: int) -> str:
    return f"{path}/run={_run(batch)}/batch_id={batch_id}"


def _started(writer, once: bool, seconds: int) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def upserts(rows: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, once: bool = False, seconds: int = 10, buckets: int = 64) -> StreamingQuery:
    """Rows of a stream into a table of current rows by key (W10, K07); a repeated batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, keys, [order], buckets)

    return _started(rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint), once, seconds)


def dead_letters(rows: DataFrame, path: str, checkpoint: str, once: bool = False, seconds: int = 10) -> StreamingQuery:
    """Rejected records in a table keyed by query and batch, so a repeated batch overwrites itself alone (K04, K14, DQ08)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_keyed(path, batch, batch_id))

    writer = rejects(rows).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def start_job(routed_rows: DataFrame, root: str, once: bool = False) -> list[StreamingQuery]:
    """Sessions, assessments and dead letters, each with its own checkpoint."""
    clicks = sessions(routed_rows.where(F.col("route") == "clicks"))
    return [
        append(as_click_rows(clicks), f"{root}/clicks", f"{root}/_checkpoints/clicks", once),
        append(assessments(routed_rows), f"{root}/assessments", f"{root}/_checkpoints/assessments", once),
        dead_letters(routed_rows, f"{root}/rejected", f"{root}/_checkpoints/rejected", once),
    ]


def refresh_recommendations(events: DataFrame, users: DataFrame, items: DataFrame, path: str, checkpoint: str, k: int = 5, once: bool = False) -> StreamingQuery:
    """For learners active in each micro-batch, the top k items of frozen vectors, in a serving table by learner and rank.

    Rows of learners that a batch does not name stay as they are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        active = batch.select(F.col("effective_id").alias("node")).distinct()
        found = top_k(users.join(active, "node", "left_semi"), items, k)
        upsert(found.withColumn("inferred_at", F.current_timestamp()), path, [found.columns[0], "rank"], ["inferred_at"])

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 minutes")).start()


def rescore(features: DataFrame, model: PipelineModel, keys: list[str], path: str, checkpoint: str, once: bool = False, seconds: int = 10) -> StreamingQuery:
    """Rows of changed features through a fitted model as they come, into a table keyed by query and batch.

    The table has keys, dropout_probability = 1 - P(Success), class probabilities and the feature row's `changed_at`. A
    repeated batch overwrites itself. latest_scores() reads the state of things.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = scored(model, batch, [*keys, "changed_at"])
        out.withColumn("dropout_probability", 1.0 - F.col("prob_Success")).write.mode("overwrite").parquet(_keyed(path, batch, batch_id))

    writer = features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def latest_scores(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """keys and the dropout_probability of their last change, by its time, then by batch."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by("dropout_probability", F.struct("changed_at", "batch_id")).alias("dropout_probability"), F.count("*").alias("changes"))
