"""Parsing, routing and shaping of the event stream (R01-R08, DQ08, DQ09, S12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a payload.
PAYLOAD = (
    "student_id_hash string, id_student string, id_site string, sum_click int, clicks int, event_type string, assignment_id string, score double, "
    "code_module string, code_presentation string, date int, event_time string, _corrupt_record string"
)
ASSESSMENT = "assessment_submission"


def kafka_options(servers: str, topic: str, **more: str) -> dict[str, str]:
    """Options of a broker source: from the latest offsets on, going on where data were lost, unless told otherwise."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "latest", "failOnDataLoss": "false", **more}


def source(spark: SparkSession, kind: str, options: dict[str, str]) -> DataFrame:
    """A stream of (value, timestamp). kind is kafka, or any file format holding those two columns."""
    if kind == "kafka":
        return spark.readStream.format("kafka").options(**options).load().select("value", "timestamp")
    return spark.readStream.format(kind).schema("value string, timestamp timestamp").load(**options)


def parsed(raw: DataFrame) -> DataFrame:
    """The payload's fields, json_payload as it came, and kafka_time (R01); bad JSON sets _corrupt_record. effective_id is
    the hash, else the plain id (R02), event_ts the payload's time, else the broker's (R04)."""
    text = F.col("value").cast("string")
    data = F.from_json(text, PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.select(text.alias("json_payload"), F.col("timestamp").alias("kafka_time"), data.alias("data")).select("data.*", "json_payload", "kafka_time")
    return rows.withColumns({"effective_id": F.coalesce("student_id_hash", "id_student"), "event_ts": F.coalesce(F.try_to_timestamp("event_time"), F.col("kafka_time"))})


def route(strict: bool = False) -> Column:
    """rejected, assessment or clicks: every row gets exactly one.

    A record is rejected if its JSON is corrupt, its site is no plain value, or a click has no count; with strict, the
    count must be `clicks` itself. A record that names no type is a click.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    corrupt = F.col("_corrupt_record").isNotNull() | F.col("json_payload").isNull() | yes(F.col("id_site").rlike(r"^\s*[\[{]"))
    assessment = yes(F.col("event_type") == ASSESSMENT)
    counted = F.col("clicks").isNotNull() if strict else F.coalesce("clicks", "sum_click").isNotNull()
    return F.when(corrupt, "rejected").when(assessment, "assessment").when(counted, "clicks").otherwise("rejected")


def routed(raw: DataFrame, strict: bool = False) -> DataFrame:
    return parsed(raw).withColumn("route", route(strict))


def sessions(clicks: DataFrame, gap: str = "30 minutes", watermark: str | None = "10 minutes") -> DataFrame:
    """Sessions per learner (R05, R06): start, end, clicks, and the first site, module, presentation and day by time.

    The output has the bounds, so a session has a key. Events exactly one gap apart are one session.
    """
    timed = clicks.where(F.col("effective_id").isNotNull() & F.col("event_ts").isNotNull())
    timed = timed.withWatermark("event_ts", watermark) if watermark and clicks.isStreaming else timed
    first = lambda c: F.min_by(c, "event_ts").alias(c)
    grouped = timed.groupBy("effective_id", F.session_window("event_ts", gap).alias("w")).agg(
        F.sum(F.coalesce("clicks", "sum_click", F.lit(1))).cast("long").alias("sum_click"), F.count("*").alias("events"), first("id_site"), first("code_module"), first("code_presentation"), first("date"),
    )
    return grouped.select("effective_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "sum_click", "events", "id_site", "code_module", "code_presentation", "date")


def as_click_rows(found: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Sessions in the shape of raw click rows, all strings, with audit columns."""
    defaults = defaults or {}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(defaults.get(c)).cast("string")).alias(c)
    return found.select(
        text("code_module"), text("code_presentation"), F.col("effective_id").alias("id_student"), text("id_site"), text("date"), text("sum_click"),
        "session_start", "session_end", F.current_timestamp().alias("_ingest_at"), F.current_date().alias("_ingest_date"),
        F.lit("stream").alias("_source_file"), F.lit("stream").alias("_source_dataset"),
    )


def assessments(rows: DataFrame, day: int | None = None, module: str | None = None) -> DataFrame:
    """Assessment rows of the stream, typed (R08). Defaults for a missing day and module are off unless given."""
    return rows.where(F.col("route") == "assessment").select(
        F.col("assignment_id").try_cast("int").alias("id_assessment"), F.col("effective_id").alias("id_student"),
        F.coalesce("date", F.lit(day).cast("int")).alias("date_submitted"), F.lit(0).alias("is_banked"), "score",
        F.coalesce("code_module", F.lit(module).cast("string")).alias("code_module"), "event_ts",
    )


def rejects(rows: DataFrame) -> DataFrame:
    """Rejected records with the payload as it came and why (DQ08, DQ09)."""
    reason = F.when(F.col("json_payload").isNull(), "empty").when(F.col("_corrupt_record").isNotNull(), F.when(F.col("json_payload").rlike(r"^\s*\{.*\}\s*$"), "wrong_type").otherwise("malformed"))
    reason = F.coalesce(reason, F.when(F.col("id_site").rlike(r"^\s*[\[{]"), "structure")).cast("string")
    return rows.where(F.col("route") == "rejected").select("json_payload", "kafka_time", F.coalesce(reason, F.lit("missing_field")).alias("reason"))
