"""At-risk features per learner, module and presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import at_risk, target_class
from lectern.operators.cleaning import fill_defaults, open_until, until

KEYS = ["id_student", "code_module", "code_presentation"]
NUMBERS = (
    "num_of_prev_attempts", "studied_credits", "total_clicks", "active_days", "avg_daily_clicks", "max_clicks_day", "engagement_span", "recent_weekly_rate",
    "recency_days", "engagement_momentum", "avg_score", "min_score", "submission_count", "late_submissions", "weighted_avg",
)
LABELS = ("gender", "region", "highest_education", "imd_band", "age_band", "disability", "code_module", "code_presentation")


def vle_features(clicks: DataFrame, cutoff: int = 30, keys: list[str] = KEYS, per_day: bool = False) -> DataFrame:
    """Click features up to the cut-off, in one pass: the recent week is a conditional sum of the same aggregate.

    avg_daily_clicks and max_clicks_day are per row, as the names' users expect; per_day adds variants per day.
    """
    day, clicked = F.col("date"), F.col("sum_click")
    recent = F.sum(F.when(day > cutoff - 7, clicked)) / F.lit(7.0)
    source = until(clicks, "date", cutoff)
    out = source.groupBy(*keys).agg(
        F.sum(clicked).cast("long").alias("total_clicks"), F.count_distinct("date").alias("active_days"), F.avg(clicked).alias("avg_daily_clicks"),
        F.max(clicked).alias("max_clicks_day"), F.min(day).alias("first_activity"), F.max(day).alias("last_activity"), recent.alias("recent_weekly_rate"),
    )
    out = out.withColumns({
        "engagement_span": F.col("last_activity") - F.col("first_activity"),
        "recency_days": F.lit(cutoff) - F.coalesce("last_activity", F.lit(0)),
        "engagement_momentum": F.coalesce("recent_weekly_rate", F.lit(0.0)) - F.coalesce("avg_daily_clicks", F.lit(0.0)),
    })
    if not per_day:
        return out
    daily = source.groupBy(*keys, "date").agg(F.sum(clicked).alias("c")).groupBy(*keys).agg(F.avg("c").alias("avg_clicks_per_day"), F.max("c").cast("long").alias("max_clicks_per_day"))
    return out.join(daily, keys, "left")


#: Score features: name, aggregate, measure of a submission. weighted_avg divides two of them.
SCORES = (
    ("avg_score", F.avg, "score"), ("min_score", F.min, "score"), ("submission_count", F.count, "id_assessment"), ("late_submissions", F.sum, "late"),
    ("_points", F.sum, "points"), ("_weight", F.sum, "weight"),
)


def assessment_features(submissions: DataFrame, definitions: DataFrame, cutoff: int = 30, student: str = "id_student") -> DataFrame:
    """Score features per learner and the definition's module; weighted_avg is NULL without a positive weight."""
    due = open_until(definitions.withColumnRenamed("date", "due").select("id_assessment", "code_module", "code_presentation", "due", "weight"), "due", cutoff)
    # a submission to an assessment that is not defined counts under no module; one that is due later does not
    known = definitions.select("id_assessment").distinct()
    stray = submissions.join(known, "id_assessment", "left_anti")
    rows = submissions.join(due, "id_assessment").unionByName(stray, allowMissingColumns=True)
    weight = F.coalesce("weight", F.lit(0.0))
    measured = rows.select(student, "code_module", "code_presentation", "id_assessment", "score", weight.alias("weight"), (F.col("score") * weight).alias("points"), F.coalesce("is_banked", F.lit(0)).cast("long").alias("late"))
    summed = measured.groupBy(student, "code_module", "code_presentation").agg(*[f(measure).alias(name) for name, f, measure in SCORES])
    return summed.withColumn("weighted_avg", F.try_divide("_points", F.when(F.col("_weight") > 0, F.col("_weight")))).drop("_points", "_weight")


def at_risk_features(info: DataFrame, registration: DataFrame, clicks: DataFrame, submissions: DataFrame, definitions: DataFrame, cutoff: int = 30, due_cutoff: int = 30) -> DataFrame:
    """The feature table: each side is one row a key before it joins, so no join multiplies rows."""
    registered = registration.select(*KEYS, "date_registration", "date_unregistration")
    out = info.join(registered, KEYS, "left").join(vle_features(clicks, cutoff), KEYS, "left").join(assessment_features(submissions, definitions, due_cutoff), KEYS, "left")
    out = out.withColumn("target_class", target_class(F.col("final_result")))
    out = out.withColumn("is_at_risk", at_risk(F.col("target_class")))
    return fill_defaults(out, NUMBERS, LABELS)


def feature_as_of(queries: DataFrame, features: DataFrame, keys: list[str], at: str = "event_time", ttl_days: int = 365, created: str = "created") -> DataFrame:
    """Each query row with the newest feature row of its key that is not after it and not older than ttl_days.

    One union and one window, no range join: time is cut into spans of the time to live, a feature stands in its own span
    and the next, and a query looks in its own, so a key with most of the rows is split by time. Ties on time go to the row
    created last. queries need a unique `query_id`; features need `value`.
    """
    from pyspark.sql import Window as W

    span = F.floor(F.unix_timestamp(at) / (ttl_days * 86400)).cast("long")
    row = F.struct(F.col(at).alias("feature_time"), F.col("value"))
    kind = features.select(row.alias("f")).schema["f"].dataType
    left = features.select(*keys, F.col(at), F.lit(0).alias("is_query"), F.col(created).alias("_made"), F.lit(None).cast("long").alias("query_id"), row.alias("feature"), F.explode(F.array(span, span + 1)).alias("_span"))
    right = queries.select(*keys, F.col(at), F.lit(1).alias("is_query"), F.lit(None).cast(features.schema[created].dataType).alias("_made"), F.col("query_id").cast("long").alias("query_id"), F.lit(None).cast(kind).alias("feature"), span.alias("_span"))
    order = W.partitionBy(*keys, "_span").orderBy(at, "is_query", F.col("_made").asc_nulls_first())
    last = F.last("feature", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    found = left.unionByName(right).withColumn("feature", last).where("is_query = 1")
    fresh = F.col("feature.feature_time") >= F.col(at) - F.expr(f"interval {ttl_days} days")
    return found.select("query_id", *keys, at, F.when(fresh, F.col("feature.feature_time")).alias("feature_time"), F.when(fresh, F.col("feature.value")).alias("value"))
