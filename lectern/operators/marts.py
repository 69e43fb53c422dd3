"""Cohort and dashboard aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators.ranges import quantiles


def cohort_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric_name, category, count) for each column, in one pass of grouping sets (A05). A NULL value is a category."""
    flags = [F.grouping(c) for c in columns]
    grouped = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("count"), *[g.alias(f"_g{i}") for i, g in enumerate(flags)])
    name = reduce(lambda out, x: F.when(F.col(f"_g{x[0]}") == 0, F.lit(x[1])).otherwise(out), enumerate(columns), F.lit(None).cast("string"))
    category = reduce(lambda out, x: F.when(F.col(f"_g{x[0]}") == 0, F.col(x[1]).cast("string")).otherwise(out), enumerate(columns), F.lit(None).cast("string"))
    return grouped.select(name.alias("metric_name"), category.alias("category"), "count")


def engagement(clicks: DataFrame, period: Column, student: str = "id_student", count: str = "sum_click") -> DataFrame:
    """Mean over learners of their clicks in each period: sums per learner first, then the mean."""
    per = clicks.withColumn("period", period).groupBy(student, "period").agg(F.sum(count).alias("clicks"))
    return per.groupBy("period").agg(F.count("*").alias("count"), F.avg("clicks").alias("value"))


def week(day: Column, floor: bool = False) -> Column:
    """Week of a relative day: truncated towards zero, so that -6 to 6 are week 0, or floored."""
    return F.floor(day / 7).cast("int") if floor else (day / 7).cast("int")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name, columns that a frame lacks being NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mastery_latest(df: DataFrame, order: str | None = "order_id", user: str = "user_id", skill: str = "skill_name", value: str = "p_known_after") -> DataFrame:
    """The last mastery of each learner and skill, or the mean where there is no order."""
    agg = F.max_by(value, order) if order else F.avg(value)
    return df.groupBy(user, skill).agg(agg.alias("mastery"))


def mastery_pivot(df: DataFrame, rows: str, columns: str, values: list[str], value: str = "mastery") -> DataFrame:
    """Mean of value by row and column, all listed columns present, 0 where absent."""
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(value)).fillna(0.0, values)


def mean_percent(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of value as a percentage, ascending."""
    return df.groupBy(by).agg((F.avg(value) * 100).alias("mean_percent"), F.count("*").alias("count")).orderBy("mean_percent", by)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for all pairs of columns, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin 1..bins of equal widths over [low, high], the upper bound in the last."""
    at = F.floor((value - low) / ((high - low) / bins)).cast("int") + 1
    return F.when(value == high, F.lit(bins)).when((value >= low) & (value < high), F.least(at, F.lit(bins)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    return df.select(bin_of(F.col(value), low, high, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("count"))


def density(df: DataFrame, x: tuple[str, float, float, int], y: tuple[str, float, float, int]) -> DataFrame:
    """Counts on a grid of two columns."""
    return df.select(bin_of(F.col(x[0]), *x[1:]).alias("x_bin"), bin_of(F.col(y[0]), *y[1:]).alias("y_bin")).dropna().groupBy("x_bin", "y_bin").agg(F.count("*").alias("count"))


def box_statistics(df: DataFrame, by: str, value: str, whisker: float = 1.5) -> DataFrame:
    """Extremes, exact quartiles and the number of values beyond the fences, per group (A18). Groups without a value have none."""
    stats = df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high")).join(quantiles(df, [by], value, [0.25, 0.5, 0.75]), by)
    stats = stats.select(by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")
    spread = (F.col("q3") - F.col("q1")) * whisker
    beyond = (F.col(value) < F.col("q1") - spread) | (F.col(value) > F.col("q3") + spread)
    outliers = df.join(stats, by).groupBy(by).agg(F.count_if(beyond).alias("outliers"))
    return stats.join(outliers, by)


def value_counts(df: DataFrame, column: str, mapping: dict[str, str], other: str = "Other") -> DataFrame:
    """Counts of mapped categories."""
    mapped = F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(column)], F.lit(other))
    return df.groupBy(mapped.alias("category")).agg(F.count("*").alias("count"))


def fold_small(counts: DataFrame, share: float = 0.02, others: str = "Others") -> DataFrame:
    """Categories below a share of the total as one (A20, J13). counts has a row a category."""
    total = counts.agg(F.sum("count").alias("_total"))
    label = F.when(F.col("count") < share * F.col("_total"), others).otherwise(F.col("category"))
    return counts.crossJoin(F.broadcast(total)).groupBy(label.alias("category")).agg(F.sum("count").alias("count"))  # total is one row


def kpis(risk: DataFrame, mastery: DataFrame) -> DataFrame:
    """students, mean risk and mean mastery as percentages, 0 where there is nothing."""
    left = risk.agg(F.count_distinct("id_student").alias("students"), F.coalesce(F.avg("risk") * 100, F.lit(0.0)).alias("mean_risk"))
    return left.crossJoin(F.broadcast(mastery.agg(F.coalesce(F.avg("mastery") * 100, F.lit(0.0)).alias("mean_mastery"))))  # one row each


def percentiles(df: DataFrame, value: str, ok: str) -> DataFrame:
    """Interpolated p50, p95, p99, the nearest-rank p99, and the success rate."""
    found = quantiles(df, [], value, [0.5, 0.95, 0.99], (0.99,))
    rest = df.agg(F.avg(F.col(ok).cast("int")).alias("success_rate"), F.count("*").alias("requests"))
    one = found.crossJoin(F.broadcast(rest))  # one row each
    return one.select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), F.col("nearest")[0].alias("p99_nearest"), "success_rate", "requests")


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of an order, as a bounded partial sort per task."""
    return df.orderBy(*order).limit(n)


def extremes(df: DataFrame, value: str, key: str, n: int = 100) -> DataFrame:
    """The n largest and the n smallest, each row once, with its side and place."""
    top = df.orderBy(F.desc(value), key).limit(n)
    low = df.orderBy(F.asc(value), key).limit(n)
    ranked = lambda d, side, order: d.withColumns({"side": F.lit(side), "place": F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))})
    both = ranked(top, 0, [F.desc(value), key]).unionByName(ranked(low, 1, [F.asc(value), key]))
    return both.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy("side"))).where("_rn = 1").drop("_rn")


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones each time."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows holding text in any letter case, an exact match first."""
    low = F.lower(F.col(column).cast("string"))
    return df.where(low.contains(text.lower())).withColumn("exact", low == text.lower()).orderBy(F.desc("exact"), column)


def module_scope(df: DataFrame, module: str, column: str | None = "code_module", skill: str | None = None) -> DataFrame:
    """Rows of a module, by equality or by the prefix of their skill name."""
    return df.where(F.col(skill).startswith(module + "_")) if skill else df.where(F.col(column) == module)


def reidentified(predictions: DataFrame, students: DataFrame, student: str = "id_student") -> DataFrame:
    """Predictions keyed by hash with the original id and education, one row each (J06): a student's smallest education, so
    nothing fans out."""
    known = students.where(F.col(student).isNotNull()).groupBy(F.col(student)).agg(F.min("highest_education").alias("highest_education"))
    return predictions.join(known.withColumn("student_id_hash", F.sha2(F.col(student).cast("string"), 256)), "student_id_hash", "left")


def merged(left: DataFrame, right: DataFrame, on: list[str], suffix: str = "_feat") -> DataFrame:
    """Inner join; columns of the right that the left has too get a suffix."""
    renamed = right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c not in on})
    return left.join(renamed, on)


def with_metadata(ranked: DataFrame, metadata: DataFrame, key: str, default: str = "resource") -> DataFrame:
    """Ranked items with their metadata, a default type where there is none."""
    return ranked.join(metadata, key, "left").withColumn("type", F.coalesce("type", F.lit(default)))


def peers(df: DataFrame, selected, key: str = "id_student") -> DataFrame:
    """Everyone but the selected one."""
    return df.where(F.col(key) != selected)
