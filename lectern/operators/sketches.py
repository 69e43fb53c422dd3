"""Daily sketches of values and learners, merged for any period (A09, A18, A26, A27); the exact ways are in marts and ranges.

A day's row of the mart has a quantile sketch of some kilobytes and a distinct-count sketch, whatever the day's rows; a
period is a merge of its days, so a dashboard's question reads days and not events. Ranks are off by about `1.7 / k` of the
rows at most (1 % at the default size) and distinct counts by about 1.6 % (two standard errors at 2^14 registers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch, and the logarithm of a distinct-count sketch's registers.
QUANTILE_SIZE, REGISTERS = 200, 14


def daily(events: DataFrame, keys: list[str], time: str, value: str, distinct: str) -> DataFrame:
    """keys, day, rows, values, low, high, quantile_sketch and distinct_sketch: the mart, one row a key and day.

    values counts those that are not null; null times stand under a null day.
    """
    number = F.col(value).cast("double")
    sound = F.when(~F.isnan(number), number)
    return events.groupBy(*keys, F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(sound).alias("values"), F.min(sound).alias("low"), F.max(sound).alias("high"),
        F.kll_sketch_agg_double(sound, F.lit(QUANTILE_SIZE)).alias("quantile_sketch"), F.hll_sketch_agg(F.col(distinct).cast("string"), REGISTERS).alias("distinct_sketch"),
    )


def merged(mart: DataFrame, keys: list[str], first=None, last=None) -> DataFrame:
    """keys, rows, values, low, high and both sketches of the days from first to last, both included."""
    days = mart
    if first is not None:
        days = days.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.where(F.col("day") <= F.lit(last).cast("date"))
    return days.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("values").alias("values"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantile_sketch", F.lit(QUANTILE_SIZE)).alias("quantile_sketch"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
    )


def quantile(share: float) -> Column:
    """The value at a share of a merged row's values; null where it has none."""
    return F.when(F.col("values") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(share))))


def distinct() -> Column:
    """How many distinct ones a merged row has seen, about."""
    return F.hll_sketch_estimate("distinct_sketch")


def box(mart: DataFrame, keys: list[str], first=None, last=None) -> DataFrame:
    """keys, low, q1, median, q3 and high of a period: A18 without its outliers, which need the rows themselves."""
    return merged(mart, keys, first, last).select(*keys, "low", quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"), "high")
