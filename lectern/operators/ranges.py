"""Positions, running sums and quantiles by range partitions and offsets, and histories in pieces.

A range partition splits a hot key by its order, so no task sorts or holds one key's rows: each range is offset by the sums
of those before it, a row a key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.session import materialise


def running(df: DataFrame, keys: list[str], order: list[Column | str], sums: list[str], least: list[str] | None = None) -> DataFrame:
    """df with <c>_upto, the sum of c over the rows of the key up to this one in order, and <c>_all, over the whole key;
    for each c of least also <c>_least, the smallest up to this row.

    Rows that are equal in order stand in any order; have none, or sum them up before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    least = least or []
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"{c}_t") for c in sums], *[F.min(c).alias(f"{c}_m") for c in least])  # a row a key and range
    before, whole = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    smallest = [F.min(f"{c}_m").over(before).alias(f"{c}_om") for c in least]
    offsets = totals.select(*keys, "_range", *smallest, *[F.coalesce(F.sum(f"{c}_t").over(before), F.lit(0)).alias(f"{c}_o") for c in sums], *[F.sum(f"{c}_t").over(whole).alias(f"{c}_all") for c in sums])
    up = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = ranged.join(offsets, [*keys, "_range"]) if keys else ranged.join(F.broadcast(offsets), "_range")
    found = {f"{c}_upto": F.col(f"{c}_o") + F.sum(c).over(up) for c in sums} | {f"{c}_least": F.least(f"{c}_om", F.min(c).over(up)) for c in least}
    return joined.withColumns(found).drop("_range", *[f"{c}_o" for c in sums], *[f"{c}_om" for c in least])


def placed(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """df with `place`, from 0 in the order of the key, and `n`, the key's rows."""
    found = running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"])
    return found.withColumns({"place": F.col("_one_upto") - 1, "n": F.col("_one_all")}).drop("_one", "_one_upto", "_one_all")


def pieces(df: DataFrame, keys: list[str], order: list[Column | str], value: str, size: int = 4096) -> DataFrame:
    """keys, piece, values and n: each key's n values in order, in arrays of `size`, so that no row holds a whole history."""
    cut = placed(df.select(*keys, *order, F.col(value).alias("_value")), keys, order).withColumn("piece", F.floor(F.col("place") / size))
    packed = F.array_sort(F.collect_list(F.struct("place", "_value")))
    return cut.groupBy(*keys, "piece").agg(F.transform(packed, lambda x: x["_value"]).alias("values"), F.max("n").alias("n"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], nearest: tuple[float, ...] = ()) -> DataFrame:
    """keys and `q`, the interpolated quantiles of value, exact, and `nearest`, the least values with that share at or below.

    Equal values are one row with a count before they are ordered. Nulls are left out.
    """
    steps = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("rows"))
    at = running(steps, keys, ["_v"], ["rows"])
    upto, all_ = F.col("rows_upto"), F.col("rows_all")

    def pick(place: Column) -> Column:
        return F.max(F.when((upto > place) & (upto - F.col("rows") <= place), F.col("_v").cast("double")))

    exact = [F.lit(s) * (all_ - 1) for s in shares]
    out = at.groupBy(*keys).agg(
        *[pick(F.floor(p)).alias(f"l{i}") for i, p in enumerate(exact)], *[pick(F.ceil(p)).alias(f"h{i}") for i, p in enumerate(exact)], F.max(all_).alias("n"),
        *[F.min(F.when(upto / all_ >= s, F.col("_v"))).alias(f"d{i}") for i, s in enumerate(nearest)],
    )
    part = lambda s: F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))
    mixed = [F.col(f"l{i}") + part(s) * (F.col(f"h{i}") - F.col(f"l{i}")) for i, s in enumerate(shares)]
    return out.select(*keys, F.array(*mixed).alias("q"), F.array(*[F.col(f"d{i}") for i in range(len(nearest))]).alias("nearest"))
