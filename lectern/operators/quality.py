"""Data-quality expectations and reconciliation (DQ01-DQ07, J15, A24)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def not_null(column: str) -> tuple[str, str, Column]:
    return "not_null", column, F.col(column).isNull()


def between(column: str, low: float | None = None, high: float | None = None) -> tuple[str, str, Column]:
    """Text that isn't a number fails; NULL passes."""
    value = F.col(column).try_cast("double")
    bad = F.col(column).isNotNull() & value.isNull()
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return "between", column, F.coalesce(bad, F.lit(False))


def report(df: DataFrame, table: str, expectations: list[tuple[str, str, Column]]) -> DataFrame:
    """(table, expectation, column, failed, ok): one pass over the whole table for all expectations (DQ01-DQ03)."""
    counts = df.agg(*[F.count_if(bad).alias(f"e{i}") for i, (_, _, bad) in enumerate(expectations)])
    rows = F.array(*[F.struct(F.lit(kind).alias("expectation"), F.lit(column).alias("column_name"), F.col(f"e{i}").alias("failed")) for i, (kind, column, _) in enumerate(expectations)])
    return counts.select(F.lit(table).alias("table_name"), F.inline(rows)).withColumn("ok", F.col("failed") == 0)


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """(table_name, source_rows, target_rows, matches) over (table_name, rows) on either side (DQ04, J15, U04)."""
    joined = source.withColumnRenamed("rows", "s").join(target.withColumnRenamed("rows", "t"), "table_name", "full")
    s, t = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    return joined.select("table_name", s.alias("source_rows"), t.alias("target_rows"), (s == t).alias("matches"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows), counted in one job."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()])


def conformance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows in which none of columns is NULL (DQ05)."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.agg(F.avg(whole.cast("int")).alias("conformance"))


def freshness(df: DataFrame, column: str) -> DataFrame:
    """Epoch seconds of the newest row, to the nearest second, halves to the even one (DQ06). A time without a zone is UTC, whatever the session's."""
    newest = F.max(column)
    if isinstance(df.select(column).schema[0].dataType, T.TimestampNTZType):
        newest = F.concat(newest.cast("string"), F.lit("Z"))
    return df.agg(F.rint(F.unix_micros(newest.cast("timestamp")) / F.lit(1e6)).cast("long").alias("fresh_at"))


class ColumnCountError(ValueError):
    """Files of one table disagree on their columns (DQ07)."""
