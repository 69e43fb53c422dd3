"""Writers, compaction and table maintenance."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition: str | None = None, files: int | None = None) -> None:
    """Overwrite; partitioned only by a column that exists."""
    out = df.repartition(files) if files else df
    writer = out.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(path)


def write_table(df: DataFrame, name: str, partition: str | None = None) -> None:
    """Create or replace a catalog table."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(partition) if partition and partition in df.columns else writer).saveAsTable(name)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int = 64) -> None:
    """Create or replace a catalog table in buckets of its keys, one sorted file each: tables of the same keys and buckets are
    joined and aggregated by them without an exchange (J01-J03)."""
    df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def compact(df: DataFrame, path: str, files: int) -> int:
    """Many small inputs as so many files; returns the rows written, observed during the write."""
    from pyspark.sql import Observation

    seen = Observation()
    df.repartition(files).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def rewrite(spark: SparkSession, name: str, files: int, by: list[str] | None = None) -> None:
    """Compact a catalog table into a new one and swap the names.

    The old table is renamed away, not dropped, until the new one has its name: at every moment one of the two is whole. A
    crash between the two names leaves the old table renamed away; the next call gives it its name back before anything is
    dropped, so a retry finds what the first call found.
    """
    new, old = f"{name}__new", f"{name}__old"
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(old):
        spark.sql(f"alter table {old} rename to {name}")
    for left in (new, old):
        spark.sql(f"drop table if exists {left}")
    spark.table(name).repartition(files, *(by or [])).write.format("parquet").saveAsTable(new)
    spark.sql(f"alter table {name} rename to {old}")
    spark.sql(f"alter table {new} rename to {name}")
    spark.sql(f"drop table {old}")


def reset(spark: SparkSession, name: str) -> None:
    spark.sql(f"truncate table {name}")


def count_tables(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, rows) of each table folder below root, in one scan."""
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", False).parquet(root)
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_extract(F.col("_metadata.file_path"), f"/{tail}/([^/]+)/", 1)
    return rows.groupBy(below.alias("table_name")).agg(F.count("*").alias("rows"))


def write_counts(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)  # a row a table (K05)


def save_model(model: PipelineModel, metrics: DataFrame, path: str) -> None:
    """The fitted pipeline and its metrics, side by side."""
    model.write().overwrite().save(f"{path}/model")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Saved metrics, or an empty table where none are saved."""
    from pyspark.errors import AnalysisException

    schema = "metric_type string, key_name string, value double"
    try:
        return spark.read.schema(schema).json(f"{path}/metrics")
    except AnalysisException:
        return spark.createDataFrame([], schema)
