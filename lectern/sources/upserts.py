"""Tables of current rows by key, merged batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import materialise

#: Column of a table's folders; a key's bucket follows from its hash.
BUCKET = "_bucket"


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the largest by order, nulls smallest, then by all values."""
    ties = [F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c not in keys])]
    first = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order], *ties)
    return rows.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, without its bucket."""
    return spark.read.parquet(path).drop(BUCKET)


def upsert(batch: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 64) -> int:
    """Merge a batch into the table at path: for each key the row that is largest by order stays. Returns the buckets written.

    The table's folders are buckets of keys. Only those that the batch touches are read and replaced, by a dynamic partition
    overwrite; the files of all others stay as they are. Which row stays depends on the rows alone, so a batch that comes
    again, after a crash or from an older run, changes nothing that stands, and is not written at all where every row it has
    stands already or is older.
    """
    spark = batch.sparkSession
    keyed = newest(batch, keys, order).withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    keyed = materialise(keyed)
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        table = spark.createDataFrame([], keyed.schema)
    touched = [r[0] for r in keyed.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
    old = table.where(F.col(BUCKET).isin(touched)).select(*keyed.columns)
    merged = materialise(_merged(old, keyed, keys, order))
    fresh = [r[0] for r in merged.where("_new = 1").select(BUCKET).distinct().collect()]
    if fresh:
        out = merged.where(F.col(BUCKET).isin(fresh)).drop("_new").repartition(BUCKET)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return len(fresh)


def _merged(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that stay, `_new` being 1 for those that the table does not have; of equals the old one stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order], "_new")
    return both.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
