"""File inventory and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import table_name

#: dataset, pattern of the path below the root, table (or a prefix of one named after the file), type, partition column
ROUTES = (
    ("oulad", r"(?i)^oulad/([^/]+)\.csv$", "oulad_", "csv", "code_module"),
    ("ednet", r"(?i)^ednet/(kt[1-4])/[^/]+\.csv$", "ednet_", "csv", "_ingest_date"),
    ("ednet", r"(?i)^ednet/contents/([^/]+)\.csv$", "ednet_", "csv", "_ingest_date"),
    ("sed", r"(?i)^sed/([^/]+)\.csv$", "sed_", "csv", "_ingest_date"),
    ("ednet", r"(?i)^ednet/(?:.*/)?((?:question|lecture)_bank)\.json$", "ednet_", "json", "_ingest_date"),
    ("content", r"(?i)(?:^|/)((?:question|lecture|test)_bank)\.json$", "content_", "json", "_ingest_date"),
    ("content", r"(?i)^data/(?:.*/)?([^/]*)\.md$", "content_documents", "markdown", "chapter"),
)
_COLUMNS = "path string, relative_path string, dataset string, table_name string, file_type string, partition_hint string, strategy string, length long"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, relative_path, dataset, table_name, file_type, partition_hint, strategy, length of every file that has a route.

    Files are listed by Spark, so any file system it reads will do; contents are not read. Of content banks with one name
    only the one nearest to the root is kept.
    """
    return routed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length"), root)


def routed(files: DataFrame, root: str) -> DataFrame:
    """The routes of listed files (path, length)."""
    # what comes after the root's own last component
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.regexp_replace("path", f"^.*?/{tail}/", "")
    out = files.withColumn("relative_path", relative)
    dataset, table_, kind, hint, strategy = (F.lit(None).cast("string") for _ in range(5))
    for name, pattern, table, file_type, partition in reversed(ROUTES):
        hit = F.col("relative_path").rlike(pattern)
        stem = table_name(F.regexp_extract("relative_path", pattern, 1))
        named = F.lit(table) if not table.endswith("_") else F.concat(F.lit(table), stem, F.lit("_events") if "kt[1-4]" in pattern else F.lit(""))
        dataset, table_ = F.when(hit, name).otherwise(dataset), F.when(hit, named).otherwise(table_)
        kind, hint = F.when(hit, file_type).otherwise(kind), F.when(hit, partition).otherwise(hint)
        strategy = F.when(hit, F.concat(F.lit("markdown:"), stem) if file_type == "markdown" else F.lit(file_type)).otherwise(strategy)
    found = out.select("path", "relative_path", dataset.alias("dataset"), table_.alias("table_name"), kind.alias("file_type"), hint.alias("partition_hint"), strategy.alias("strategy"), "length").where("dataset is not null")
    parts = F.split("relative_path", "/")
    bank = F.when(F.col("file_type") == "json", F.lower(F.element_at(parts, -1))).otherwise(F.col("path"))  # a bank stands for its name
    nearest = F.row_number().over(W.partitionBy(bank).orderBy(F.size(parts), "relative_path"))
    return found.withColumn("_rn", nearest).where("_rn = 1").drop("_rn")


def write_manifest(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_COLUMNS).json(path).where("path is not null")
