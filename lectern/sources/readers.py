"""Readers (S03-S11, S13, S16-S18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.cleaning import add_audit_columns
from lectern.operators.quality import ColumnCountError, counts


def clean_header(names: list[str]) -> list[str]:
    """Trimmed names without a byte-order mark; an empty first name is _row_idx, other empty ones col_<i>."""
    trimmed = [n.replace("﻿", "").strip() for n in names]
    return [n or ("_row_idx" if i == 0 else f"col_{i}") for i, n in enumerate(trimmed)]


def read_csv(spark: SparkSession, paths: str | list[str], multiline: bool = False) -> DataFrame:
    """All columns as strings under the cleaned header of the first line (S03, S08, DQ07).

    One path, glob or list is one scan; Spark packs small files into partitions. Every file must have the header of the
    first one: a file with other columns, more, fewer or other names, fails the scan when it is read, whichever columns are
    asked for, so all columns are parsed. A record is one line,
    so large files are split; with multiline, quoted line ends belong to their field and a file is one task.
    """
    options = {"multiLine": multiline, "inferSchema": False}
    raw = spark.read.options(header=False, **options).csv(paths)
    line = spark.read.text(paths).limit(1).first()  # one line
    if line is None:
        return raw
    fields = ", ".join(f"c{i} string" for i in range(max(1, len(raw.columns))))
    names = [v if v is not None else "" for v in spark.createDataFrame([(line["value"],)], "v string").select(F.from_csv("v", fields).alias("r")).select("r.*").first()]
    header = clean_header(names)
    if len(header) != len(raw.columns):
        raise ColumnCountError(f"{len(raw.columns)} columns under a header of {len(header)}")
    written = T.StructType([T.StructField(n.replace("\ufeff", "").strip() or f"_c{i}", T.StringType()) for i, n in enumerate(names)])
    if len({n.lower() for n in written.names}) < len(written) or any(not n.strip() for n in names):  # names that a header check cannot tell apart
        return spark.read.options(header=True, **options).schema(fields).csv(paths).toDF(*header)
    trim = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True} if any(n != n.strip() for n in names) else {}
    return spark.read.options(header=True, enforceSchema=False, columnPruning=False, **trim, **options).schema(written).csv(paths).toDF(*header)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line JSON documents with their raw text (S04); the text comes from the same file by its path."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("_path", F.col("_metadata.file_path"))
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias("_raw_json"))
    return rows.join(raw, "_path", "left").drop("_path")


def read_documents(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path, chapter (the second part of the path below root), filename, content_text."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.regexp_replace(F.col("_metadata.file_path"), f"^.*?/{tail}/", "")
    parts = F.split(relative, "/")
    return texts.select(relative.alias("path"), F.when(F.size(parts) > 2, parts[1]).otherwise(parts[0]).alias("chapter"), F.element_at(parts, -1).alias("filename"), F.col("value").alias("content_text"))


def read_parquet(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """Parquet, merging schemas that differ between batches if asked."""
    return spark.read.option("mergeSchema", merge).parquet(path)


def first_existing(spark: SparkSession, names: list[str]) -> DataFrame:
    """The first of several table names that the catalog knows."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    raise LookupError(f"none of these tables exists: {', '.join(names)}")


def ingest_csv(spark: SparkSession, paths: str | list[str], dataset: str) -> DataFrame:
    """The raw table of a set of CSV files, with audit columns."""
    return add_audit_columns(read_csv(spark, paths), dataset)


def audit_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """A few rows of the audit columns."""
    return df.select("_ingest_at", "_ingest_date", "_source_file", "_source_dataset").limit(n)


def preview(df: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The row count and the first rows."""
    return df.agg(F.count("*").alias("rows")), df.limit(n)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows, columns) of loaded tables."""
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(n, df.columns) for n, df in tables.items()], "table_name string, columns array<string>")
    return counts(tables).join(F.broadcast(names), "table_name")  # a row a table


def catalog_tables(spark: SparkSession) -> DataFrame:
    """(database, table) of the whole catalog (S15). Temporary views belong to no database and are left out."""
    rows = [(d.name, t.name) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name) if not t.isTemporary]
    return spark.createDataFrame(rows, "database string, table_name string")
