"""Tables of immutable files with a version list, and compaction by file size.

A version is a text file of the table's data files, in a folder of versions; the largest number is the current one. It is
written beside the folder's others under a name of its own and renamed last, so a table is whole at every moment, whichever
step a job dies in; what a dead job leaves behind is in no version and goes with vacuum().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.ranges import running
from lectern.session import broadcast_if_small, delete, materialise

VERSIONS = "_versions"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def version(spark: SparkSession, root: str) -> int:
    """The current version's number; 0 where there is none yet."""
    fs, path = _files(spark, f"{root}/{VERSIONS}")
    if not fs.exists(path):
        return 0
    return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=0)


def file_list(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the current version's data files, below root."""
    now = version(spark, root)
    return spark.read.text(f"{root}/{VERSIONS}/{now}").select(F.col("value").alias("path")) if now else spark.createDataFrame([], "path string")


def read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{r['path']}" for r in file_list(spark, root).collect()])  # a plan lists its files


def commit(spark: SparkSession, root: str, files: DataFrame, after: int) -> int:
    """Make (path) the version behind `after`; fails where another job has made that one meanwhile."""
    new = f"{root}/{VERSIONS}/.{uuid.uuid4().hex}"
    files.select("path").coalesce(1).write.text(new)
    fs, made = _files(spark, new)
    _, to = _files(spark, f"{root}/{VERSIONS}/{after + 1}")
    if fs.exists(to) or not fs.rename(made, to):
        delete(spark, new)
        raise RuntimeError(f"version {after + 1} of {root} is there already")
    return after + 1


def _written(df: DataFrame, root: str) -> DataFrame:
    """df as new data files; their paths below root."""
    spark, name = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    return sizes(spark, f"{root}/{name}").select(F.concat(F.lit(f"{name}/"), F.substring_index("path", "/", -1)).alias("path"))


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of Parquet files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder).select("path", "length")


def add(df: DataFrame, root: str) -> int:
    """Add rows to the table as a new version."""
    spark = df.sparkSession
    now = version(spark, root)
    return commit(spark, root, file_list(spark, root).unionByName(_written(df, root)), now)


def compact(spark: SparkSession, root: str, small: int = 32 << 20, target: int = 128 << 20) -> int:
    """Pack files below `small` bytes into files of about `target` bytes; files of that size and more stay as they are.

    Small files fill bins in the order of their paths, by running sums of their lengths, and each bin is one task that
    writes one file. Returns the number of files that were packed; with fewer than two there is no new version.
    """
    now = version(spark, root)
    listed = file_list(spark, root)
    name = F.substring_index("path", "/", -2)  # folder and file: unique, as folders have names of their own
    lengths = sizes(spark, f"{root}/data").select(name.alias("name"), "length")
    here = materialise(listed.withColumn("name", name).join(lengths, "name"))
    little = here.where(F.col("length") < small)
    n = little.count()
    if n < 2:
        return 0
    bins = running(little.withColumn("_all", F.lit(0)), ["_all"], ["name"], ["length"]).select("name", F.floor((F.col("length_upto") - F.col("length")) / target).alias("bin"))
    bins = materialise(bins)
    paths = [f"{root}/{r['path']}" for r in little.select("path").collect()]  # a plan lists its files
    rows = spark.read.parquet(*paths)
    row = F.struct(*rows.columns)
    dealt = rows.select(row.alias("row"), F.substring_index("_metadata.file_path", "/", -2).alias("name")).join(broadcast_if_small(bins, n), "name")
    n_bins = int(bins.agg(F.max("bin")).first()[0]) + 1
    packed = dealt.repartitionById(n_bins, F.col("bin").cast("int")).select("row.*")
    kept = here.where(F.col("length") >= small).select("path")
    commit(spark, root, kept.unionByName(_written(packed, root)), now)
    return n


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete data files that the current version does not have, and older versions; returns how many files. Run it when no
    reader of an older version is left."""
    now = version(spark, root)
    name = lambda c: F.substring_index(c, "/", -2)
    known = file_list(spark, root).select(name("path").alias("name"))
    gone = sizes(spark, f"{root}/data").select("path", name("path").alias("name")).join(known, "name", "left_anti").select("path").collect()
    for r in gone:
        delete(spark, r["path"])
    fs, path = _files(spark, f"{root}/{VERSIONS}")
    for s in fs.listStatus(path):
        if s.getPath().getName() != str(now):
            fs.delete(s.getPath(), True)
    return len(gone)
