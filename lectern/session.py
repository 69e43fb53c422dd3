"""Session and shared-storage helpers used by every part of the library."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir; a temporary one only where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif context.master.split("[")[0] == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


#: Folders that scratch() has opened, the innermost last.
_SCRATCH: list[str] = []


def tables_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables stand, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/lectern-{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession) -> str:
    """A path for a new intermediate table, in the innermost scratch folder if there is one."""
    return f"{_SCRATCH[-1] if _SCRATCH else tables_folder(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends at files that survive lost executors.

    Results of lazy queries read these tables, so they stay until clear_tables(), or until the scratch() around them ends.
    """
    spark = df.sparkSession
    path = table_path(spark)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A job run inside removes its shuffle files when it is done, and not only once the driver collects garbage."""
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def rocksdb_states(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep state in RocksDB, whatever store the session names: a stream takes the settings of its start."""
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        yield


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end: write what must outlive them to a path taken before."""
    _SCRATCH.append(table_path(spark))
    try:
        yield
    finally:
        delete(spark, _SCRATCH.pop())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_tables(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed."""
    delete(spark, tables_folder(spark))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 500_000, nbytes: int = 0, most_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only for a side whose row count is known and within limit; beyond it Spark shuffles both sides.

    nbytes is the side's size where its rows are not a few numbers each, such as texts or arrays; it has a limit of its own.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= limit and nbytes <= most_bytes else df
