"""Quality measured while rows are written: observed counts of batches and streams, late rows, and a gate (DQ01-DQ03, DQ08)."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query string, batch long, metric string, value double"


def metrics(expectations: list[tuple[str, str, Column]]) -> list[Column]:
    """The rows that pass by, and those that break each expectation of lectern.operators.quality, as observed aggregates."""
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(f"{kind}:{column}") for kind, column, bad in expectations]]


def write_observed(df: DataFrame, path: str, table: str, expectations: list[tuple[str, str, Column]], most: float | None = None) -> DataFrame:
    """Write df as Parquet; the report of all expectations is counted by the write itself, without a second scan (DQ01-DQ03).

    The report is that of quality.report(). With `most`, a table of which a larger share of rows breaks an expectation
    raises ValueError; it has been written then, for the rows to be looked at.
    """
    spark, seen = df.sparkSession, Observation()
    df.observe(seen, *metrics(expectations)).write.mode("overwrite").parquet(path)
    found = seen.get
    rows = [(table, kind, column, int(found[f"{kind}:{column}"] or 0)) for kind, column, _ in expectations]
    worst = max((n for *_, n in rows), default=0)
    if most is not None and worst > most * found["rows"]:
        raise ValueError(f"{worst} of {found['rows']} rows of {table} break an expectation")
    report = spark.createDataFrame(rows, "table_name string, expectation string, column_name string, failed long")
    return report.withColumn("ok", F.col("failed") == 0)


def observed(rows: DataFrame, name: str, *extra: Column) -> DataFrame:
    """Routed rows of a stream with the counts of each route, and more if wanted, observed under a name (DQ08)."""
    each = [F.count_if(F.col("route") == r).alias(r) for r in ("clicks", "assessment", "rejected")]
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *each, *extra)


class Watch(StreamingQueryListener):
    """Keeps what queries observe, batch by batch, and how many rows came later than the watermark.

    The newest `most` numbers are kept here; save() adds them to a table. Register it with spark.streams.addListener().
    """

    def __init__(self, most: int = 100_000) -> None:
        self.kept: deque[tuple] = deque(maxlen=most)
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        new = [(str(p.id), p.batchId, f"{name}.{k}", float(v)) for name, row in p.observedMetrics.items() for k, v in row.asDict().items() if v is not None]
        late = sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators)
        with self.lock:
            self.kept.extend([*new, (str(p.id), p.batchId, "late_rows", float(late))])

    def report(self, spark: SparkSession) -> DataFrame:
        """(query, batch, metric, value) of all that is kept."""
        with self.lock:
            return spark.createDataFrame(list(self.kept), SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Add what is kept to a table and forget it."""
        self.report(spark).write.mode("append").parquet(path)
        with self.lock:
            self.kept.clear()

    def total(self, query: str, metric: str) -> float:
        with self.lock:
            return sum(v for q, _, m, v in self.kept if q == query and m == metric)


def gated(query: StreamingQuery, watch: Watch, name: str, most: float = 0.5, least_rows: int = 100, seconds: int = 1) -> bool:
    """Wait for a query, and stop it once more than a share of the observed rows is rejected; True if it was not stopped.

    The share is judged after least_rows rows, and once more when the query has ended.
    """
    while True:
        ended = query.awaitTermination(seconds)
        rows, bad = watch.total(query.id, f"{name}.rows"), watch.total(query.id, f"{name}.rejected")
        if rows >= least_rows and bad > most * rows:
            query.stop()
            return False
        if ended:
            return True


def drained(spark: SparkSession) -> None:
    """Wait until listeners have had all events so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
