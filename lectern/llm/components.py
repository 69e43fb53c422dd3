"""Connected components of a link table, entirely as joins and map-side combined aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lectern.session import materialise


def _mark(edges: DataFrame) -> Row:
    """Count and sums that differ between rounds that change the links."""
    return edges.agg(F.count("*"), *[F.sum(x.cast("decimal(38,0)")) for x in (F.col("b"), F.xxhash64("a", "b"))]).first()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component), component being the smallest node reachable; nodes without links are absent.

    Large-star and small-star steps alternate until nothing changes, so a chain of n links needs about log n rounds, links
    that all lead to the smallest node of their component one round, and no links none.
    Each round is written to the shared folder, which keeps lineage short and survives lost executors.
    The per-node minimum is aggregated on the map side and joined back, so a hub with a third of all links is split by
    the skew-join rule. Null ends, self links and repeated links are ignored; no links give no rows.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        # large star: every larger neighbour of a node is tied to the smallest node around it
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialise(small.where("a <> b").distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
