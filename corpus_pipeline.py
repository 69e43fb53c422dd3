"""Training-corpus pipeline over the documents table: quality, near duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of documents; the last one returns the mixture's schedule with the texts. Nulls, empty texts and empty tables pass
through as the operators define them; a document is dropped only for the reason its stage names. Rows are judged by their
own texts, so documents without an id, or of one id with different texts, are each treated like any other. Columns may have
any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, mixture, quality, secrets
from lectern.llm.rows import numbered, text_key, unused
from lectern.session import broadcast_if_small, delete, materialise, scratch, shuffles_removed, table, table_path


def _without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """docs without those whose key, in the column of that name, is in keys."""
    keys = materialise(keys.distinct().toDF(name))
    return docs.join(broadcast_if_small(keys, keys.count()), name, "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones among docs, does not reject."""
    model = quality.learned_from(docs, table(spark, sf_dir, "labels"))
    others, name = tuple(c for c in docs.columns if c != "doc_id"), unused(docs.columns, "quality")
    return quality.score(docs, model, keep=others, name=name).where(F.col(name) >= 0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingle sets are linked at a Jaccard similarity of 0.8: that of the smallest id.

    Documents without an id, and those that share one with another text, stand behind all others, in the order of
    lectern.llm.rows.numbered. Rows that repeat id and text are one document: that of the smallest hash of all its columns.
    """
    node = unused(docs.columns, "node")
    rows = numbered(docs, node)
    found = materialise(jaccard.jaccard_components(rows.select(node, "text"), k=5, similarity=(80, 100), doc_id=node))
    kept = _without(rows, found.where("doc_id <> component_id").select("doc_id"), node)
    repeated = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = materialise(repeated.toDF(node))
    few = broadcast_if_small(repeated, repeated.count())
    columns = [F.col(c) for c in docs.columns]
    once = kept.join(few, node, "left_semi").groupBy(node).agg(F.min_by(F.struct(*columns), F.xxhash64(F.to_json(F.struct(*columns)))).alias("row"))
    return kept.join(few, node, "left_anti").select(*docs.columns).unionByName(once.select("row.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; an item of under five words names no passage."""
    key = unused(docs.columns, "key")
    rows = docs.withColumn(key, text_key(F.col("text")))
    bad = decontaminate.contaminated(rows.select(key, "text"), table(spark, sf_dir, "benchmark"), shortest=5, doc_id=key)
    return _without(rows, bad.select("doc_id"), key).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark; n_chars follows the new text."""
    spans = unused(docs.columns, "spans")
    clean = unused([*docs.columns, spans], "clean")
    scanned = secrets.scan_secrets(docs, name=spans)
    masked = scanned.withColumn(clean, F.when(F.col("text").isNotNull(), secrets.redacted(F.col("text"), F.col(spans))))
    size = F.when(F.size(spans) > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumns({"n_chars": size, "text": F.col(clean)}).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every scheduled copy of every document under temperature-mixed source weights; mix_order is the training order."""
    return mixture.mix_sources(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("one_of_each_group", one_of_each_group),
    ("without_benchmark", without_benchmark),
    ("without_secrets", without_secrets),
    ("mixed", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. A stage's own tables, and what it read, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = table_path(spark)
        with scratch(spark), shuffles_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
