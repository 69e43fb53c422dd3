"""Telling rows apart where ids are missing or repeat, and column names that no table column has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import broadcast_if_small, materialise

#: Ids beyond this leave no room for numbers behind them.
FARTHEST = 1 << 62


def unused(columns: Iterable[str], name: str) -> str:
    """name, with as many underscores behind it as make it differ from all columns, letter case aside."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; a null is a text of its own."""
    return F.unhex(F.md5(F.concat(F.when(text.isNull(), "0").otherwise("1"), F.coalesce(text, F.lit("")))))


def numbered(documents: DataFrame, name: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents and a long column under a name that tells every pair of id and text from all others.

    It is the id itself where that stands for one text and is within 2^62 of 0. Texts without such an id, and those that
    share one, are numbered behind the largest of them, in the order of their ids, those without one last, then by the hash
    of the text. Rows that repeat both have one number.
    """
    far = (F.col("id") > FARTHEST) | (F.col("id") < -FARTHEST)
    key = text_key(F.col(f"`{text}`"))
    pairs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), key.alias("key")).distinct()
    shared = materialise(pairs.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    several = pairs.where(far).unionByName(pairs.where(~far).join(broadcast_if_small(shared, shared.count()), "id", "left_semi"))
    top = pairs.agg(F.coalesce(F.max(F.when(~far, F.col("id"))), F.lit(0))).first()[0]
    odd = several.unionByName(pairs.where("id is null")).orderBy(F.asc_nulls_last("id"), "key")
    odd = materialise(odd.select(F.col("id").alias("odd_id"), F.col("key").alias("odd_key"), (F.monotonically_increasing_id() + F.lit(top + 1)).alias("odd")))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row, F.col(f"`{doc_id}`").cast("long").alias("id"), key.alias("key"))
    rows = rows.join(broadcast_if_small(odd, odd.count()), F.col("id").eqNullSafe(F.col("odd_id")) & (F.col("key") == F.col("odd_key")), "left")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in documents.columns], F.coalesce("odd", "id").alias(name))
