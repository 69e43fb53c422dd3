"""Ranked lexical search by pipelined term partitioning.

The inverted index is cut by documents into slices and, within them, by terms among owners: a term's owner is the band of
its document frequency, rarest first, and owners are the stages of a pipeline. A bundle holds up to `bundle_items` items
and a slice's documents; it carries sparse accumulators, one for each item and document with a score so far, from owner to
owner. At each stage it is cogrouped with the owner's postings of its slice, whose integer contributions are added. The
last stage keeps a bundle's best documents of each item, and the best of all slices are selected.

After a stage an accumulator is dropped only if it is certain not to be among the best: if its score and the most that
later owners can add (a contribution is below a million times the term's weight) stay below the score that the item's k-th
best document of the slice has already. So results are exact, and what is carried stays small although common words are in
nearly all documents. A word of all documents is spread over all slices like any other; nothing is held for a whole term.

A term's document frequency, and the numbers of documents and terms, are counted over all rows of documents. Null and empty
texts have no terms and are neither counted nor found. Repeated rows are documents each, and may each be listed. Rows
without an id count in the statistics but cannot be named in a result. Items without terms have no result; repeated items
are one, and several texts of one item id are ranked each under that id. Only the id and text columns are read, so extra
columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import broadcast_if_small, materialise, table

#: Runs of ASCII letters, digits and all characters beyond ASCII, after lower-casing A-Z in the UTF-8 bytes.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A document frequency of up to this share of all documents belongs to the stage of this place; others to the last one.
OWNERS = (1 / 64, 1 / 8, 1 / 2)
UNIT = 1_000_000


def term_counts(raw: bytes, step: int = 1 << 22) -> Counter:
    """How often each term occurs in a text's UTF-8 bytes, read `step` bytes at a time."""
    raw, found, at = raw.lower(), Counter(), 0
    while at < len(raw):
        whole = TERM.match(raw, at + step)  # a term across the edge is read whole
        end = whole.end() if whole else at + step
        found.update(TERM.findall(raw, at, end))
        at = end
    return found


def _cuts(sizes: np.ndarray, docs: int, nbytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of up to so many documents and about so many bytes; a longer document is a range of its own."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + nbytes, "right"))
        high = min(max(high, low + 1), low + docs, len(sizes))
        yield low, high
        low = high


def _index(batches: Iterator[pa.RecordBatch], slice_docs: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Postings of slices of documents: a row for each slice and term, and one without a term for the slice's documents."""
    number = TaskContext.get().partitionId() << 24
    for whole in batches:
        for low, high in _cuts(pc.binary_length(whole.column(1)).fill_null(0).to_numpy(), slice_docs, slice_bytes):
            batch = whole.slice(low, high - low)
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            where, tfs, sizes = [], [], np.zeros(batch.num_rows, np.int64)
            for i, raw in enumerate(batch.column(1)):
                found = term_counts(raw.as_buffer().to_pybytes() if raw.is_valid else b"")
                where.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                tfs.append(np.fromiter(found.values(), np.int64, len(found)))
                sizes[i] = tfs[-1].sum()
            doc = np.repeat(np.arange(len(where), dtype=np.int64), [len(w) for w in where])
            term, tf = np.concatenate(where), np.concatenate(tfs)
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], tf[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64), len(term)]
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[doc]
            rows = [(number, None, int((sizes > 0).sum()), int(sizes.sum()), batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes(), sizes.astype("<i8").tobytes())]
            for word, a, b in zip(numbers, cuts, cuts[1:], strict=False):
                keep = slice(a, b) if named[a:b].all() else np.arange(a, b)[named[a:b]]
                rows.append((number, word, int(b - a), 0, doc[keep].astype("<i4").tobytes(), tf[keep].astype("<i8").tobytes()))
            number += 1
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            for part in range(0, len(rows), 4096):
                columns = zip(*rows[part : part + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "term", "docs", "terms", "at", "values"])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each item with their repeats there."""
    for batch in batches:
        found = [(no, t, n) for no, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, n in term_counts(raw or b"").items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["item", "term", "n"])


def _stage(bundle: pa.Table, postings: pa.Table, owner: int, k: int, n: int, total: int, width: int) -> pa.Table:
    """A bundle's accumulators after one owner: those that may still lead to one of an item's k best documents."""
    if not bundle.num_rows:
        return bundle
    row = bundle.slice(0, 1).to_pylist()[0]
    sizes = np.frombuffer(row["sizes"], "<i8")
    norm = 25 + 75 * sizes * n // total
    score = np.zeros((width, len(sizes)), np.int64)
    score.ravel()[np.frombuffer(row["places"], "<i8")] = np.frombuffer(row["scores"], "<i8")
    for at, values, items in zip(postings["at"], postings["values"], postings["items"].to_pylist(), strict=True):
        docs, tf = np.frombuffer(at.as_buffer(), "<i4"), np.frombuffer(values.as_buffer(), "<i8")
        ratio = 1_000_000_000 * tf // (1000 * tf + 8 * norm[docs])
        for item in items:
            score[item["place"], docs] += item["weight"] * ratio
    rest = np.zeros(width, np.int64)
    for item in row["rest"]:
        rest[item["place"]] = UNIT * item["later"][owner]
    keep = score > 0
    if len(sizes) > k:
        least = np.partition(score, len(sizes) - k, 1)[:, len(sizes) - k]
        keep &= score + rest[:, None] >= least[:, None]
    places = np.flatnonzero(keep)
    new = {"places": [places.astype("<i8").tobytes()], "scores": [score.ravel()[places].astype("<i8").tobytes()]}
    return pa.table({c: pa.array(new.get(c, [row[c]]), bundle.schema.field(c).type) for c in bundle.column_names})


def _best(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of each item in each finished bundle."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, places, scores = (np.frombuffer(row[c], "<i8") for c in ("ids", "places", "scores"))
            item, doc = places // max(1, len(ids)), places % max(1, len(ids))
            order = np.lexsort((ids[doc], -scores, item))
            item, doc, scores = item[order], doc[order], scores[order]
            first = np.searchsorted(item, item)
            keep = np.arange(len(item)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(row["bundle"] * width + item[keep]), pa.array(ids[doc[keep]]), pa.array(scores[keep])], ["item", "doc_id", "score"])


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10, slice_docs: int = 2048, slice_bytes: int = 1 << 23, bundle_items: int = 256, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents with a score above 0 of every item.

    Of equal scores the smaller doc_id comes first; ids are longs.
    """
    width = bundle_items
    raw = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("raw"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.encode(F.col(f"`{item_text}`"), "UTF-8").alias("raw")).where("raw is not null").distinct()
    # items in consecutive numbers fill bundles; a number is written once and so stays
    numbers = materialise(asked.repartition(max(1, -(-asked.count() // width))).withColumn("item", F.monotonically_increasing_id()))
    wanted = materialise(numbers.select("item", "raw").mapInArrow(_items, "item long, term binary, n long"))
    vocabulary = wanted.select("term").distinct()
    held, held_bytes = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    few = broadcast_if_small(vocabulary.withColumn("asked", F.lit(True)), held, nbytes=held_bytes + 64 * held)
    indexed = raw.mapInArrow(partial(_index, slice_docs=slice_docs, slice_bytes=slice_bytes), "slice long, term binary, docs long, terms long, at binary, values binary")
    index = materialise(indexed.join(few, "term", "left").where("term is null or asked").drop("asked"))
    slices, postings = index.where("term is null"), index.where("term is not null")
    n, total = slices.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    frequency = postings.groupBy("term").agg(F.sum("docs").alias("df"))
    owner = F.lit(len(OWNERS))
    for i in reversed(range(len(OWNERS))):
        owner = F.when(F.col("df") <= OWNERS[i] * n, i).otherwise(owner)
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = wanted.join(frequency, "term").select("term", "item", owner.alias("owner"), (F.col("n") * weight).alias("weight")).where("weight > 0")
    weighed = materialise(weighed.withColumn("bundle", F.floor(F.col("item") / width)).withColumn("place", F.pmod("item", F.lit(width)).cast("int")))

    # a term's items of one bundle, and what the owners behind each stage can add to an item of it
    queries = materialise(weighed.groupBy("term", "owner", "bundle").agg(F.collect_list(F.struct("place", "weight")).alias("items")))
    asked_rows, asked_bytes = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 16 * F.size("items")), F.lit(0))).first()
    queries = broadcast_if_small(queries, asked_rows, nbytes=asked_bytes + 64 * asked_rows)
    stages = len(OWNERS) + 1
    later = F.array(*[F.coalesce(F.sum(F.when(F.col("owner") > s, F.col("weight"))), F.lit(0)) for s in range(stages)])
    rest = weighed.groupBy("bundle", "place").agg(later.alias("later")).groupBy("bundle").agg(F.collect_list(F.struct("place", "later")).alias("rest"))
    rest = materialise(rest)

    # a stated query set against all rows, in blocks of items and of documents
    none = F.lit(b"")
    bundles = slices.select("slice", F.col("at").alias("ids"), F.col("values").alias("sizes"), none.alias("places"), none.alias("scores")).crossJoin(broadcast_if_small(rest, rest.count(), 1000))
    bundles = bundles.select("slice", "bundle", "ids", "sizes", "places", "scores", "rest")
    schema = bundles.schema

    def visit(owner: int):
        def stage(bundle: pa.Table, postings: pa.Table) -> pa.Table:
            return _stage(bundle, postings, owner, k, n, total or 1, width)

        return stage

    for s in range(stages):
        owned = postings.join(queries.where(F.col("owner") == s), "term").select(F.col("slice").alias("s"), F.col("bundle").alias("b"), "at", "values", "items")
        bundles = bundles.groupBy("slice", "bundle").cogroup(owned.groupBy("s", "b")).applyInArrow(visit(s), schema)
    best = bundles.mapInArrow(partial(_best, k=k, width=width), "item long, doc_id long, score long")
    first = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranks = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranks.join(numbers.select("item", "item_id"), "item").select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLES = {
    "op12_ranked_search": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts from documents
), s as (select count(*)::bigint big_n, sum(len(ts))::bigint big_l from d where len(ts) > 0),
p as (select doc_id, t, count(*)::bigint tf from (select doc_id, unnest(ts) t from d) group by 1, 2),
f as (select t, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint w from p, s group by t, big_n),
m as (select doc_id, 25 + (75 * len(ts)::bigint * big_n) // big_l m from d, s where len(ts) > 0),
q as (
  select item_id, t, count(*)::bigint n from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark
  ) group by 1, 2
), r as (
  select item_id, p.doc_id, sum(q.n * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from q join p on p.t = q.t join f on f.t = p.t join m on m.doc_id = p.doc_id group by 1, 2
), k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from r where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""
}
