"""N-gram Jaccard join by token-combination prefixes, and the components that its links form.

A document's tokens are its distinct word shingles. Tokens have one global order: rarest class first, within a class by
hash. Of two documents that link, the one whose prefix ends first misses at most `spare` of its own tokens in the other,
so a prefix that cannot lose all its signatures with that many tokens gone meets the other's prefix in one. Signatures are

* nothing for tokens that no other document has (they only use up what may be missing),
* the token itself for rare ones (in up to `rare` documents),
* pairs of tokens for frequent ones: these are dealt by hash into small classes, a class of j tokens in the prefix gives
  its j * (j - 1) / 2 pairs, and to lose them all at least j - 1 tokens must be gone. Prefixes extend accordingly.

The number of classes follows a document's size; a document signs for its own size band and the next one up if a partner
may be there, and a pair meets in the band of its larger member. Documents too small to be covered by pairs also sign
with their frequent tokens alone, and meet each other so.

Candidates are verified on whole token sets. Each signature's list has a hub, the member with the smallest share of tokens
of its own; all members of the lists of one hub are its cluster. To find components not all pairs are rows: first each
member is compared with its hub; then, in clusters that still hold more than one component, members of different
components are compared in blocks of at most `block_rows` a side inside tasks, which emit the links that join components
and nothing else. A pair whose shared tokens cannot suffice, by their sizes less their own tokens, is not compared. So each
candidate pair is ruled out by a bound, compared, or already connected, and no link between components is lost.

Frequencies are exact, over all texts, up to a chance of about 1 in 4,000 that a token counts another's documents as its
own, which moves it to a more frequent class and loses nothing. Blocks of documents send their distinct tokens, with counts,
as packed arrays to hash buckets and get classes back, so a token of a third of all documents is one entry a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.llm.ragged import MULTIPLIER, blocks, buffers, mix, shingles, words
from lectern.session import materialise, table


def spare(n: int, similarity: tuple[int, int]) -> int:
    """How many of its n tokens a document may miss in one that it links with."""
    num, den = similarity
    return n - -(-num * n // den)


def token_sets(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each text, one after the other, and the hashes before each text."""
    data, offsets, _ = buffers(texts)
    sets, sizes = [], [np.zeros(1, np.int64)]
    for a, b in blocks(offsets):
        tokens, before = shingles(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), k)
        sets.append(tokens)
        sizes.append(np.diff(before))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(np.concatenate(sizes))


def first_copies(docs: pa.Table, side: pa.Table) -> pa.Table:
    """docs without the rows that the side's rows without a bucket name as copies, in the order of their ids."""
    copies = side.filter(pc.is_null(side["bucket"]))["doc_id"]
    if len(copies):
        docs = docs.filter(pc.invert(pc.is_in(docs["doc_id"], value_set=copies.combine_chunks())))
    return docs.sort_by("doc_id")


def ranked(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 bits more of tokens: what their frequency is counted by."""
    return tokens >> np.uint64(32 - bits)


def signatures(tokens: np.ndarray, kind: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Signatures of one document: its tokens, sorted, and for each 0 (its own), 1 (rare) or 2 (frequent)."""
    n = len(tokens)
    need = spare(n, similarity) + 1
    own, rare, often = int((kind == 0).sum()), tokens[kind == 1], tokens[kind == 2]
    if own >= need:
        return np.zeros(0, np.uint64)
    if own + len(rare) >= need:
        return rare[: need - own]
    missing = need - own - len(rare)
    num, den = similarity
    out, covered = [rare], True
    for band in {n.bit_length(), (n * den // num).bit_length()}:
        bits = max(0, band - 2)
        cell = often >> np.uint64(64 - bits) if bits else np.zeros(len(often), np.uint64)
        gained = np.cumsum(np.r_[False, cell[1:] == cell[:-1]][: len(cell)])
        end = int(np.searchsorted(gained, missing)) + 1
        covered &= end <= len(often)
        part, cell = often[:end], cell[:end]
        step = 1
        while step < len(part) and (same := cell[step:] == cell[:-step]).any():
            out.append(mix(mix(part[:-step][same] + np.uint64(band)) * np.uint64(MULTIPLIER) + part[step:][same]))
            step += 1
    if not covered:
        out.append(mix(often[:missing] + np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(out)


def _classes(group: pa.Table, rare: int) -> pa.Table:
    """All blocks' tokens of one bucket in, their classes out: 0 in one document, 1 in up to `rare`, 2 in more."""
    group = group.sort_by("block")
    data, offsets, _ = buffers(group["tokens"].cast(pa.large_binary()))
    counts, _, _ = buffers(group["counts"].cast(pa.large_binary()))
    tokens, counts = np.frombuffer(data.tobytes(), np.uint32), np.frombuffer(counts.tobytes(), np.uint8)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sums = np.add.reduceat(counts[order].astype(np.int64), first)
    found = np.empty(len(tokens), np.uint8)
    found[order] = np.repeat(np.where(sums > rare, 2, np.where(sums > 1, 1, 0)).astype(np.uint8), np.diff(np.r_[first, len(tokens)]))
    bounds = offsets // 4
    return pa.table({
        "block": group["block"], "bucket": group["bucket"], "doc_id": pa.nulls(group.num_rows, pa.int64()),
        "classes": pa.array([found[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()),
    })


def _signed(docs: pa.Table, side: pa.Table, k: int, similarity: tuple[int, int], bits: int) -> pa.Table:
    docs = first_copies(docs, side)
    tokens, before = token_sets(docs["text"], k)
    short = ranked(tokens, bits)
    distinct = np.unique(short)
    got = side.filter(pc.is_valid(side["bucket"])).sort_by("bucket")
    classes = np.frombuffer(b"".join(got["classes"].to_pylist()), np.uint8)
    kind = classes[np.searchsorted(distinct, short)]
    own = np.r_[0, np.cumsum(kind == 0)]
    own = own[before[1:]] - own[before[:-1]]
    sizes = np.diff(before)
    signed, sets = [None] * len(sizes), [None] * len(sizes)
    for i, (n, o) in enumerate(zip(sizes.tolist(), own.tolist(), strict=True)):
        if n and o <= spare(n, similarity):
            a, b = before[i], before[i + 1]
            found = signatures(tokens[a:b], kind[a:b], similarity)
            if len(found):
                signed[i], sets[i] = found.view(np.int64), tokens[a:b].tobytes()
    return pa.table({"doc_id": docs["doc_id"], "n": pa.array(sizes), "common": pa.array(sizes - own), "signatures": pa.array(signed, pa.list_(pa.int64())), "tokens": pa.array(sets, pa.binary())})


def _sent(docs: pa.Table, side: pa.Table, k: int, bits: int) -> pa.Table:
    docs = first_copies(docs, side)
    tokens, _ = token_sets(docs["text"], k)
    distinct, counts = np.unique(ranked(tokens, bits), return_counts=True)
    bucket = (distinct >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(bucket)].astype(np.int64) if len(bucket) else starts
    low, counts = distinct.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
    return pa.table({
        "bucket": pa.array(bucket[starts].astype(np.int32)), "block": pa.array(np.full(len(starts), docs["block"][0].as_py() if docs.num_rows else 0, np.int32)),
        "tokens": pa.array([low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        "counts": pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
    })


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose token sets, given as sets(doc_id, tokens), are similar enough."""
    num, den = similarity

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def _compare(cell: pa.Table, similarity: tuple[int, int]) -> pa.Table:
    """Pairs of components that a link in one block of a cluster joins, at most one less than the components."""
    num, den = similarity
    cell = cell.sort_by("doc_id")
    part, n, common = (cell[c].to_numpy() for c in ("part", "n", "common"))
    second, split = cell["second"].to_numpy(zero_copy_only=False), bool(cell["split"][0].as_py())
    data, offsets, _ = buffers(cell["tokens"].cast(pa.large_binary()))
    tokens, bounds = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
    left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if split else (np.arange(len(part)),) * 2
    most = np.minimum(common[left, None], common[None, right])
    may = (part[left, None] != part[None, right]) & (den * most >= num * (n[left, None] + n[None, right] - most))
    if not split:
        may &= np.arange(len(part))[:, None] < np.arange(len(part))[None]
    root = {p: p for p in part.tolist()}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    out = []
    rows = left[may.any(1)]
    if len(rows):
        # one side's tokens as a 0/1 vector over all tokens here; the other side's sets are summed through it
        distinct, place = np.unique(tokens, return_inverse=True)
        mark = np.zeros(len(distinct), np.int64)
        sizes = np.diff(bounds)
        at = np.concatenate([place[bounds[j] : bounds[j + 1]] for j in right])
        starts = np.cumsum(sizes[right]) - sizes[right]
        position = {int(i): k for k, i in enumerate(left)}
        for i in rows.tolist():
            mine = place[bounds[i] : bounds[i + 1]]
            mark[mine] = 1
            both = np.add.reduceat(mark[at], starts)
            mark[mine] = 0
            good = may[position[i]] & (den * both >= num * (n[i] + n[right] - both))
            for j in right[good].tolist():
                p, q = find(int(part[i])), find(int(part[j]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((p, q))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def jaccard_components(documents: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100), rare: int = 32, block_docs: int = 4000, block_bytes: int = 1 << 24, bucket_tokens: int = 1 << 20, block_rows: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) for every row.

    Documents link when den * |intersection| >= num * |union| of their shingle sets. Null and wordless texts have an
    empty set and link with nothing. Rows with a null id link with nothing and have a null component. Equal texts are one
    document until the end. Ids are keys: a repeated row has the result of its id, and rows of one id with different
    texts are one node of the graph. Only the id and text columns are read, so extra columns cannot clash.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    members = materialise(rows.select("doc_id", F.unhex(F.md5("text")).alias("same"), F.octet_length("text").alias("bytes")))
    n_docs, n_bytes = members.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_blocks = max(1, math.ceil(n_docs / block_docs), math.ceil(n_bytes / block_bytes))
    bits = max(0, math.ceil(math.log2(max(1, n_bytes / 6 / bucket_tokens))))  # about six bytes of text a token
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int").alias("block")

    firsts = members.groupBy("same").agg(F.min("doc_id").alias("rep"))
    # a row whose id also stands for another text is not left out
    copies = members.join(firsts, "same").where("doc_id <> rep").select("doc_id").distinct().join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    copies = materialise(copies.select(block("doc_id"), F.lit(None).cast("int").alias("bucket"), "doc_id", F.lit(None).cast("binary").alias("classes")))
    blocked = rows.where("doc_id is not null").select("doc_id", "text", block("doc_id")).groupBy("block")

    def sent(docs: pa.Table, side: pa.Table) -> pa.Table:
        return _sent(docs, side, k, bits)

    def classes(group: pa.Table) -> pa.Table:
        return _classes(group, rare)

    def signed(docs: pa.Table, side: pa.Table) -> pa.Table:
        return _signed(docs, side, k, similarity, bits)

    tokens = blocked.cogroup(copies.groupBy("block")).applyInArrow(sent, "bucket int, block int, tokens binary, counts binary")
    kinds = materialise(tokens.groupBy("bucket").applyInArrow(classes, "block int, bucket int, doc_id long, classes binary"))
    side = copies.unionByName(kinds)
    table_ = materialise(blocked.cogroup(side.groupBy("block")).applyInArrow(signed, "doc_id long, n long, common long, signatures array<long>, tokens binary"))

    num, den = similarity
    bound = lambda an, ac, bn, bc: F.least(ac, bc) * den >= (an + bn - F.least(ac, bc)) * num
    sets = table_.where("signatures is not null").select("doc_id", "n", "common", "tokens")
    posts = table_.where("signatures is not null").select("doc_id", "n", "common", F.explode("signatures").alias("sig"))
    central = F.struct((F.col("n") - F.col("common")).cast("double") / F.col("n"), "doc_id", "n", "common")
    lists = posts.groupBy("sig").agg(F.min(central).alias("hub"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("size")).where("first < last")
    hubs = materialise(lists.select("sig", "size", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.common").alias("hub_common")))
    # lists of more than a quarter of a task's share of all posts are at most four a task: their hubs go to the posts
    share = (hubs.agg(F.sum("size")).first()[0] or 0) / (4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    long, short = hubs.where(F.col("size") > share).drop("size"), hubs.where(F.col("size") <= share).drop("size")
    met = posts.join(F.broadcast(long), "sig").unionByName(posts.join(F.broadcast(long.select("sig")), "sig", "left_anti").join(short, "sig"))
    clusters = materialise(met.drop("sig").distinct())
    pairs = clusters.where((F.col("doc_id") != F.col("hub")) & bound(F.col("n"), F.col("common"), F.col("hub_n"), F.col("hub_common")))
    links = materialise(verified(pairs.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct(), sets, similarity))
    parts = connected_components(links)

    # a member whose shared tokens suffice for no partner as large as the smallest member is out; then mixed clusters remain
    least = clusters.groupBy("hub").agg(F.min("n").alias("least"))
    placed = clusters.join(least, "hub").where(F.col("common") * (den + num) >= (F.col("n") + F.col("least")) * num)
    placed = placed.join(parts, placed["doc_id"] == parts["node"], "left").select("hub", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    mixed = placed.groupBy("hub").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p < q").select("hub", "size")
    rows_ = placed.join(mixed, "hub").withColumn("slices", F.ceil(F.col("size") / block_rows).cast("int"))
    rows_ = rows_.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows_ = rows_.select("doc_id", "part", F.xxhash64("hub", F.least("slice", "other"), F.greatest("slice", "other")).alias("cell"), (F.col("slice") > F.col("other")).alias("second"), (F.col("slice") != F.col("other")).alias("split"))

    def compare(cell: pa.Table) -> pa.Table:
        return _compare(cell, similarity)

    joined = connected_components(rows_.join(sets, "doc_id").groupBy("cell").applyInArrow(compare, "a long, b long"))
    joined = joined.select(F.col("node").alias("part"), F.col("component").alias("whole"))

    found = firsts.join(table_.select(F.col("doc_id").alias("rep"), "n"), "rep").groupBy("same", "rep").agg(F.max("n").alias("n"))
    found = found.join(parts, found["rep"] == parts["node"], "left").select("same", "n", F.coalesce("component", "rep").alias("part"))
    found = found.join(joined, "part", "left").select("same", "n", F.coalesce("whole", "part").alias("part"))
    whole = members.select("doc_id", "same").join(found, "same", "left")
    # a row without an id is counted here, alone
    return whole.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.when(F.coalesce("n", F.lit(0)) > 0, F.when(F.col("doc_id").isNotNull(), F.col("part"))).otherwise(F.col("doc_id")).alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, similarity=(85, 100))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES = {
    "op3_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct([array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)]) end sh from w
), n as (select doc_id, len(sh) n from s),
t as (select doc_id, unnest(sh) t from s),
p as (
  select x.doc_id a, y.doc_id b, count(*) c from t x join t y on x.t = y.t and x.doc_id < y.doc_id group by 1, 2
), l as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)
), e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on e.a = r.b)
select n.doc_id, n.n n_shingles, (select min(b) from r where r.a = n.doc_id) component_id from n
"""
}
