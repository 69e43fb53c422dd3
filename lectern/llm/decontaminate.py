"""Benchmark decontamination by spaced seeds, as DataFrame functions only.

Words are runs of letters and digits of the lower-cased text. Fixed masks pick four positions of a short span of words
and ignore the rest; the hash of the picked words meets the same hash of a benchmark item, and the words around each hit
are compared place by place, so substituted words cost a mismatch and no more. An overlap is a stretch of `window` words
on one diagonal (or the whole item, where that is shorter) of which at least `similarity` agree, whatever the item's size: of
four words and fewer that is all of them, of five to seven one may differ. Items of fewer words than a mask picks have a
mask of all their words.

A passage that many items share is verified once and not once an item: a hit of a seed with more than `common` places in
the items is refined by the words around it. Words that at most so many of the seed's places have at an offset are joined
as they are; the words that more of them have make a pattern, which all places of one pattern share and a document meets
once. Any overlap agrees in a word of the first kind or agrees with the pattern, so none is lost.

Null and empty texts overlap with nothing, nor do items without words or with fewer than `shortest`. Repeated documents are
reported once an id; repeated items under each item id. Null ids are kept out of the result. Only id and text columns are
read. Words travel as hashes of 64 bits; of a document only the words on a hit's diagonal, as many as the item has, are
compared, so a text of one repeated word costs its length times the item's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import broadcast_if_small, materialise, table

# Places of a span that each mask compares. Any 6 to 13 words of which 80 % agree hold one of MASKS whole, any
# five one of these or of FIVE (tests try every pattern of mismatches), so windows of those sizes are found without loss.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4))
FIVE = ((0, 1, 2, 4), (0, 2, 3, 4))


def hashed_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keys: list[str], masks: tuple) -> DataFrame:
    """keys, place and seed for each mask at each place of the word hashes in column `h`."""
    span = max(m[-1] for m in masks) + 1
    shifted = [F.slice("h", j + 1, F.size("h")).alias(f"w{j}") for j in range(span)]
    placed = rows.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("place", "w")).select(*keys, "place", "w.*")
    each = [F.when(F.col(f"w{m[-1]}").isNotNull(), F.xxhash64(F.lit(repr(m)), *[F.col(f"w{j}") for j in m])) for m in masks]
    return placed.select(*keys, "place", F.explode(F.array(*each)).alias("seed")).where("seed is not null")


def refined(hot: DataFrame, docs: DataFrame, tests: DataFrame, sized: DataFrame, window: int, similarity: float, common: int) -> DataFrame:
    """doc_id, item_id, n_words and shift of hits of common seeds whose surroundings may overlap.

    hot has doc_id, seed and place; tests the places of the common seeds in the items; sized the items' words.
    """
    offsets = F.sequence(F.lit(1 - window), F.lit(window - 1))

    def around(h: Column, place: Column) -> Column:
        return F.transform(offsets, lambda o: F.get(h, place + o))

    posts = materialise(tests.join(sized, ["item_id", "n_words"]).select("seed", "item_id", "n_words", "item_place", around(F.col("h"), F.col("item_place")).alias("near")))
    words = posts.select("seed", F.posexplode("near").alias("at", "word")).where("word is not null").groupBy("seed", "at", "word").agg(F.count("*").alias("n"))
    words = materialise(words)
    # a document's places are exploded within its row, so that its words are not sent once a place
    places = hot.groupBy("doc_id").agg(F.collect_set(F.struct("seed", "place")).alias("places"))
    met = docs.join(places, "doc_id").select("doc_id", hashed_words(F.col("text")).alias("h"), F.explode("places").alias("x"))
    met = materialise(met.select("doc_id", "x.seed", "x.place", around(F.col("h"), F.col("x.place")).alias("near")).distinct())
    keys = ["doc_id", "item_id", "n_words", (F.col("place") - F.col("item_place")).alias("shift")]

    rare = words.where(F.col("n") <= common).select("seed", "at", "word")
    told = posts.select("seed", "item_id", "n_words", "item_place", F.posexplode("near").alias("at", "word")).join(rare, ["seed", "at", "word"])
    one = met.select("doc_id", "seed", "place", F.posexplode("near").alias("at", "word")).join(told, ["seed", "at", "word"]).select(*keys)

    often = words.where(F.col("n") > common).groupBy("seed").agg(F.collect_set(F.struct("at", "word")).alias("often"))
    width = F.least(F.lit(window), F.col("n_words"))
    pattern = F.transform("near", lambda w, i: F.when(F.array_contains("often", F.struct(i.alias("at"), w.alias("word"))), w))
    posts = materialise(posts.join(often, "seed").select("seed", "item_id", "n_words", "item_place", width.alias("width"), pattern.alias("pattern")))
    agree = F.zip_with("near", "pattern", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    patterns = posts.select("seed", "width", "pattern").distinct()
    alike = met.join(patterns, "seed").withColumn("best", best_stretch(agree, F.col("width"))).where(F.col("best.agreeing") >= needed(F.col("width"), similarity))
    both = alike.select("doc_id", "seed", "place", "width", "pattern").join(posts, ["seed", "width", "pattern"]).select(*keys)
    return one.unionByName(both).distinct()


def needed(width: Column, similarity: float) -> Column:
    return F.ceil(width * F.lit(similarity) - 1e-9)


def best_stretch(agree: Column, width: Column) -> Column:
    """The most agreeing places in a row of `width`, and where that row begins, the first of equals: one sum that slides."""
    total = F.aggregate(F.slice(agree, F.lit(1), width), F.lit(0), lambda s, x: s + x)
    start = F.struct(total.alias("now"), total.alias("agreeing"), F.lit(0).alias("at"))

    def step(state: Column, i: Column) -> Column:
        now = state["now"] + F.get(agree, i + width - 1) - F.get(agree, i - 1)
        better = now > state["agreeing"]
        moved = F.struct(now.alias("now"), F.greatest(now, state["agreeing"]).alias("agreeing"), F.when(better, i).otherwise(state["at"]).alias("at"))
        return F.when(i == 0, state).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), F.size(agree) - width), start, step)


def contaminated(
    documents: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8, shortest: int = 1, masks: tuple = MASKS, five: tuple = FIVE, common: int = 16,
    doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, agreeing (words of the best stretch), compared, place."""
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), hashed_words(F.col(f"`{text}`")).alias("h"))
    items = materialise(items.where((F.size("h") >= max(1, shortest)) & F.col("item_id").isNotNull()).distinct())
    weight = min(map(len, masks))
    rows, held, short = items.agg(F.count("*"), F.coalesce(F.sum(F.size("h")), F.lit(0)), F.collect_set(F.when(F.size("h") <= max(weight, 5), F.size("h")))).first()  # at most five numbers
    whole = {n: (tuple(range(n)),) for n in short if n < weight} | {n: five for n in short if n == 5}
    keys = ["item_id", "n_words"]
    sized = items.select("item_id", F.size("h").alias("n_words"), "h")
    tests = seeds(sized.where(F.col("n_words") >= weight), keys, masks)
    for n, more in whole.items():
        tests = tests.unionByName(seeds(sized.where(F.col("n_words") == n), keys, more))
    tests = materialise(tests.withColumnRenamed("place", "item_place").distinct())
    every = (*masks, *(m for more in whole.values() for m in more))
    often = materialise(tests.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > common).select("seed"))
    many = often.count()
    few = broadcast_if_small(often, many, 2_000_000)
    # a common seed is one row without an item, whatever the number of its places
    marked = tests.join(few, "seed", "left_anti").unionByName(often.select(F.lit(0).alias("item_place"), "seed"), allowMissingColumns=True)
    found = seeds(docs.select("doc_id", hashed_words(F.col("text")).alias("h")), ["doc_id"], every).join(broadcast_if_small(marked, tests.count(), 2_000_000), "seed")
    found = found.select("doc_id", *keys, (F.col("place") - F.col("item_place")).alias("shift"), F.when(F.col("item_id").isNull(), F.col("seed")).alias("seed"))
    hits = materialise(found.distinct())
    if many:
        hot = hits.where("item_id is null").select("doc_id", "seed", F.col("shift").alias("place"))
        more = refined(hot, docs, tests.join(few, "seed", "left_semi"), sized, window, similarity, common)
        hits = materialise(hits.where("item_id is not null").drop("seed").unionByName(more).distinct())
    else:
        hits = hits.drop("seed")
    ids = hits.select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(ids, hits.count(), 2_000_000), "doc_id", "left_semi").select("doc_id", hashed_words(F.col("text")).alias("h"))
    kept = kept.groupBy("doc_id", F.xxhash64("h")).agg(F.first("h").alias("doc_h"))  # rows that repeat an id and its text are compared once
    first = F.greatest(F.lit(0), -F.col("shift"))  # the item's words that lie inside the document
    last = F.least(F.col("n_words"), F.size("doc_h") - F.col("shift"))
    width = F.least(F.lit(window), F.col("n_words"))
    near = hits.join(kept, "doc_id").where(last - first >= width)
    near = near.select("doc_id", "item_id", "shift", first.alias("first"), width.alias("compared"), F.slice("doc_h", first + F.col("shift") + 1, last - first).alias("part"))
    agree = F.zip_with(F.slice("h", F.col("first") + 1, F.size("part")), "part", lambda a, b: (a == b).cast("int"))
    judged = near.join(broadcast_if_small(items, rows, 100_000, nbytes=8 * held), "item_id").select("doc_id", "item_id", "compared", (F.col("first") + F.col("shift")).alias("begin"), agree.alias("agree"))
    scored = judged.withColumn("best", best_stretch(F.col("agree"), F.col("compared"))).where(F.col("best.agreeing") >= needed(F.col("compared"), similarity))
    best = F.max(F.struct("best.agreeing", (-(F.col("best.at") + F.col("begin"))).alias("place"), "compared"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("m")).select(
        "doc_id", "item_id", F.col("m.agreeing").cast("long").alias("agreeing"), F.col("m.compared").cast("long").alias("compared"), (-F.col("m.place")).cast("long").alias("place")
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
