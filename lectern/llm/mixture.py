"""Temperature mixing of sources, realised as budgeted block permutations, as DataFrame functions only.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are), normalised.
The exponent is the largest at which the weights reach a target entropy, raised where a source would otherwise be
repeated more often than allowed. A token is a run of characters other than blanks, tabs and line ends.

Null sources are one source of their own. Documents without tokens, null texts among them, cost nothing and are in every
pass of their source. Repeated rows, and rows without an id, are documents each: a row's place in a pass is drawn from a
hash of all its columns and, where whole rows repeat, its number among them, so that no two share one, a budget ends at
one document, and the schedule is the same however files are split or read. An empty table gives an empty schedule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.session import broadcast_if_small, materialise, table

UNIT = float(1 << 53)


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int, doc: Column, epoch: Column) -> Column:
    """A row's place in a pass over its source: a number in [0, 1) from a hash, so that a re-run draws the same."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), doc), 11).cast("double") / F.lit(UNIT)


def row_hashes(columns: list[str]) -> list[Column]:
    """128 bits that stand for a whole row: which columns are null, and all values."""
    values = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values])
    return [F.xxhash64(F.lit(n), nulls, *values).alias(f"_h{n}") for n in (1, 2)]


def copies_of(rows: DataFrame, chunk: int = 4096) -> DataFrame:
    """Rows with a count `copies`, each as so many rows with a number of its own (`_nth`); long counts are dealt out in chunks."""
    starts = rows.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long")))).repartition("_h1", "_start")
    return starts.withColumn("_nth", F.explode(F.sequence("_start", F.least(F.col("_start") + chunk, F.col("copies")) - 1))).drop("_start", "copies")


def temperature(sources: DataFrame, budget: float, entropy_share: float, max_repeats: float, probes: int = 33, rounds: int = 6) -> float:
    """The exponent, found by bisection that narrows its bracket to one of probes - 1 parts in each round.

    sources(source, tokens). Each round is one aggregate over sources for all probed exponents, and returns a row for each.
    """
    live = sources.where("tokens > 0")
    n, total = live.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return 1.0
    target = entropy_share * math.log(n)

    def probe(low: float, high: float) -> list:
        grid = [low + (high - low) * i / (probes - 1) for i in range(probes)]
        share = live.select((F.col("tokens") / F.lit(float(total))).alias("p"), "tokens", F.explode(F.array(*[F.lit(x) for x in grid])).alias("exponent"))
        power = share.withColumn("w", F.pow("p", "exponent"))
        norms = power.groupBy("exponent").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wlogw"), F.max(F.col("w") / F.col("tokens")).alias("most"))
        return sorted((r["exponent"], math.log(r["z"]) - r["wlogw"] / r["z"], budget * r["most"] / r["z"]) for r in norms.collect())

    def bisect(holds_low) -> float:
        """The largest exponent at which holds_low, true towards 0, still holds; 0 where it never does."""
        low, high = 0.0, 1.0
        for _ in range(rounds):
            seen = probe(low, high)
            if holds_low(seen[-1]):
                return seen[-1][0]
            good = [x[0] for x in seen if holds_low(x)]
            low = max(good, default=seen[0][0])
            high = min(x[0] for x in seen if x[0] > low) if low < seen[-1][0] else low
        return low

    by_entropy = bisect(lambda x: x[1] >= target - 1e-12)
    by_repeats = 0.0 if probe(0.0, 1.0)[0][2] <= max_repeats else bisect(lambda x: x[2] > max_repeats) + (1.0 / (probes - 1)) ** rounds
    return min(1.0, max(by_entropy, by_repeats))


def mix_sources(documents: DataFrame, budget_share: float = 1.0, entropy_share: float = 0.97, max_repeats: float = 4.0, block_docs: int = 4096, seed: int = 11, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every scheduled copy of every document: the columns of documents, then n_tokens, epoch, mix_block, mix_order.

    The budget is budget_share of all tokens; source s is given weight(s) * budget of it, as whole passes over its
    documents and a last, partial one. Each pass is its own permutation, dealt into blocks of about block_docs documents;
    the partial pass takes whole blocks while they fit its budget, then documents of the next block in order while they
    fit. mix_order, in [0, 1), spreads each source's blocks evenly over the mixture, so that any prefix of it has about
    the target weights; sort by it to read the mixture. A column of documents with one of these names is kept as <name>_in.

    A document's copies follow from its own hash and two numbers of its source, so texts are never shuffled.
    """
    own = ("n_tokens", "target_weight", "epoch", "mix_block", "mix_order")
    key = F.struct(F.col(f"`{source}`").isNull().alias("none"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("name"))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("_row"), *row_hashes(documents.columns), key.alias("_source"), tokens_of(F.col(f"`{text}`")).alias("n_tokens"))
    hashes = ["_h1", "_h2"]
    keyed = materialise(rows.groupBy(*hashes, "_source", "n_tokens").agg(F.count("*").alias("copies")))
    repeated = materialise(keyed.where("copies > 1"))
    some = repeated.count()
    numbered = lambda df: df.withColumn("_doc", F.xxhash64(*hashes, "_nth")).drop(*hashes, "_nth")
    single = lambda df: numbered(df.withColumn("_nth", F.lit(0).cast("long")))
    slim = single(keyed.where("copies = 1").drop("copies"))
    if some:
        slim = materialise(slim.unionByName(numbered(copies_of(repeated))))
        few = broadcast_if_small(repeated.select(*hashes), some)
        alike = rows.join(few, hashes, "left_semi").groupBy(*hashes).agg(F.first("_row").alias("_row"), F.first("_source").alias("_source"), F.first("n_tokens").alias("n_tokens"), F.count("*").alias("copies"))
        rows = single(rows.join(few, hashes, "left_anti")).unionByName(numbered(copies_of(alike)))
    else:
        rows = single(rows)
    sources = materialise(slim.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    n_sources, total, docs = sources.agg(F.count("*"), F.sum("tokens"), F.sum("docs")).first()
    budget = (total or 0) * budget_share
    exponent = temperature(sources, budget, entropy_share, max_repeats)
    blocks = 1 << max(0, math.ceil(math.log2(max(1, (docs or 0) / block_docs))))
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent))).otherwise(0.0)
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    planned = sources.withColumn("target_weight", power / F.lit(norm)).withColumn("share", F.col("target_weight") * F.lit(budget))
    planned = planned.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens") + 1e-9)).otherwise(F.lit(1)).cast("int"))
    # less than a token left is no pass
    planned = materialise(planned.withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("share") - F.col("passes") * F.col("tokens") + 1e-6))))
    small = lambda df: broadcast_if_small(df, n_sources, 200_000)

    # the partial pass: whole blocks first, then the documents of the block that the budget ends in
    drawn = slim.join(small(planned.select("_source", "passes", "rest")), "_source").withColumn("u", draw(seed, F.col("_doc"), F.col("passes")))
    drawn = drawn.withColumn("block", F.least(F.floor(F.col("u") * blocks), F.lit(blocks - 1)))
    filled = drawn.groupBy("_source", "block").agg(F.sum("n_tokens").alias("in_block"), F.max("rest").alias("rest"))
    before = W.partitionBy("_source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = filled.withColumn("before", F.coalesce(F.sum("in_block").over(before), F.lit(0)))
    ends = ends.where("rest > 0 and before <= rest and before + in_block > rest").select("_source", "block", "before")
    inside = drawn.join(small(ends), ["_source", "block"])
    running = W.partitionBy("_source", "block").orderBy("u", "_doc").rowsBetween(W.unboundedPreceding, 0)
    fits = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).where("upto <= rest")
    cuts = ends.join(fits.groupBy("_source").agg(F.max("u").alias("u")), "_source", "left").select("_source", F.coalesce("u", F.col("block") / F.lit(float(blocks)) - F.lit(1 / UNIT)).alias("cut"))
    plan = materialise(planned.join(cuts, "_source", "left").select("_source", "target_weight", "passes", "tokens", "share", F.coalesce("cut", F.when(F.col("rest") > 0, 1.0).otherwise(-1.0)).alias("cut")))

    out = rows.join(small(plan), "_source")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes")))).withColumn("_u", draw(seed, F.col("_doc"), F.col("epoch")))
    out = out.where((F.col("epoch") < F.col("passes")) | ((F.col("_u") <= F.col("cut")) & (F.col("tokens") > 0)))
    block = F.least(F.floor(F.col("_u") * blocks), F.lit(blocks - 1))
    length = F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")).otherwise(F.lit(1.0))
    jitter = draw(seed + 1, F.xxhash64("_source.none", "_source.name", block), F.col("epoch"))
    at = (F.col("epoch") + (block + jitter) / F.lit(float(blocks))) / F.greatest(length, F.lit(1e-9))
    order = F.least(at, F.lit(1.0 - 2e-9)) + F.col("_u") * 1e-9
    kept = [F.col("_row").getField(c).alias(f"{c}_in" if c in own else c) for c in documents.columns]
    return out.select(*kept, "n_tokens", "target_weight", "epoch", (F.col("epoch").cast("long") * blocks + block).alias("mix_block"), order.alias("mix_order"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheduled = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return scheduled.select("doc_id", "source", "n_tokens", "target_weight", "epoch", "mix_block", "mix_order")


QUERIES = {"op9_mix_sources": op9_mix_sources}
