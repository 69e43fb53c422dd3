"""URL filter: host and path rules first, gradient-boosted trees on lexical features for every URL no rule fits.

Null and empty URLs, and those without ://, have an empty host and path and are judged by the trees like any other.
Repeated URLs are judged alike. With no labelled URL at all, or labels of one kind only, the unruled take that kind, or
allow. Only the id and url columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialise, table

# Fixed values: (verdict, rule); a rule is a host and a path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "has_fragment", "has_extension", "labels", "suffix_share", "suffix_blocked", "zone_share", "zone_blocked")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, from after the first :// up to / ? # or the end, and path, from there up to ? # or the end."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a URL and its verdict, both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, prefix = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Columns of lexical features for a table with url, host and path."""
    text = F.coalesce(lower_ascii(F.col(url)), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    times = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x) if isinstance(x, str) else x, F.lit("")))
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    share = lambda x: times(text, x) / size
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, x: s - F.when(x != "", share(x) * F.log2(share(x))).otherwise(0.0))
    return df.withColumns({
        "url_length": F.length(text).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": times(F.col("path"), "/").cast("double"), "digit_ratio": digits(text) / size, "host_digits": digits(F.col("host")).cast("double"),
        "hyphens": times(F.col("host"), "-").cast("double"), "entropy": entropy,
        "parameters": (times(text, "&") + F.when(text.contains("?"), 1).otherwise(0)).cast("double"),
        "has_fragment": text.contains("#").cast("double"), "has_extension": F.col("path").rlike(r"\.[a-z0-9]{1,5}$").cast("double"),
        "labels": times(F.col("host"), ".").cast("double"),
    })


def with_suffix_statistics(df: DataFrame, counted: DataFrame, suffix: str) -> DataFrame:
    """df with <suffix>_share, the suffix's share of URLs, and <suffix>_blocked, the share of block among its labelled ones.

    URLs fall in two halves by hash. A labelled one takes the numbers of the other half, so that no label tells of itself;
    one without a label takes those of both. The share of block is drawn towards the mean of all labels; a suffix that is
    not in those counts has a share of 0 and 0.5 blocked. counted holds the counts by suffix, zone and half.
    """
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    by = counted.groupBy(suffix, (1 - F.col("half")).alias("use")).agg(*sums).unionByName(counted.groupBy(suffix, F.lit(2).cast("long").alias("use")).agg(*sums))
    total = counted.agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    mean = F.coalesce(F.try_divide("all_blocked", "all_labelled"), F.lit(0.5))
    all_n = F.when(F.col("use") == 2, F.col("all_n")).otherwise(F.col("all_n") / 2)
    found = by.crossJoin(F.broadcast(total)).select(  # total is one row
        suffix, "use", (F.col("n") / all_n).alias(f"{suffix}_share"),
        ((F.coalesce("blocked", F.lit(0.0)) + 10 * mean) / (F.col("labelled") + 10)).alias(f"{suffix}_blocked"),
    )
    return df.join(found, [suffix, "use"], "left").fillna(0.0, [f"{suffix}_share"]).fillna(0.5, [f"{suffix}_blocked"])


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple = RULES, labelled: DataFrame | None = None, max_labelled: int = 20_000, trees: int = 12, depth: int = 4, threshold: float = 0.5, seed: int = 7) -> DataFrame:
    """All columns of pages and `host`, `path`, `rule`, `verdict`, `score`; a column of pages with one of these names is kept as <name>_in.

    The labelled URLs are labelled(url, label), label being 1 for block and 0 for allow; without that table, those that a
    rule fits. The trees learn from at most max_labelled distinct ones among pages, taken in the order of their hash, and
    judge every URL that no rule fits. score is the probability of block, null where the trees could not be trained.
    Suffix statistics are counted over all URLs.
    """
    own = ("host", "path", "rule", "verdict", "score")
    host, path = split_url(F.col(f"`{url}`"))
    parts = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url}`").alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "said": verdict})
    if labelled is None:
        ruled = ruled.withColumn("label", F.when(F.col("said") == "block", 1.0).when(F.col("said") == "allow", 0.0))
    else:
        known = labelled.where("url is not null and label in (0, 1)").groupBy("url").agg(F.max("label").cast("double").alias("label"))
        ruled = ruled.join(known, "url", "left")
    half = F.pmod(F.xxhash64("url"), F.lit(2))
    ruled = ruled.withColumns({
        "suffix": F.regexp_extract("host", r"[^.]+\.[^.]+$|^[^.]*$", 0), "zone": F.regexp_extract("host", r"[^.]*$", 0),
        "half": half, "use": F.when(F.col("label").isNull(), F.lit(2).cast("long")).otherwise(half),
    })
    counted = materialise(ruled.groupBy("suffix", "zone", "half").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum("label").alias("blocked")))
    sample = ruled.where("label is not null").groupBy("url").agg(*[F.max(c).alias(c) for c in ("label", "host", "path", "suffix", "zone", "use")])
    sample = described(sample.orderBy(F.xxhash64("url"), "url").limit(max_labelled), counted).select("label", *FEATURES)
    sample = materialise(sample.coalesce(4))  # at most max_labelled rows: the trees' many small jobs scan a few small files
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    train = assembler.transform(sample).select("label", "features").persist()
    kinds = sorted(r["label"] for r in train.select("label").distinct().collect())
    if len(kinds) < 2:
        default = "block" if kinds == [1.0] else "allow"
        out = ruled.withColumns({"verdict": F.coalesce("said", F.lit(default)), "score": F.lit(None).cast("double")})
    else:
        booster = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed)
        model = booster.fit(train)
        judged = model.transform(assembler.transform(described(ruled, counted))).withColumn("score", vector_to_array("probability")[1])
        out = judged.withColumn("verdict", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")))
    train.unpersist()
    return out.select(*[F.col("row").getField(c).alias(f"{c}_in" if c in own else c) for c in pages.columns], *own)


def described(df: DataFrame, counted: DataFrame) -> DataFrame:
    for suffix in ("suffix", "zone"):
        df = with_suffix_statistics(df, counted, suffix)
    return lexical(df)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op8_url_filter": op8_url_filter}
