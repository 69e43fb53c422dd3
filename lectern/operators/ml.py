"""Splits, preparation, classifier, scoring, metrics and explanations."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators.ranges import running
from lectern.operators.recsys import numbering


def temporal_split(df: DataFrame, column: str = "code_presentation", test: str = "2014", label: str = "target_class", key: str = "id_student", seed: int = 42) -> DataFrame:
    """df with is_test: presentations of the test year, or, where there are none, about a fifth of each class by hash."""
    named = F.col(column).contains(test)
    if df.where(named).limit(1).count():
        return df.withColumn("is_test", F.coalesce(named, F.lit(False)))
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), label, key), F.lit(5)) == 0)


def group_split(df: DataFrame, user: str = "user_id", group: str = "course", share: int = 80, least: int = 5, seed: int = 42) -> DataFrame:
    """df with is_train: a share of users by hash, in groups with at least `least` users; elsewhere all."""
    sizes = df.groupBy(group).agg(F.count_distinct(user).alias("_users"))
    train = F.pmod(F.xxhash64(F.lit(seed), user), F.lit(100)) < share
    return df.join(sizes, group).withColumn("is_train", train | (F.col("_users") < least)).drop("_users")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row
    return df.join(weights, label)


def impute(df: DataFrame, numbers: list[str], labels: list[str]) -> DataFrame:
    """Numbers by their median, labels by their most frequent value, ties to the smaller."""
    medians = df.agg(*[F.percentile_approx(c, 0.5, 100_000).alias(c) for c in numbers], *[F.min(F.lit(0))]).first() if numbers else {}
    modes = {}
    for c in labels:
        best = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).first()
        modes[c] = best[c] if best else None
    fills = {c: medians[c] for c in numbers if medians[c] is not None} | {c: v for c, v in modes.items() if v is not None}
    return df.fillna(fills) if fills else df


def encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes by alphabetical order from 0; NULL is -1 (M04). Values are numbered by range partitions and offsets."""
    for c in columns:
        codes = numbering(df.select(c).where(F.col(c).isNotNull()).distinct(), c).select(c, F.col("index").cast("int").alias(f"{c}_code"))
        df = df.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return df


def classifier(numbers: list[str], labels: list[str], target: str = "target_class", kind: str = "logistic", seed: int = 42) -> Pipeline:
    """Imputation, encoding, assembly and a multiclass model as one Spark ML pipeline, weighted by `weight`."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep", stringOrderType="alphabetAsc") for c in labels]
    filled = Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}_in" for c in numbers])
    goal = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    parts = VectorAssembler(inputCols=[f"{c}_in" for c in numbers] + [f"{c}_ix" for c in labels], outputCol="features")
    model = LogisticRegression(weightCol="weight", maxIter=40, regParam=0.01) if kind == "logistic" else RandomForestClassifier(weightCol="weight", numTrees=40, maxDepth=6, maxBins=256, seed=seed)
    return Pipeline(stages=[filled, *index, goal, parts, model])


def scored(model: PipelineModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, prob_<class> for each class, predicted_class and at_risk_probability = P(Withdrawn) + P(Fail)."""
    names = next(s for s in model.stages if getattr(s, "getOutputCol", lambda: "")() == "label").labels
    # the label column is not needed to score
    stages = [s for s in model.stages if getattr(s, "getOutputCol", lambda: "")() != "label"]
    out = df
    for stage in stages:
        out = stage.transform(out)
    p = vector_to_array("probability")
    best = F.array(*[F.lit(n) for n in names])[F.array_position(p, F.array_max(p)).cast("int") - 1]
    risk = sum((p[i] for i, n in enumerate(names) if n in ("Withdrawn", "Fail")), F.lit(0.0))
    return out.select(*keys, *[p[i].alias(f"prob_{n}") for i, n in enumerate(names)], best.alias("predicted_class"), risk.alias("at_risk_probability"))


def _by_score(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Positives and rows at each distinct score, with running counts from the highest score down; ties are one step."""
    steps = df.groupBy(*group, score).agg(F.sum(F.col(label)).cast("double").alias("tp"), F.count("*").cast("double").alias("rows"))
    return running(steps, group, [F.desc(score)], ["tp", "rows"]).withColumnsRenamed({"rows_upto": "n_upto", "rows_all": "total", "tp_all": "positives"})


def average_precision(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Average precision per group, tied scores as one step."""
    at = _by_score(df, group, score, label)
    return at.groupBy(*group).agg(F.sum(F.when(F.col("positives") > 0, F.col("tp") / F.col("positives") * F.col("tp_upto") / F.col("n_upto"))).alias("average_precision"))


def roc_auc(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve per group, ties counting half; NULL for a single class."""
    at = _by_score(df, group, score, label)
    negatives = F.col("rows") - F.col("tp")
    below = F.col("total") - F.col("positives") - (F.col("n_upto") - F.col("tp_upto"))
    wins = F.sum(F.col("tp") * (below + negatives / 2))
    pairs = F.max(F.col("positives") * (F.col("total") - F.col("positives")))
    return at.groupBy(*group).agg(wins.alias("wins"), pairs.alias("pairs")).select(*group, F.when(F.col("pairs") > 0, F.col("wins") / F.col("pairs")).alias("auc"))


def class_report(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """precision, recall, f1 and support of each class."""
    cells = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    both = cells.select(F.explode(F.array(
        F.struct(F.col(truth).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
    )).alias("x")).select("x.*")
    summed = both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    precision, recall = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return summed.select("class", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), "support")


def contributions(df: DataFrame, key: list[str], coefficients: dict[str, float]) -> DataFrame:
    """(key, feature, contribution) of a linear score: coefficient * (value - mean)."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in coefficients])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.col(f"_m_{c}"))).alias("contribution")) for c, w in coefficients.items()])
    return df.crossJoin(F.broadcast(means)).select(*key, F.inline(rows))  # one row of means


def global_importance(contributed: DataFrame, n: int = 10) -> DataFrame:
    return contributed.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(n)


def local_top(contributed: DataFrame, key: list[str], n: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.abs("contribution")), "feature"))
    return contributed.withColumn("rank", rank).where(F.col("rank") <= n)


def gate(metrics: DataFrame, value: str, least: float) -> DataFrame:
    """Mean of a metric over groups, NULLs left out, and whether it passes."""
    return metrics.agg(F.avg(value).alias("value")).withColumn("passed", F.coalesce(F.col("value") >= least, F.lit(False)))


def metric_table(metrics: DataFrame, defaults: dict[tuple[str, str], float]) -> DataFrame:
    """(metric_type, key_name, value): measured ones, else the defaults."""
    spark = metrics.sparkSession
    base = spark.createDataFrame([(t, k, float(v)) for (t, k), v in defaults.items()], "metric_type string, key_name string, fallback double")
    return base.join(metrics, ["metric_type", "key_name"], "full").select("metric_type", "key_name", F.coalesce("value", "fallback").alias("value"))
