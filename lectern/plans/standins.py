"""Learning tables derived from the star-schema tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table

MODULES = ("click", "view", "signup", "purchase", "error")


def _module(key: Column) -> Column:
    out = F.lit(MODULES[4])
    for i in range(4):
        out = F.when(key % 5 == i, MODULES[i]).otherwise(out)
    return out


def _presentation(key: Column) -> Column:
    return F.when(key % 2 == 0, "2013J").otherwise("2014B")


def clicks(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) - 5
    return e.select(
        F.col("user_id").alias("id_student"), F.col("event_type").alias("code_module"), _presentation(F.col("event_id")).alias("code_presentation"),
        F.get_json_object("props", "$.k").cast("int").alias("id_site"), F.when(F.col("event_id") % 50 != 0, day).alias("date"),
        (F.floor("value") % 20 + 1).cast("int").alias("sum_click"), "ts", "event_id",
    )


def definitions(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "Exam").when(k % 4 == 2, "CMA").otherwise("TMA")
    return table(spark, root, "orders").select(
        k.alias("id_assessment"), _module(k).alias("code_module"), _presentation(k).alias("code_presentation"), kind.alias("assessment_type"),
        F.when(k % 11 != 0, k % 60 - 5).cast("int").alias("date"), F.when(k % 13 != 0, (k % 7) * 5.0).alias("weight"),
    )


def submissions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("id_assessment"), (F.col("l_partkey") % 150).alias("id_student"),
        F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).alias("date_submitted"), (F.col("l_returnflag") == "R").cast("int").alias("is_banked"),
        F.when(F.col("l_partkey") % 17 != 0, F.least(F.lit(100.0), F.col("l_quantity") * 2)).alias("score"),
    )


def info(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, root, "orders").select((F.col("o_custkey") % 150).alias("id_student"), _module(k).alias("code_module"), _presentation(k).alias("code_presentation"), k, "o_custkey", "o_orderstatus")
    first = o.groupBy("id_student", "code_module", "code_presentation").agg(F.min_by(F.struct("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey").alias("o"))
    c = table(spark, root, "customer").join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = F.col("o.o_orderstatus")
    result = F.when(s == "O", "Withdrawn").when(s == "P", "Fail").when(F.col("o.o_orderkey") % 3 == 0, "Distinction").otherwise("Pass")
    return first.join(c, F.col("o.o_custkey") == F.col("c_custkey")).select(
        "id_student", "code_module", "code_presentation", F.col("c_mktsegment").alias("gender"), F.col("r_name").alias("region"), F.col("n_name").alias("highest_education"),
        F.when(F.col("o.o_orderkey") % 10 != 0, F.concat((F.col("o.o_orderkey") % 10 * 10).cast("string"), F.lit("%"))).alias("imd_band"), F.when(F.col("o.o_orderkey") % 4 == 0, "35-55").otherwise("0-35").alias("age_band"),
        F.when(F.col("o.o_orderkey") % 9 == 0, "Y").otherwise("N").alias("disability"), (F.col("o.o_orderkey") % 3).cast("int").alias("num_of_prev_attempts"), (F.col("o.o_orderkey") % 8 * 30).cast("int").alias("studied_credits"),
        result.alias("final_result"), F.col("o.o_orderkey").alias("source_key"), (F.col("o.o_orderkey") * 37 % 101 / 100.0).alias("risk"),
    )


def registration(spark: SparkSession, root: str) -> DataFrame:
    return info(spark, root).select("id_student", "code_module", "code_presentation", (-(F.col("source_key") % 100)).cast("int").alias("date_registration"), F.when(F.col("final_result") == "Withdrawn", F.col("source_key") % 200).cast("int").alias("date_unregistration"))


def mastery(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("id_site") % 3 == 0, "TMA").when(F.col("id_site") % 3 == 1, "CMA").otherwise("C1")
    return clicks(spark, root).select("id_student", "code_module", F.concat_ws("_", "code_module", kind).alias("skill_name"), F.col("event_id").alias("order_id"), (F.col("id_site") / 100.0).alias("p_known_after"), kind.alias("kind"))


def vectors(spark: SparkSession, root: str, users: bool) -> DataFrame:
    """(node, vector): the first fifth of vec_id are users, the rest items."""
    e = table(spark, root, "embeddings")
    side = F.col("vec_id") % 5 == 0
    return e.where(side if users else ~side).select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


_MODULE = "case k % 5 when 0 then 'click' when 1 then 'view' when 2 then 'signup' when 3 then 'purchase' else 'error' end"
SQL = f"""
with recursive clicks as (
  select user_id id_student, event_type code_module, case when event_id % 2 = 0 then '2013J' else '2014B' end code_presentation,
    regexp_extract(props, '[0-9]+')::int id_site, case when event_id % 50 <> 0 then (ts::date - date '2024-01-01')::int - 5 end "date",
    (floor(value)::bigint % 20 + 1)::int sum_click, ts, event_id from events
), defs as (
  select o_orderkey id_assessment, {_MODULE.replace("k %", "o_orderkey %")} code_module, case when o_orderkey % 2 = 0 then '2013J' else '2014B' end code_presentation,
    case when o_orderkey % 4 = 0 then 'Exam' when o_orderkey % 4 = 2 then 'CMA' else 'TMA' end assessment_type,
    case when o_orderkey % 11 <> 0 then (o_orderkey % 60 - 5)::int end "date", case when o_orderkey % 13 <> 0 then ((o_orderkey % 7) * 5)::double end weight from orders
), subs as (
  select l_orderkey id_assessment, l_partkey % 150 id_student, (l_shipdate::date - date '1995-01-01')::int date_submitted, (l_returnflag = 'R')::int is_banked,
    case when l_partkey % 17 <> 0 then least(100.0::double, l_quantity * 2) end score from lineitem
), firsts as (
  select o_custkey % 150 id_student, {_MODULE.replace("k %", "o_orderkey %")} code_module, case when o_orderkey % 2 = 0 then '2013J' else '2014B' end code_presentation, min(o_orderkey) k
  from orders group by 1, 2, 3
), info as (
  select id_student, code_module, code_presentation, c_mktsegment gender, r_name region, n_name highest_education,
    case when k % 10 <> 0 then (k % 10 * 10)::varchar || '%' end imd_band, case when k % 4 = 0 then '35-55' else '0-35' end age_band, case when k % 9 = 0 then 'Y' else 'N' end disability,
    (k % 3)::int num_of_prev_attempts, (k % 8 * 30)::int studied_credits,
    case o_orderstatus when 'O' then 'Withdrawn' when 'P' then 'Fail' else case when k % 3 = 0 then 'Distinction' else 'Pass' end end final_result, k source_key, (k * 37 % 101)::double / 100.0::double risk
  from firsts join orders on o_orderkey = k join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
), reg as (
  select id_student, code_module, code_presentation, (-(source_key % 100))::int date_registration, case when final_result = 'Withdrawn' then (source_key % 200)::int end date_unregistration from info
), mastery as (
  select id_student, code_module, code_module || '_' || case id_site % 3 when 0 then 'TMA' when 1 then 'CMA' else 'C1' end skill_name, event_id order_id, id_site::double / 100.0::double p_known_after,
    case id_site % 3 when 0 then 'TMA' when 1 then 'CMA' else 'C1' end kind from clicks
), vu as (select vec_id node, embedding::double[64] vector from embeddings where vec_id % 5 = 0),
vi as (select vec_id node, embedding::double[64] vector from embeddings where vec_id % 5 <> 0)
"""
