"""Aggregation, window, ranking and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import marts as M
from lectern.operators import sketches as SK
from lectern.plans import standins as S
from lectern.plans.book import Book, r6, rounded
from lectern.session import materialise, table

book = Book()
q = book.add


@q("A05_cohort_counts", "select 'gender' metric_name, gender category, count(*) \"count\" from info group by 2 union all select 'region', region, count(*) from info group by 2 union all select 'imd_band', imd_band, count(*) from info group by 2")
def _(spark, root):
    return M.cohort_counts(S.info(spark, root), ["gender", "region", "imd_band"])


@q("A06_daily_engagement", """select "date" period, count(*) "count", round(avg(c), 6) "value" from (select id_student, "date", sum(sum_click) c from clicks group by 1, 2) group by 1""")
def _(spark, root):
    return rounded(M.engagement(S.clicks(spark, root), F.col("date")), "value")


@q("A07_weekly_engagement", """select trunc("date" / 7)::int period, count(*) "count", round(avg(c), 6) "value" from (select id_student, trunc("date" / 7) w, any_value(trunc("date" / 7)::int * 7) "date", sum(sum_click) c from clicks group by 1, 2) group by 1""")
def _(spark, root):
    return rounded(M.engagement(S.clicks(spark, root), M.week(F.col("date"))), "value")


@q("A07_weekly_floor", """select w period, count(*) "count", round(avg(c), 6) "value" from (select id_student, floor("date" / 7)::int w, sum(sum_click) c from clicks group by 1, 2) group by 1""")
def _(spark, root):
    return rounded(M.engagement(S.clicks(spark, root), M.week(F.col("date"), floor=True)), "value")


@q("U02_cohort_stats", """select 'region' metric_name, region category, count(*)::int "count", count(*)::float "value" from info group by 2 union all select 'engagement_daily', "date"::varchar, count(*)::int, avg(c)::float from (select id_student, "date", sum(sum_click) c from clicks group by 1, 2) group by 2""")
def _(spark, root):
    regions = M.cohort_counts(S.info(spark, root), ["region"]).withColumn("value", F.col("count").cast("double"))
    daily = M.engagement(S.clicks(spark, root), F.col("date")).select(F.lit("engagement_daily").alias("metric_name"), F.col("period").cast("string").alias("category"), "count", "value")
    both = M.union_all([regions, daily])
    return both.withColumns({"count": F.col("count").cast("int"), "value": F.col("value").cast("float")})


@q("A11_mastery_pivot", """select code_module, round(coalesce(avg(p_known_after) filter (where kind = 'TMA'), 0), 6) "TMA", round(coalesce(avg(p_known_after) filter (where kind = 'CMA'), 0), 6) "CMA", 0.0::double "Exam" from mastery group by 1""")
def _(spark, root):
    p = M.mastery_pivot(S.mastery(spark, root), "code_module", "kind", ["TMA", "CMA", "Exam"], "p_known_after")
    return rounded(p, "TMA", "CMA", "Exam")


@q("A12_latest_mastery", "select id_student, skill_name, arg_max(p_known_after, order_id) mastery from mastery group by 1, 2")
def _(spark, root):
    return M.mastery_latest(S.mastery(spark, root), user="id_student")


@q("A12_mean_mastery", "select id_student, skill_name, round(avg(p_known_after), 6) mastery from mastery group by 1, 2")
def _(spark, root):
    return rounded(M.mastery_latest(S.mastery(spark, root), None, "id_student"), "mastery")


@q("A13_mastery_by_skill", "with l as (select id_student, skill_name, arg_max(p_known_after, order_id) m from mastery group by 1, 2) select id_student, coalesce(max(m) filter (where skill_name = 'click_TMA'), 0) \"click_TMA\", coalesce(max(m) filter (where skill_name = 'view_C1'), 0) \"view_C1\", 0.0::double absent from l group by 1")
def _(spark, root):
    return M.mastery_pivot(M.mastery_latest(S.mastery(spark, root), user="id_student"), "id_student", "skill_name", ["click_TMA", "view_C1", "absent"])


@q("A14_mean_risk_by_attribute", "select region, round(avg(risk) * 100, 6) mean_percent, count(*) \"count\" from info group by 1")
def _(spark, root):
    return rounded(M.mean_percent(S.info(spark, root), "region", "risk"), "mean_percent")


@q("A15_correlations", "select 'risk' x, 'risk' y, round(corr(risk, risk), 6) r from info union all select 'risk', 'studied_credits', round(corr(risk, studied_credits), 6) from info union all select 'risk', 'source_key', round(corr(risk, source_key), 6) from info union all select 'studied_credits', 'studied_credits', round(corr(studied_credits, studied_credits), 6) from info union all select 'studied_credits', 'source_key', round(corr(studied_credits, source_key), 6) from info union all select 'source_key', 'source_key', round(corr(source_key, source_key), 6) from info")
def _(spark, root):
    return rounded(M.correlations(S.info(spark, root), ["risk", "studied_credits", "source_key"]), "r")


@q("A16_histogram", "select least(floor(risk * 100 / 5)::int + 1, 20) bin, count(*) \"count\" from (select round(risk, 2) risk from info) group by 1")
def _(spark, root):
    return M.histogram(S.info(spark, root).withColumn("percent", F.round("risk", 2) * 100), "percent", 0.0, 100.0)


@q("A17_density", "select least(floor(value / 50)::int + 1, 10) x_bin, least(floor(event_id % 1000 / 100)::int + 1, 10) y_bin, count(*) \"count\" from events where value <= 500 group by 1, 2", plain=True)
def _(spark, root):
    return M.density(table(spark, root, "events").withColumn("place", (F.col("event_id") % 1000).cast("double")), ("value", 0.0, 500.0, 10), ("place", 0.0, 1000.0, 10))


@q("A18_box_statistics", """with s as (select event_type, min(value) low, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) median, quantile_cont(value, 0.75) q3, max(value) high from events group by 1)
select event_type, low, round(q1, 6) q1, round(median, 6) median, round(q3, 6) q3, high, (select count(*) from events e where e.event_type = s.event_type and (value < q1 - (q3 - q1) * 1.5 or value > q3 + (q3 - q1) * 1.5)) outliers from s""", plain=True)
def _(spark, root):
    return rounded(M.box_statistics(table(spark, root, "events"), "event_type", "value"), "q1", "median", "q3")


@q("A18_A26_A27_sketched", """with p as (select * from events where ts::date between date '2024-01-08' and date '2024-01-21') select event_type, count(*) "rows", min(value) low, max(value) high, count(distinct user_id) users, true as users_near, true as quantiles_near from p group by 1""", plain=True)
def _(spark, root):
    """Two weeks merged from daily sketches: counts are exact, learners within 3 %, and the share of values up to each estimated
    quantile within 3 % of its own (small groups have a value's share besides)."""
    events = table(spark, root, "events")
    mart = materialise(SK.daily(events, ["event_type"], "ts", "value", "user_id"))
    period = SK.merged(mart, ["event_type"], "2024-01-08", "2024-01-21")
    shares = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    found = materialise(period.select("event_type", "rows", "low", "high", SK.distinct().alias("about"), *[SK.quantile(s).alias(f"q{i}") for i, s in enumerate(shares)]))
    rows = events.where(F.to_date("ts").between("2024-01-08", "2024-01-21")).join(F.broadcast(found), "event_type")  # a row a kind of event
    upto = lambda c: F.avg(c.cast("int"))
    near = [(F.count("*") < 100) | ((upto(F.col("value") < F.col(f"q{i}")) <= s + 0.03) & (upto(F.col("value") <= F.col(f"q{i}")) >= s - 0.03)) for i, s in enumerate(shares)]
    exact = F.count_distinct("user_id")
    out = rows.groupBy("event_type", "rows", "low", "high", "about").agg(exact.alias("users"), (F.abs(F.col("about") - exact) <= F.greatest(F.lit(1.0), exact * 0.03)).alias("users_near"), *[n.alias(f"n{i}") for i, n in enumerate(near)])
    every = F.col("n0")
    for i in range(1, len(shares)):
        every = every & F.col(f"n{i}")
    return out.select("event_type", "rows", "low", "high", "users", "users_near", every.alias("quantiles_near"))


@q("A19_value_counts", "select case p_type when 'ECONOMY' then 'Cheap' when 'SMALL' then 'Cheap' when 'LARGE' then 'Big' else 'Other' end category, count(*) \"count\" from part group by 1", plain=True)
def _(spark, root):
    return M.value_counts(table(spark, root, "part"), "p_type", {"ECONOMY": "Cheap", "SMALL": "Cheap", "LARGE": "Big"})


@q("A20_fold_small", "with c as (select p_size::varchar category, count(*) n from part group by 1) select case when n < 0.02 * (select sum(n) from c) then 'Others' else category end category, sum(n)::bigint \"count\" from c group by 1", plain=True)
def _(spark, root):
    return M.fold_small(table(spark, root, "part").groupBy(F.col("p_size").cast("string").alias("category")).agg(F.count("*").alias("count")))


@q("A21_kpis", "select count(distinct id_student) students, round(avg(risk) * 100, 6) mean_risk, (select round(avg(p_known_after) * 100, 6) from mastery) mean_mastery from info")
def _(spark, root):
    return rounded(M.kpis(S.info(spark, root), S.mastery(spark, root).withColumnRenamed("p_known_after", "mastery")), "mean_risk", "mean_mastery")


@q("A23_positives", "select id_student, len(list(distinct id_site))::int n, list_sort(list(distinct id_site))[1] smallest from clicks group by 1")
def _(spark, root):
    return S.clicks(spark, root).groupBy("id_student").agg(F.array_sort(F.collect_set("id_site")).alias("s")).select("id_student", F.size("s").alias("n"), F.col("s")[0].alias("smallest"))


@q("A26_percentiles", "select round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99, quantile_disc(value, 0.99) p99_nearest, round(avg((event_type <> 'error')::int), 6) success_rate, count(*) requests from events", plain=True)
def _(spark, root):
    e = table(spark, root, "events").withColumn("ok", F.col("event_type") != "error")
    return rounded(M.percentiles(e, "value", "ok"), "p50", "p95", "p99", "success_rate")


@q("A27_distinct_listing", "select distinct code_module, skill_name from mastery")
def _(spark, root):
    return S.mastery(spark, root).select("code_module", "skill_name").distinct()


@q("T01_top_risk", "select source_key, risk from info order by risk desc, source_key limit 5")
def _(spark, root):
    return M.top_n(S.info(spark, root).select("source_key", "risk"), [F.desc("risk"), "source_key"], 5)


@q("T02_extremes", "with t as (select source_key, risk, 0 side, (row_number() over (order by risk desc, source_key))::int place from info qualify place <= 100), b as (select source_key, risk, 1 side, (row_number() over (order by risk, source_key))::int place from info qualify place <= 100) select * from t union all select * from b where source_key not in (select source_key from t)")
def _(spark, root):
    return M.extremes(S.info(spark, root).select("source_key", "risk"), "risk", "source_key")


@q("T03_top_regions", "select region, count(*) \"count\" from info group by 1 order by 2 desc, 1 limit 6")
def _(spark, root):
    return M.top_n(S.info(spark, root).groupBy("region").agg(F.count("*").alias("count")), [F.desc("count"), "region"], 6)


@q("T04_first_ids", "select distinct id_student from info order by 1 limit 10")
def _(spark, root):
    return M.top_n(S.info(spark, root).select("id_student").distinct(), ["id_student"], 10)


@q("T06_sample_by_hash")
def _(spark, root):
    return M.sample_by_hash(S.info(spark, root).select("source_key", "risk"), "source_key", 200)


@q("T06_sample_size", "select least(200, count(*)) n, least(200, count(*)) known, true same from info")
def _(spark, root):
    i = S.info(spark, root).select("source_key", "risk")
    sample, again = M.sample_by_hash(i, "source_key", 200), M.sample_by_hash(i.repartition(7), "source_key", 200)
    found = sample.join(again.select("source_key", F.lit(1).alias("again")), "source_key", "left").join(i.select("source_key", F.col("risk").alias("r")), "source_key")
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("risk") == F.col("r")).alias("known"), (F.count("again") == F.count("*")).alias("same"))


@q("W01_answer_order", """select id_student, max(rn)::int last_order, sum(rn * (id_assessment % 97))::bigint mark from (select id_student, id_assessment, row_number() over (partition by id_student order by date_submitted, id_assessment, score nulls first, is_banked) rn from subs) group by 1""")
def _(spark, root):
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("id_student").orderBy("date_submitted", "id_assessment", "score", "is_banked"))
    s = S.submissions(spark, root).withColumn("rn", rn)
    return s.groupBy("id_student").agg(F.max("rn").alias("last_order"), F.sum(F.col("rn") * (F.col("id_assessment") % 97)).alias("mark"))


@q("A25_event_counts", "select user_id, count(*) events, count(*) filter (where event_type = 'click') n_click, count(*) filter (where event_type = 'purchase') n_purchase from events group by 1", plain=True)
def _(spark, root):
    from lectern.operators.online import event_counts

    return event_counts(table(spark, root, "events"), ["click", "purchase"])


@q("A04_guarded_average", "select id_student, round(case when sum(coalesce(weight, 0)) > 0 then sum(score * coalesce(weight, 0)) / sum(coalesce(weight, 0)) end, 6) weighted_avg from subs join defs using (id_assessment) group by 1")
def _(spark, root):
    w = F.coalesce("weight", F.lit(0.0))
    j = S.submissions(spark, root).join(S.definitions(spark, root).select("id_assessment", "weight"), "id_assessment")
    return j.groupBy("id_student").agg(F.sum(F.col("score") * w).alias("s"), F.sum(w).alias("w")).select("id_student", r6(F.when(F.col("w") > 0, F.col("s") / F.col("w"))).alias("weighted_avg"))
