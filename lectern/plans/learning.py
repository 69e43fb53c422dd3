"""Feature, join, knowledge-tracing, recommender and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import bkt as B
from lectern.operators import features as FT
from lectern.operators import marts as M
from lectern.operators import boosting, ml, ranking
from lectern.operators import recsys as R
from lectern.operators.ranges import placed
from lectern.plans import standins as S
from lectern.plans.book import Book, r6, rounded
from lectern.session import materialise, table

book = Book()
q = book.add

_VLE = """select id_student, code_module, code_presentation, sum(sum_click)::bigint total_clicks, count(distinct "date") active_days, round(avg(sum_click), 6) avg_daily_clicks,
  max(sum_click) max_clicks_day, min("date") first_activity, max("date") last_activity, round(sum(case when "date" > 8 then sum_click end) / 7.0::double, 6) recent_weekly_rate,
  max("date") - min("date") engagement_span, 15 - max("date") recency_days, round(coalesce(sum(case when "date" > 8 then sum_click end) / 7.0::double, 0) - avg(sum_click), 6) engagement_momentum
  from clicks where "date" <= 15 group by 1, 2, 3"""
_ASSESS = """select id_student, d.code_module, d.code_presentation, round(avg(score), 6) avg_score, min(score) min_score, count(*) submission_count, sum(is_banked)::bigint late_submissions,
  round(case when sum(coalesce(weight, 0)) > 0 then sum(score * coalesce(weight, 0)) / sum(coalesce(weight, 0)) end, 6) weighted_avg
  from subs left join defs d using (id_assessment) where d."date" is null or d."date" <= 30 group by 1, 2, 3"""


@q("A01_vle_features", _VLE)
def vle(spark, root):
    return rounded(FT.vle_features(S.clicks(spark, root), 15), "avg_daily_clicks", "recent_weekly_rate", "engagement_momentum")


@q("A02_recent_weekly_rate", """select id_student, code_module, round(sum(sum_click) / 7.0::double, 6) recent_weekly_rate from clicks where "date" > 8 and "date" <= 15 group by 1, 2""")
def _(spark, root):
    f = FT.vle_features(S.clicks(spark, root), 15, ["id_student", "code_module"])
    return f.where("recent_weekly_rate is not null").select("id_student", "code_module", r6("recent_weekly_rate").alias("recent_weekly_rate"))


@q("A03_A04_assessment_features", _ASSESS)
def _(spark, root):
    return rounded(FT.assessment_features(S.submissions(spark, root), S.definitions(spark, root)), "avg_score", "weighted_avg")


@q("J01_at_risk_features", f"""with v as ({_VLE}), a as ({_ASSESS})
select id_student, code_module, code_presentation, coalesce(gender, 'Unknown') gender, region, coalesce(imd_band, 'Unknown') imd_band, date_registration, date_unregistration,
  coalesce(total_clicks, 0) total_clicks, coalesce(active_days, 0) active_days, coalesce(recent_weekly_rate, 0) recent_weekly_rate, coalesce(recency_days, 0) recency_days, coalesce(avg_score, 0) avg_score,
  coalesce(submission_count, 0) submission_count, coalesce(weighted_avg, 0) weighted_avg, case when final_result in ('Pass', 'Distinction') then 'Success' else final_result end target_class, (final_result in ('Withdrawn', 'Fail'))::int is_at_risk
from info left join reg using (id_student, code_module, code_presentation) left join v using (id_student, code_module, code_presentation) left join a using (id_student, code_module, code_presentation)""")
def at_risk(spark, root):
    f = FT.at_risk_features(S.info(spark, root), S.registration(spark, root), S.clicks(spark, root), S.submissions(spark, root), S.definitions(spark, root), cutoff=15, due_cutoff=30)
    return rounded(f.select(*FT.KEYS, "gender", "region", "imd_band", "date_registration", "date_unregistration", "total_clicks", "active_days", "recent_weekly_rate", "recency_days", "avg_score", "submission_count", "weighted_avg", "target_class", "is_at_risk"), "recent_weekly_rate", "avg_score", "weighted_avg")


@q("J03_submissions_with_definitions", """select d.assessment_type, count(*) n, count(d.id_assessment) matched, round(sum(score), 6) total from subs left join defs d using (id_assessment) group by 1""")
def _(spark, root):
    d = S.definitions(spark, root).select("id_assessment", "assessment_type", F.lit(1).alias("known"))
    j = S.submissions(spark, root).join(d, "id_assessment", "left")
    return j.groupBy("assessment_type").agg(F.count("*").alias("n"), F.count("known").alias("matched"), r6(F.sum("score")).alias("total"))


@q("J05_theta_residual", """with p as (select id_student u, id_site i, sum(sum_click) c from clicks group by 1, 2), m as (select i, quantile_disc(c, 0.5) m from p group by 1) select u "user", i item, c clicks from p join m using (i) where c >= m""")
def _(spark, root):
    return R.denoised(R.interactions(S.clicks(spark, root)))


@q("A08_interactions", """select id_student "user", id_site item, sum(sum_click)::bigint clicks from clicks group by 1, 2""")
def _(spark, root):
    return R.interactions(S.clicks(spark, root))


@q("A09_item_medians", """with p as (select id_student u, id_site i, sum(sum_click) c from clicks group by 1, 2) select i item, quantile_disc(c, 0.5)::bigint median_clicks from p group by 1""")
def _(spark, root):
    return R.interactions(S.clicks(spark, root)).groupBy("item").agg(F.percentile_approx("clicks", 0.5, 100_000).alias("median_clicks"))


@q("M12_bkt_input", """with g as (select id_student user_id, code_module || '_' || assessment_type skill_name, (score >= 50)::int correct, date_submitted, id_assessment, score from subs join defs d using (id_assessment) where assessment_type <> 'Exam' and score is not null)
select user_id, skill_name, count(*) n, sum(correct)::bigint correct, max(rn) last_order from (select *, row_number() over (partition by user_id, skill_name order by date_submitted, id_assessment, score) rn from g) group by 1, 2""")
def _(spark, root):
    g = B.answers(S.submissions(spark, root), S.definitions(spark, root))
    return g.groupBy("user_id", "skill_name").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"), F.max("order_id").cast("long").alias("last_order"))


_GRADED = """g as (select user_id, event_type skill_name, (value >= 40)::int correct, row_number() over (partition by user_id, event_type order by ts, event_id) order_id from events)"""


def graded(spark, root):
    e = table(spark, root, "events").select("user_id", F.col("event_type").alias("skill_name"), (F.col("value") >= 40).cast("int").alias("correct"), "ts", "event_id")
    return placed(e, B.KEYS, ["ts", "event_id"]).select(*B.KEYS, "correct", (F.col("place") + 1).cast("int").alias("order_id"))


_TRACE = f"""{_GRADED}, t as (
  select user_id, skill_name, order_id, correct, 0.4::double b from g where order_id = 1
  union all
  select g.user_id, g.skill_name, g.order_id, g.correct, case when t.correct = 1 then t.b * 0.9::double / (t.b * 0.9::double + (1 - t.b) * 0.2::double) + (1 - t.b * 0.9::double / (t.b * 0.9::double + (1 - t.b) * 0.2::double)) * 0.15::double
     else t.b * 0.1::double / (t.b * 0.1::double + (1 - t.b) * 0.8::double) + (1 - t.b * 0.1::double / (t.b * 0.1::double + (1 - t.b) * 0.8::double)) * 0.15::double end
  from t join g on g.user_id = t.user_id and g.skill_name = t.skill_name and g.order_id = t.order_id + 1)"""


@q("M14_bkt_trace", f"""with {_TRACE}
select user_id, skill_name, order_id::int order_id, correct answer, round(b, 6) p_known_before, round(b * 0.9::double + (1 - b) * 0.2::double, 6) p_correct from t""")
def _(spark, root):
    return rounded(B.predict(graded(spark, root)).drop("p_known_after"), "p_known_before", "p_correct")


@q("M13_bkt_fit")
def _(spark, root):
    return B.fit(graded(spark, root), rounds=5)


@q("M09_bkt_auc", f"""with {_TRACE}, r as (select skill_name g, b * 0.9::double + (1 - b) * 0.2::double score, correct label from t), d as (select g, round(score, 9) score, label from r), s as (select g, score, sum(label)::double tp, count(*)::double n from d group by 1, 2),
c as (select *, sum(tp) over w tpu, sum(n) over w nu, sum(tp) over (partition by g) p, sum(n) over (partition by g) a from s window w as (partition by g order by score desc))
select g skill_name, round(sum(tp * ((a - p) - (nu - tpu) + (n - tp) / 2)) / max(p * (a - p)), 6) auc from c group by 1""")
def _(spark, root):
    # rounded scores, so that equal traces tie whatever order their factors were multiplied in
    p = B.predict(graded(spark, root)).select("skill_name", F.round("p_correct", 9).alias("score"), F.col("answer").alias("label"))
    return rounded(ml.roc_auc(p, ["skill_name"]), "auc")


_EDGES = """e as (select distinct id_student u, id_site i from clicks)"""


def edges(spark, root):
    return R.interactions(S.clicks(spark, root)).select("user", "item")


@q("A22_degrees", f"""with {_EDGES} select 'user' kind, u::bigint node, count(*) degree from e group by u union all select 'item', i, count(*) from e group by i""")
def _(spark, root):
    return R.degrees(edges(spark, root)).select("kind", F.col("node").cast("long").alias("node"), "degree")


@q("M16_normalised_graph", f"""with {_EDGES}, du as (select u, count(*) d from e group by 1), di as (select i, count(*) d from e group by 1) select u "user", i item, round(1 / sqrt(du.d * di.d), 6) weight from e join du using (u) join di using (i)""")
def _(spark, root):
    return rounded(R.normalised(edges(spark, root)), "weight")


@q("M17_propagated", f"""with {_EDGES}, du as (select u, count(*) d from e group by 1), di as (select i, count(*) d from e group by 1), w as (select u, i, 1 / sqrt(du.d * di.d) w from e join du using (u) join di using (i)),
u0 as (select distinct u, (u % 7 + 1)::double / 10 x, (u % 3)::double / 10 y from e), i0 as (select distinct i, (i % 5 + 1)::double / 10 x, (i % 4)::double / 10 y from e),
u1 as (select u, sum(w * x) x, sum(w * y) y from w join i0 using (i) group by 1), i1 as (select i, sum(w * x) x, sum(w * y) y from w join u0 using (u) group by 1),
u2 as (select u, sum(w * x) x, sum(w * y) y from w join i1 using (i) group by 1)
select u node, round((u0.x + u1.x + u2.x) / 3, 6) x, round((u0.y + u1.y + u2.y) / 3, 6) y from u0 join u1 using (u) join u2 using (u)""")
def _(spark, root):
    e = edges(spark, root)
    vec = lambda c, a, b: e.select(F.col(c).alias("node")).distinct().withColumn("vector", F.array((F.col("node") % a + 1) / F.lit(10.0), (F.col("node") % b) / F.lit(10.0)))
    users, _ = R.propagate(R.normalised(e), vec("user", 7, 3), vec("item", 5, 4), 2, layers=2)
    return users.select("node", r6(F.col("vector")[0]).alias("x"), r6(F.col("vector")[1]).alias("y"))


_TOP = """select u.node "user", i.node item, list_dot_product(u.vector, i.vector) s from vu u, vi i"""


@q("J12_W02_top_k", f"""select "user", item, round(s, 6) score, rn::int rank from (select *, row_number() over (partition by "user" order by s desc, item) rn from ({_TOP.replace("list_dot_product", "array_inner_product")})) where rn <= 5""")
def _(spark, root):
    return rounded(R.top_k(S.vectors(spark, root, True), S.vectors(spark, root, False), 5), "score")


@q("M21_W11_match_percent", """select "user", item, round(s, 4) score, rn::int rank from (select *, row_number() over (partition by "user" order by s desc, item) rn from (select u.node "user", i.node item, least(greatest((array_inner_product(u.vector, i.vector) / (sqrt(array_inner_product(u.vector, u.vector)) * sqrt(array_inner_product(i.vector, i.vector)) + 1e-9) + 1) * 50, 0), 100) s from vu u, vi i)) where rn <= 5""")
def _(spark, root):
    top = R.top_k(S.vectors(spark, root, True), S.vectors(spark, root, False), 5, score="match")
    return top.withColumn("score", F.round("score", 4))


_SEEN = """c as (select distinct user_id * 5 % 500 u, event_id % 400 i from events where event_type = 'click')"""


@q("J19_masked_top_k", f"""with {_SEEN} select "user", item, rn::int rank from (select *, row_number() over (partition by "user" order by s desc, item) rn from (select u.node "user", i.node item, array_inner_product(u.vector, i.vector) s from vu u, vi i where not exists (select 1 from c where c.u = u.node and c.i = i.node))) where rn <= 3""")
def _(spark, root):
    # what a learner clicked is not recommended again; clicks name users and items by their vec_id
    clicked = table(spark, root, "events").where("event_type = 'click'").select((F.col("user_id") * 5 % 500).alias("user"), (F.col("event_id") % 400).alias("item"))
    return R.top_k(S.vectors(spark, root, True), S.vectors(spark, root, False), 3, exclude=clicked).select("user", "item", "rank")


@q("M19_recall_ndcg", """with r as (select u "user", i item, row_number() over (partition by u order by c desc, i) rank from (select id_student u, id_site i, sum(sum_click) c from clicks group by 1, 2)), h as (select distinct id_student u, id_site i from clicks where code_module = 'purchase')
select round(avg((rank is not null)::int), 6) recall, round(avg(case when rank is not null then 1 / log2(rank + 1) else 0 end), 6) ndcg, count(*) pairs from h left join (select * from r where rank <= 10) r on r."user" = h.u and r.item = h.i""")
def _(spark, root):
    from pyspark.sql import Window as W

    c = S.clicks(spark, root)
    ranked = R.interactions(c).withColumn("rank", F.row_number().over(W.partitionBy("user").orderBy(F.desc("clicks"), "item")))
    held = c.where("code_module = 'purchase'").select(F.col("id_student").alias("user"), F.col("id_site").alias("item")).distinct()
    return rounded(R.recall_ndcg(ranked, held), "recall", "ndcg")


@q("M18_als_embeddings")
def _(spark, root):
    users, items = R.base_embeddings(edges(spark, root), size=8, iterations=3)
    return users.select(F.lit("user").alias("kind"), "node", "vector").unionByName(items.select(F.lit("item").alias("kind"), "node", "vector"))


@q("M18_embedded_nodes", f"""with {_EDGES} select 'user' kind, count(distinct u) nodes, 8 size from e union all select 'item', count(distinct i), 8 from e""")
def _(spark, root):
    users, items = R.base_embeddings(edges(spark, root), size=8, iterations=3)
    count = lambda k, d: d.agg(F.count_distinct("node").alias("nodes"), F.max(F.size("vector")).alias("size")).select(F.lit(k).alias("kind"), "nodes", "size")
    return count("user", users).unionByName(count("item", items))


# vectors, and an item as the negative of each pair, that SQL can state too
_START = """du as (select u, count(*) d from e group by 1), di as (select i, count(*) d from e group by 1), w as (select u, i, 1 / sqrt(du.d * di.d) w from e join du using (u) join di using (i)),
dims as (select unnest([0, 1, 2]) k), u0 as (select u node, k, ((u * (k + 2)) % 7 - 3)::double / 10 x from du, dims), i0 as (select i node, k, ((i * (k + 3)) % 5 - 2)::double / 10 x from di, dims),
t as (select e.u, e.i, n.i neg from e join di n on n.i = (select max(i) from di) - (e.i % 4) union all select e.u, e.i, n.i from e join di n on n.i = (select min(i) from di) + (e.u % 3))"""
_LAYER = """{a}1 as (select node, k, (x + coalesce(y, 0)) / 2 x from {a}0 left join (select w.u node, k, sum(w * x) y from w join {b}0 on {b}0.node = w.i group by 1, 2) using (node, k)), {b}1 as (select node, k, (x + coalesce(y, 0)) / 2 x from {b}0 left join (select w.i node, k, sum(w * x) y from w join {a}0 on {a}0.node = w.u group by 1, 2) using (node, k))"""


@q("M18_ranking_gradients", f"""with {_EDGES}, {_START}, {_LAYER.format(a="u", b="i")},
s as (select t.u, t.i, neg, sum(a.x * (p.x - n.x)) x from t join u1 a on a.node = t.u join i1 p on p.node = t.i and p.k = a.k join i1 n on n.node = neg and n.k = a.k group by 1, 2, 3),
c as (select *, -1 / (1 + exp(x)) / (select count(*) from s) c from s),
gu0 as (select node, k, coalesce(y, 0) x from u0 left join (select c.u node, p.k, sum(c * (p.x - n.x)) y from c join i1 p on p.node = c.i join i1 n on n.node = neg and n.k = p.k group by 1, 2) using (node, k)),
gi0 as (select node, k, coalesce(y, 0) x from i0 left join (select node, k, sum(y) y from (select c.i node, a.k, c * a.x y from c join u1 a on a.node = c.u union all select neg, a.k, -c * a.x from c join u1 a on a.node = c.u) group by 1, 2) using (node, k)),
{_LAYER.format(a="gu", b="gi")}
select 'loss' kind, 0::bigint node, 0 k, round(avg(ln(1 + exp(-x))), 6) "value" from s union all select 'user', node, k, round(x, 6) + 0 from gu1 union all select 'item', node, k, round(x, 6) + 0 from gi1""")
def _(spark, root):
    """Loss and gradients of one step from stated vectors and negatives, carried back through one layer."""
    e = materialise(edges(spark, root))
    side = lambda c, shift, m, mid: e.select(F.col(c).alias("node")).distinct().withColumn("vector", F.array(*[((F.col("node") * (k + shift)) % m - mid) / F.lit(10.0) for k in range(3)]))
    users, items = side("user", 2, 7, 3), side("item", 3, 5, 2)
    low, high = e.agg(F.min("item"), F.max("item")).first()
    known = items.select(F.col("node").alias("negative"))
    drawn = e.withColumn("negative", F.lit(high) - F.col("item") % 4).unionByName(e.withColumn("negative", F.lit(low) + F.col("user") % 3)).join(known, "negative", "left_semi")
    # triples that repeat count once, as in SQL
    loss, to_users, to_items = ranking.gradients(R.normalised(e), users, items, drawn.distinct(), 3, 1)
    long = lambda kind, g: g.select(F.lit(kind).alias("kind"), F.col("node").cast("long").alias("node"), F.posexplode("vector").alias("k", "value"))
    first = e.limit(1).select(F.lit("loss").alias("kind"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("k"), F.lit(loss).alias("value"))
    return M.union_all([first, long("user", to_users), long("item", to_items)]).withColumn("value", F.round("value", 6) + 0.0)


@q("M18_M19_trained_recall", f"""with {_EDGES} select count(*) pairs, true as fell from (select u from e group by 1 having count(*) > 1)""")
def _(spark, root):
    """Vectors trained on all pairs but one a user; that one is looked for among the user's ten best items. The loss falls."""
    split = materialise(R.hold_out(edges(spark, root)))
    train, held = split.where("not held_out"), split.where("held_out")
    users, items, losses = ranking.trained(train, size=8, layers=2, epochs=3, rate=0.05)
    fell = F.lit(all(b < a for a, b in zip(losses, losses[1:], strict=False)))
    return ranking.recall_gate(users, items, train, held).select("pairs", fell.alias("fell"))


@q("W03_hold_out", f"""with {_EDGES} select u "user", (count(*) > 1)::int held_out, count(*) pairs from e group by 1""")
def _(spark, root):
    h = R.hold_out(edges(spark, root))
    return h.groupBy("user").agg(F.sum(F.col("held_out").cast("int")).cast("int").alias("held_out"), F.count("*").alias("pairs"))


@q("J18_negative_samples")
def _(spark, root):
    return R.negative_samples(edges(spark, root))


@q("J18_negative_counts", f"""with {_EDGES}, n as (select count(distinct i) items from e), d as (select u, count(*) k from e group by 1) select u "user", k pairs, case when k < items then k else 0 end negatives, 0::bigint edges from d, n""")
def _(spark, root):
    e = edges(spark, root)
    drawn = R.negative_samples(e)
    known = e.select("user", F.col("item").alias("negative"), F.lit(1).alias("known"))
    by = drawn.join(known, ["user", "negative"], "left").groupBy("user").agg(F.count("*").alias("negatives"), F.count("known").alias("edges"))
    pairs = e.groupBy("user").agg(F.count("*").alias("pairs"))
    return pairs.join(by, "user", "left").fillna(0, ["negatives", "edges"]).select("user", "pairs", "negatives", "edges")


@q("J11_numbering", """select i item, (row_number() over (order by i) - 1)::bigint "index" from (select distinct id_site i from clicks)""")
def _(spark, root):
    return R.numbering(S.clicks(spark, root).select(F.col("id_site").alias("item")).distinct(), "item").withColumn("index", F.col("index").cast("long"))


@q("J06_reidentified", """select source_key, sha256(id_student::varchar) student_id_hash, id_student, m.education highest_education from info join (select id_student, min(highest_education) education from info group by 1) m using (id_student)""")
def _(spark, root):
    i = S.info(spark, root)
    p = i.select("source_key", F.sha2(F.col("id_student").cast("string"), 256).alias("student_id_hash"))
    return M.reidentified(p, i.select("id_student", "highest_education"))


@q("J07_merged", """select id_student, code_module, code_presentation, i.risk, i.source_key, r.source_key source_key_feat from info i join (select id_student, code_module, code_presentation, source_key % 7 source_key from info) r using (id_student, code_module, code_presentation)""")
def _(spark, root):
    i = S.info(spark, root)
    return M.merged(i.select(*FT.KEYS, "risk", "source_key"), i.select(*FT.KEYS, (F.col("source_key") % 7).alias("source_key")), FT.KEYS)


@q("J08_with_metadata", """select id_site item, coalesce(max(case when p_size > 25 then lower(p_type) end), 'resource') "type" from (select distinct id_site from clicks) left join part on p_partkey = id_site group by 1""")
def _(spark, root):
    items = S.clicks(spark, root).select(F.col("id_site").cast("long").alias("item")).distinct()
    meta = table(spark, root, "part").where("p_size > 25").select(F.col("p_partkey").alias("item"), F.lower("p_type").alias("type"))
    return M.with_metadata(items, meta, "item").select(F.col("item").cast("int").alias("item"), "type")


@q("J09_semi_join", "select count(*) n from subs where id_assessment in (select id_assessment from defs where code_module = 'view')")
def _(spark, root):
    return S.submissions(spark, root).join(S.definitions(spark, root).where("code_module = 'view'"), "id_assessment", "left_semi").agg(F.count("*").alias("n"))


@q("J10_anti_join", "select count(*) n from subs where id_assessment not in (select id_assessment from defs where code_module = 'view')")
def _(spark, root):
    return S.submissions(spark, root).join(S.definitions(spark, root).where("code_module = 'view'"), "id_assessment", "left_anti").agg(F.count("*").alias("n"))


@q("J13_share_of_total", "select code_module, round(sum(sum_click) / sum(sum(sum_click)) over (), 6) share from clicks group by 1")
def _(spark, root):
    by = S.clicks(spark, root).groupBy("code_module").agg(F.sum("sum_click").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select("code_module", r6(F.col("n") / F.col("total")).alias("share"))  # one row


@q("J14_feature_as_of", """select q.event_id query_id, q.user_id, arg_max(f.value, (f.ts, f.event_id)) "value" from (select * from events where event_type = 'purchase') q left join (select * from events where event_type = 'view') f on f.user_id = q.user_id and f.ts <= q.ts and f.ts >= q.ts - interval 3 day group by 1, 2""", plain=True)
def _(spark, root):
    e = table(spark, root, "events")
    queries = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("event_time"), F.col("event_id").alias("query_id"))
    features = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("event_time"), "value", F.col("event_id").alias("created"))
    return FT.feature_as_of(queries, features, ["user_id"], ttl_days=3).select("query_id", "user_id", "value")


@q("J17_peers", "select count(*) n, round(avg(risk), 6) mean_risk from info where id_student <> 7")
def _(spark, root):
    return M.peers(S.info(spark, root), 7).agg(F.count("*").alias("n"), r6(F.avg("risk")).alias("mean_risk"))


@q("M01_temporal_split", "select contains(code_presentation, '2014') is_test, count(*) n from info group by 1")
def _(spark, root):
    return ml.temporal_split(S.info(spark, root), label="final_result").groupBy("is_test").agg(F.count("*").alias("n"))


@q("M01_stratified_fallback", "select final_result, count(*) n, true as \"near\", true as \"same\" from info group by 1")
def _(spark, root):
    """Without a presentation of the test year about a fifth of each class is held out, the same rows each time."""
    rows = S.info(spark, root)
    split = lambda df: ml.temporal_split(df, test="1999", label="final_result", key="source_key").select("source_key", "final_result", "is_test")
    again = split(rows.repartition(5)).select("source_key", F.col("is_test").alias("again"))
    by = split(rows).join(again, "source_key").groupBy("final_result").agg(F.count("*").alias("n"), F.avg(F.col("is_test").cast("int")).alias("share"), F.min(F.col("is_test") == F.col("again")).alias("same"))
    # five standard deviations of a fifth
    return by.select("final_result", "n", (F.abs(F.col("share") - 0.2) <= 5 * F.sqrt(0.16 / F.col("n"))).alias("near"), "same")


@q("M02_group_split")
def _(spark, root):
    return ml.group_split(S.info(spark, root).select(F.col("id_student").alias("user_id"), F.col("code_module").alias("course"))).groupBy("course", "is_train").agg(F.count_distinct("user_id").alias("users"))


@q("M02_group_users", """select code_module course, count(distinct id_student) users, 0::bigint "both", count(*) "rows" from info group by 1""")
def _(spark, root):
    split = ml.group_split(S.info(spark, root).select(F.col("id_student").alias("user_id"), F.col("code_module").alias("course")))
    by = split.groupBy("course", "user_id").agg(F.count_distinct("is_train").alias("sides"), F.count("*").alias("n"))
    return by.groupBy("course").agg(F.count("*").alias("users"), F.count_if(F.col("sides") > 1).alias("both"), F.sum("n").alias("rows"))


@q("M03_impute", """with m as (select quantile_disc("date", 0.5) d from defs), o as (select assessment_type t from defs where id_assessment % 5 <> 0 group by 1 order by count(*) desc, 1 limit 1) select id_assessment, coalesce("date", m.d) "date", case when id_assessment % 5 <> 0 then assessment_type else o.t end kind from defs, m, o""")
def _(spark, root):
    d = S.definitions(spark, root).select("id_assessment", "date", F.when(F.col("id_assessment") % 5 != 0, F.col("assessment_type")).alias("kind"))
    return ml.impute(d, ["date"], ["kind"])


@q("M04_encode", """select id_student, code_module, code_presentation, imd_band, case when imd_band is null then -1 else (dense_rank() over (partition by imd_band is null order by imd_band) - 1)::int end imd_band_code from info""")
def _(spark, root):
    return ml.encode(S.info(spark, root).select(*FT.KEYS, "imd_band"), ["imd_band"])


@q("M05_class_weights", "select final_result, round((select count(*) from info)::double / (4 * count(*)), 6) weight from info group by 1")
def _(spark, root):
    return ml.class_weights(S.info(spark, root), "final_result").select("final_result", r6("weight").alias("weight")).distinct()


@q("M06_M07_classifier")
def _(spark, root):
    f = at_risk(spark, root).where("target_class is not null")
    f = ml.temporal_split(f)
    numbers, labels = ["total_clicks", "active_days", "recent_weekly_rate", "recency_days", "avg_score", "submission_count", "weighted_avg"], ["region", "imd_band"]
    numeric = materialise(f.select(*FT.KEYS, *labels, *[F.col(c).cast("double").alias(c) for c in numbers], "target_class", "is_test"))  # read many times by the fit
    model = ml.classifier(numbers, labels).fit(ml.class_weights(numeric.where("not is_test"), "target_class"))
    return ml.scored(model, numeric, FT.KEYS)


_NUMBERS, _LABELS = ["total_clicks", "active_days", "recent_weekly_rate", "recency_days", "avg_score", "submission_count", "weighted_avg"], ["region", "imd_band"]


def _boosted(spark, root, rounds):
    """Boosted trees of the years before the test year, and all rows with features."""
    f = ml.temporal_split(at_risk(spark, root).where("target_class is not null"))
    rows = materialise(f.select(*FT.KEYS, *_LABELS, *[F.col(c).cast("double").alias(c) for c in _NUMBERS], "target_class", "is_test"))
    return boosting.fit(rows.where("not is_test"), _NUMBERS, _LABELS, rounds=rounds), rows


@q("M06_boosted", "select id_student, code_module, code_presentation, true as whole, true as named, true as stopped from info where final_result is not null")
def _(spark, root):
    """Rounds are stopped by a held-out fifth; every row gets probabilities that sum to 1 and the likeliest class."""
    model, rows = _boosted(spark, root, 12)
    out = boosting.scored(model, rows, FT.KEYS)
    p = [F.col(f"prob_{c}") for c in model.classes]
    likeliest = F.array(*[F.lit(c) for c in model.classes])[F.array_position(F.array(*p), F.greatest(*p)).cast("int") - 1]
    stopped = F.lit(len(model.rounds) == max(1, int(model.losses.index(min(model.losses)) * 1.15)))
    return out.select(*FT.KEYS, (F.abs(sum(p[1:], p[0]) - 1) < 1e-9).alias("whole"), (F.col("predicted_class") == likeliest).alias("named"), stopped.alias("stopped"))


@q("M11_path_contributions", "select id_student, code_module, code_presentation, 9::bigint features, 0::double gap from info where final_result is not null")
def _(spark, root):
    """A row's contributions sum to its score less the score at the trees' roots."""
    model, rows = _boosted(spark, root, 3)
    parts = boosting.path_contributions(model, rows, FT.KEYS, "Withdrawn")
    gap = F.max("score") - F.max("base") - F.sum("contribution")
    return parts.groupBy(*FT.KEYS).agg(F.count("*").alias("features"), (F.round(gap, 6) + 0.0).alias("gap"))


@q("M11_permutation_importance", f"select unnest({_NUMBERS + _LABELS}) feature, true as measured")
def _(spark, root):
    model, rows = _boosted(spark, root, 3)
    found = boosting.permutation_importance(model, rows, FT.KEYS)
    return found.select("feature", F.col("importance").between(-10, 10).alias("measured"))


_SCORES = "s as (select user_id % 5 g, value score, (event_type in ('click', 'view'))::int label from events)"


def scores(spark, root):
    return table(spark, root, "events").select((F.col("user_id") % 5).alias("g"), F.col("value").alias("score"), F.col("event_type").isin("click", "view").cast("int").alias("label"))


_STEPS = """t as (select g, score, sum(label)::double tp, count(*)::double n from s group by 1, 2), c as (select *, sum(tp) over w tpu, sum(n) over w nu, sum(tp) over (partition by g) p, sum(n) over (partition by g) a from t window w as (partition by g order by score desc))"""


@q("M08_average_precision", f"with {_SCORES}, {_STEPS} select g, round(sum(tp / p * tpu / nu), 6) average_precision from c group by 1")
def _(spark, root):
    return rounded(ml.average_precision(scores(spark, root), ["g"]), "average_precision")


@q("M09_roc_auc", f"with {_SCORES}, {_STEPS} select g, round(sum(tp * ((a - p) - (nu - tpu) + (n - tp) / 2)) / max(p * (a - p)), 6) auc from c group by 1")
def _(spark, root):
    return rounded(ml.roc_auc(scores(spark, root), ["g"]), "auc")


@q("A28_mean_auc_gate", f"with {_SCORES}, {_STEPS}, u as (select g, sum(tp * ((a - p) - (nu - tpu) + (n - tp) / 2)) / max(p * (a - p)) auc from c group by 1) select round(avg(auc), 6) \"value\", avg(auc) >= 0.6 passed from u")
def _(spark, root):
    return rounded(ml.gate(ml.roc_auc(scores(spark, root), ["g"]), "auc", 0.6), "value")


@q("M10_class_report", """with p as (select final_result t, case when risk > 0.66 then 'Withdrawn' when risk > 0.33 then 'Fail' else 'Pass' end y from info), c as (select t from p union select y from p),
m as (select c.t k, count(*) filter (where p.t = c.t) support, count(*) filter (where y = c.t) said, count(*) filter (where p.t = c.t and y = c.t) hit from c, p group by 1)
select k "class", round(coalesce(hit / nullif(said, 0), 0), 6) "precision", round(coalesce(hit / nullif(support, 0), 0), 6) recall, round(coalesce(2 * hit / nullif(said + support, 0), 0), 6) f1, support from m""")
def _(spark, root):
    y = F.when(F.col("risk") > 0.66, "Withdrawn").when(F.col("risk") > 0.33, "Fail").otherwise("Pass")
    return rounded(ml.class_report(S.info(spark, root).select(F.col("final_result").alias("truth"), y.alias("predicted"))), "precision", "recall", "f1")


@q("M11_importance", """with m as (select avg(risk) a, avg(studied_credits) b from info) select 'risk' feature, round(avg(abs(2 * (risk - a))), 6) importance from info, m union all select 'studied_credits', round(avg(abs(-0.1::double * (studied_credits - b))), 6) from info, m""")
def _(spark, root):
    c = ml.contributions(S.info(spark, root), ["source_key"], {"risk": 2.0, "studied_credits": -0.1})
    return rounded(ml.global_importance(c), "importance")


@q("W04_local_top", """with m as (select avg(risk) a, avg(studied_credits) b, avg(num_of_prev_attempts) c from info), x as (select source_key, unnest([{'f': 'risk', 'v': 2 * (risk - a)}, {'f': 'studied_credits', 'v': -0.1::double * (studied_credits - b)}, {'f': 'num_of_prev_attempts', 'v': num_of_prev_attempts - c}]) s from info, m)
select source_key, s.f feature, round(s.v, 6) contribution, rn::int rank from (select *, row_number() over (partition by source_key order by abs(s.v) desc, s.f) rn from x) where rn <= 2""")
def _(spark, root):
    c = ml.contributions(S.info(spark, root), ["source_key"], {"risk": 2.0, "studied_credits": -0.1, "num_of_prev_attempts": 1.0})
    return rounded(ml.local_top(c, ["source_key"], 2), "contribution")


@q("M22_K08_metric_table", """select 'model' metric_type, 'rows' key_name, count(*)::double "value" from info union all select 'gate', 'auc', 0.6""")
def _(spark, root):
    measured = S.info(spark, root).agg(F.count("*").cast("double").alias("value")).select(F.lit("model").alias("metric_type"), F.lit("rows").alias("key_name"), "value")
    return ml.metric_table(measured, {("model", "rows"): 0.0, ("gate", "auc"): 0.6})


@q("M20_embedding_export", "select vec_id node, len(embedding)::int size, round(list_sum([x::double for x in embedding]), 4) total from embeddings where vec_id % 5 = 0", plain=True)
def _(spark, root):
    v = S.vectors(spark, root, True)
    return v.select("node", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))
