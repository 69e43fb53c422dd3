"""Stream-shaped, session, online-state, content and profile queries; each runs its stream operator on a batch frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import folds
from lectern.operators import content as CT
from lectern.operators import online as O
from lectern.operators import recsys as R
from lectern.plans import standins as S
from lectern.plans.book import Book, r6, rounded
from lectern.session import table
from lectern.streaming import events as E

book = Book()
q = book.add


def raw(spark, root):
    """Broker records made of events: every payload shape that routing tells apart, by event_id."""
    k = F.col("event_id") % 8
    click = F.to_json(F.struct(F.col("user_id").cast("string").alias("id_student"), F.get_json_object("props", "$.k").alias("id_site"), (F.floor("value").cast("int") % 20).alias("clicks"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_time")))
    value = (
        F.when(k == 1, F.regexp_replace(click, '"clicks":[0-9]+', '"clicks":"invalid","sum_click":1')).when(k == 2, F.expr("substring(click, 1, length(click) - 5)"))
        .when(k == 3, F.regexp_replace(click, '"clicks"', '"sum_click"')).when(k == 4, F.lit("[1,2]"))
        .when(k == 5, F.regexp_replace(click, '"clicks":[0-9]+', '"event_type":"assessment_submission","assignment_id":"7","score":80')).when(k == 6, F.regexp_replace(click, '"clicks"', '"event_type":"click","sum_click"'))
        .when(k == 7, F.regexp_replace(click, '"clicks":[0-9]+,?', '"event_type":"click",')).otherwise(click)
    )
    return table(spark, root, "events").withColumn("click", click).select(value.alias("value"), F.col("ts").alias("timestamp"), "event_id")


@q("R01_R03_routes", """select case event_id % 8 when 1 then 'rejected' when 2 then 'rejected' when 4 then 'rejected' when 7 then 'rejected' when 5 then 'assessment' else 'clicks' end route, count(*) n from events group by 1""", plain=True)
def _(spark, root):
    return E.routed(raw(spark, root)).groupBy("route").agg(F.count("*").alias("n"))


@q("R02_R04_effective_fields_all_shapes", """select case when event_id % 8 not in (2, 4) then user_id::varchar end effective_id, case when event_id % 8 in (2, 4) then ts + interval 1 hour else ts end event_ts, count(*) n from events group by 1, 2""", plain=True)
def _(spark, root):
    # the broker's time is an hour late, so that it shows which time was taken; text that is no object has no id and no time of its own
    rows = E.parsed(raw(spark, root).withColumn("timestamp", F.col("timestamp") + F.expr("interval 1 hour")))
    return rows.groupBy("effective_id", "event_ts").agg(F.count("*").alias("n"))


@q("R03_strict_routes", """select case when event_id % 8 = 0 then 'clicks' when event_id % 8 = 5 then 'assessment' else 'rejected' end route, count(*) n from events group by 1""", plain=True)
def _(spark, root):
    return E.routed(raw(spark, root), strict=True).groupBy("route").agg(F.count("*").alias("n"))


@q("DQ08_DQ09_rejects", """select case event_id % 8 when 1 then 'wrong_type' when 7 then 'missing_field' else 'malformed' end reason, count(*) n from events where event_id % 8 in (1, 2, 4, 7) group by 1""", plain=True)
def _(spark, root):
    return E.rejects(E.routed(raw(spark, root))).groupBy("reason").agg(F.count("*").alias("n"))


_SESSIONS = """s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) sn from (select *, (lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute)::int fresh from events where event_id % 8 in (0, 3, 6) window w as (partition by user_id order by ts, event_id)))"""


@q("R05_R06_A10_sessions", f"""with {_SESSIONS} select user_id::varchar effective_id, min(ts) session_start, max(ts) + interval 30 minute session_end, sum(floor(value)::bigint % 20)::bigint sum_click, count(*) events, arg_min(regexp_extract(props, '[0-9]+'), ts) id_site from s group by user_id, sn""", plain=True)
def _(spark, root):
    s = E.sessions(E.routed(raw(spark, root)).where("route = 'clicks'"))
    return s.select("effective_id", "session_start", "session_end", "sum_click", "events", "id_site")


@q("R07_session_rows", f"""with {_SESSIONS}, g as (select user_id, sn, sum(floor(value)::bigint % 20) c from s group by 1, 2) select user_id::varchar id_student, 'AAA' code_module, c::varchar sum_click, 'stream' _source_dataset from g""", plain=True)
def _(spark, root):
    s = E.sessions(E.routed(raw(spark, root)).where("route = 'clicks'"))
    return E.as_click_rows(s, {"code_module": "AAA"}).select("id_student", "code_module", "sum_click", "_source_dataset")


@q("R08_assessment_rows", "select 7 id_assessment, user_id::varchar id_student, 18 date_submitted, 0 is_banked, 80.0::double score, 'AAA' code_module, ts event_ts from events where event_id % 8 = 5", plain=True)
def _(spark, root):
    return E.assessments(E.routed(raw(spark, root)), day=18, module="AAA")


@q("R10_active_users", "select distinct user_id \"user\" from events where ts >= timestamp '2024-01-30 22:00:00' - interval 2000 minute", plain=True)
def _(spark, root):
    return R.active_users(table(spark, root, "events").withColumnRenamed("user_id", "user"), "2024-01-30 22:00:00", 2000)


@q("R11_nrt_recommendations", """select "user", item, round(s, 6) score, rn::int rank from (select *, row_number() over (partition by "user" order by s desc, item) rn from (select u.node "user", i.node item, array_inner_product(u.vector, i.vector) s from vu u, vi i where u.node in (select user_id from events where ts >= timestamp '2024-01-30 22:00:00' - interval 2000 minute))) where rn <= 5""")
def _(spark, root):
    active = R.active_users(table(spark, root, "events").withColumnRenamed("user_id", "user"), "2024-01-30 22:00:00", 2000)
    users = S.vectors(spark, root, True).join(active.withColumnRenamed("user", "node"), "node", "left_semi")
    return rounded(R.top_k(users, S.vectors(spark, root, False), 5), "score")


@q("R12_activity_levels", """with e as (select user_id, ts::date d, count(*) n from events where ts::date <= date '2024-01-30' group by 1, 2), m as (select user_id, max(n) m from e group by 1), c as (select user_id, m, unnest(generate_series(date '2024-01-30' - 181, date '2024-01-30', interval 1 day))::date d from m)
select c.user_id, c.d "day", coalesce(n, 0) events, least(greatest(round_even(coalesce(n, 0) * 4.0::double / m, 0)::int + 1, 1), 5) "level" from c left join e on e.user_id = c.user_id and e.d = c.d""", plain=True)
def _(spark, root):
    return O.activity_levels(table(spark, root, "events"), "2024-01-30")


@q("R13_weekly_minutes", "select user_id, round_even(count(*) filter (where event_type = 'click') * 2.5::double + count(*) filter (where event_type = 'purchase') * 12, 0)::bigint as minutes from events group by 1", plain=True)
def _(spark, root):
    c = O.event_counts(table(spark, root, "events"), ["click", "purchase"])
    return c.select("user_id", O.weekly_minutes(F.col("n_click"), F.col("n_purchase")).alias("minutes"))


@q("R14_W05_newest_events", "select user_id, event_id, rn::int place from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn <= 20", plain=True)
def _(spark, root):
    return O.newest(table(spark, root, "events").select("user_id", "event_id", "ts"), 20, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


def _scored(spark, root):
    """Submissions of learners to chapters made of events: score = value capped to 100."""
    e = table(spark, root, "events").where("event_type in ('purchase', 'signup')")
    return e.select(F.col("user_id").alias("id_student"), F.concat(F.lit("C"), (F.col("event_id") % 6 + 1).cast("string")).alias("chapter"), F.least(F.col("value"), F.lit(100.0)).alias("score"), "ts", "event_id")


_SCORED = "sc as (select user_id id_student, 'C' || (event_id % 6 + 1) chapter, least(value, 100.0::double) score, ts, event_id from events where event_type in ('purchase', 'signup'))"
_R, _W = "(p * 0.9::double / (p * 0.9::double + (1 - p) * 0.2::double))", "(p * 0.1::double / (p * 0.1::double + (1 - p) * 0.8::double))"


@q("O01_online_mastery", f"""with recursive {_SCORED}, f as (
  select id_student, chapter, event_id, round_even(20 * score / 100, 0)::int k, 0.4::double p, 0 i from sc
  union all
  select id_student, chapter, event_id, k, case when i < k then {_R} + (1 - {_R}) * 0.15::double else {_W} + (1 - {_W}) * 0.15::double end, i + 1 from f where i < 20)
select event_id, round(p, 6) mastery from f where i = 20""", plain=True)
def _(spark, root):
    return _scored(spark, root).select("event_id", r6(folds.online_mastery(F.lit(0.4), F.col("score"))).alias("mastery"))


@q("O01_mastery_updates", f"""with recursive {_SCORED}, g as (select *, row_number() over (partition by id_student, chapter order by ts, event_id) rn, count(*) over (partition by id_student, chapter) n, round_even(20 * score / 100, 0)::int k from sc), f as (
  select id_student, chapter, rn, n, k, 0.4::double p, 0 i from g where rn = 1
  union all
  select f.id_student, f.chapter, case when f.i = 19 then f.rn + 1 else f.rn end, f.n, case when f.i = 19 then coalesce(g.k, 0) else f.k end, case when i < f.k then {_R} + (1 - {_R}) * 0.15::double else {_W} + (1 - {_W}) * 0.15::double end, case when f.i = 19 then 0 else f.i + 1 end
  from f left join g on g.id_student = f.id_student and g.chapter = f.chapter and g.rn = f.rn + 1 where f.rn <= f.n)
select id_student, chapter, round(p, 6) mastery, n submissions from f where rn = n + 1""", plain=True)
def _(spark, root):
    return rounded(O.mastery_updates(_scored(spark, root), ["id_student", "chapter"], ["ts", "event_id"]), "mastery")


@q("O02_W08_online_clicks", """with recursive c as (select user_id, (floor(value)::bigint % 20)::double c, row_number() over (partition by user_id order by ts, event_id) rn, count(*) over (partition by user_id) n from events where event_type = 'click'), f as (
  select user_id, rn, n, c total, 1.0::double dy, c avg_, c most, 1.0::double span, c / 7 recent from c where rn = 1
  union all
  select f.user_id, c.rn, f.n, f.total + c.c, greatest(1.0::double, f.dy + 0.1::double), (f.total + c.c) / greatest(1.0::double, f.dy + 0.1::double), greatest(f.most, c.c), f.span + 1, (f.recent * 6 + c.c) / 7 from f join c on c.user_id = f.user_id and c.rn = f.rn + 1)
select user_id id_student, total total_clicks, round(dy, 6) active_days, round(avg_, 6) avg_daily_clicks, most max_clicks_day, span engagement_span, round(recent, 6) recent_weekly_rate, round(recent - avg_, 6) engagement_momentum from f where rn = n""", plain=True)
def _(spark, root):
    c = table(spark, root, "events").where("event_type = 'click'").select(F.col("user_id").alias("id_student"), (F.floor("value") % 20).cast("double").alias("clicks"), "ts", "event_id")
    return rounded(O.online_clicks(c), "active_days", "avg_daily_clicks", "recent_weekly_rate", "engagement_momentum")


@q("O03_W07_running_scores", f"""with {_SCORED} select event_id, count(*) over w submission_count, round(avg(score) over w, 9) avg_score, min(score) over w min_score from sc window w as (partition by id_student order by ts, event_id rows unbounded preceding)""", plain=True)
def _(spark, root):
    return O.online_scores(_scored(spark, root)).select("event_id", "submission_count", F.round("avg_score", 9).alias("avg_score"), "min_score")


@q("O04_risk_shift", f"""with {_SCORED}, b as (select id_student, min(risk) risk from info group by 1), s as (select id_student, sum(case when score >= 50 then 0.05::double else -0.1::double end) s from sc group by 1) select id_student, round(least(greatest(risk - coalesce(s, 0), 0), 1), 6) risk, round(coalesce(s, 0), 6) shift from b left join s using (id_student)""")
def _(spark, root):
    base = S.info(spark, root).groupBy("id_student").agg(F.min("risk").alias("risk"))
    return rounded(O.shifted_risk(base, _scored(spark, root)), "risk", "shift")


@q("O05_W09_progress", f"""with {_SCORED} select id_student, chapter, arg_max(score, (ts, event_id)) latest_score, count(*) submissions, round_even(arg_max(score, (ts, event_id)) * 20 / 100, 0)::int correct, 20 total, max(ts) updated_at from sc group by 1, 2""", plain=True)
def _(spark, root):
    return O.progress(_scored(spark, root), ["id_student", "chapter"], ["ts", "event_id"])


@q("W10_merged_progress", f"""with {_SCORED}, p as (select id_student, chapter, count(*) submissions, max(ts) updated_at, 'local' origin from sc where event_id % 2 = 0 group by 1, 2), r as (select id_student, chapter, count(*) submissions, max(ts) updated_at, 'remote' origin from sc where event_id % 2 = 1 or event_id % 5 = 0 group by 1, 2)
select id_student, chapter, submissions, updated_at, origin from (select *, row_number() over (partition by id_student, chapter order by submissions desc, updated_at desc, origin desc) rn from (select * from p union all select * from r)) where rn = 1""", plain=True)
def _(spark, root):
    s = _scored(spark, root)
    side = lambda d, n: d.groupBy("id_student", "chapter").agg(F.count("*").alias("submissions"), F.max("ts").alias("updated_at")).withColumn("origin", F.lit(n))
    return O.merged_progress(side(s.where("event_id % 2 = 0"), "local"), side(s.where("event_id % 2 = 1 or event_id % 5 = 0"), "remote"), ["id_student", "chapter"])


@q("W06_recent_sessions", """with u as (select user_id, case when event_type = 'purchase' then 'assessment' else 'material' end kind, regexp_extract(props, '[0-9]+')::int % 10 label, ts, event_id from events), d as (select * from u qualify row_number() over (partition by user_id, kind, label order by ts desc, event_id desc) = 1)
select user_id, kind, label, event_id, place::int place from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) place from d) where place <= 4""", plain=True)
def _(spark, root):
    e = table(spark, root, "events")
    u = e.select("user_id", F.when(F.col("event_type") == "purchase", "assessment").otherwise("material").alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("label"), "ts", "event_id")
    return O.recent_sessions(u).select("user_id", "kind", "label", "event_id", "place")


@q("W06_session_minutes", """select event_id, case when event_id % 4 = 0 and event_id % 400 > 0 then greatest(1, ceil(event_id % 400 / 60.0::double)) when event_type = 'purchase' then 15 else least(20, greatest(1, event_id % 10 * 3)) end::bigint as minutes from events""", plain=True)
def _(spark, root):
    kind = F.when(F.col("event_type") == "purchase", "assessment").otherwise("material")
    seconds = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 400).cast("double"))
    return table(spark, root, "events").select("event_id", O.session_minutes(kind, seconds, F.col("event_id") % 10).alias("minutes"))


@q("O07_O08_titles_and_labels", """with e as (select event_id, ts, regexp_extract(props, '[0-9]+')::int item, case when event_id % 6 = 0 then 'Title ' || event_id when event_id % 6 = 1 then ' ' end title from events), o as (select item, arg_max(title, (ts, event_id)) t from e where length(trim(title)) > 0 and item % 2 = 0 group by 1), m as (select p_partkey item, p_name t from part where p_partkey % 3 = 0)
select event_id, coalesce(case when length(trim(title)) > 0 then title end, o.t, m.t, e.item::varchar) label from e left join o using (item) left join m using (item)""", plain=True)
def _(spark, root):
    e = table(spark, root, "events").select("event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("item"), F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("Title "), F.col("event_id").cast("string"))).when(F.col("event_id") % 6 == 1, " ").alias("title"))
    known = table(spark, root, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("int").alias("item"), F.col("p_name").alias("title"))
    return O.activity_labels(e, O.titles(e.where("item % 2 = 0"), "item", "title"), known, "item").select("event_id", "label")


def _shift_sql(unit: bool) -> str:
    moved = "[z[1] + 0.3::double * z[2] for z in list_zip(f.v, e.iv)]"
    step = "[x / (sqrt(list_dot_product(m, m)) + 1e-9::double) for x in m]" if unit else "m"
    return f"""with ev as (select user_id * 5 % 500 u, case when event_id % 400 % 5 = 0 then event_id % 400 + 1 else event_id % 400 end i, ts, event_id from events where event_type = 'click'),
e as (select u, vi.vector::double[] iv, row_number() over (partition by u order by ts, event_id) rn, count(*) over (partition by u) n from ev join vi on vi.node = ev.i),
f as (select vu.node u, 0 rn, vu.vector::double[] v from vu where node in (select u from e) union all select u, rn, {step} v from (select f.u, e.rn, {moved} m from f join e on e.u = f.u and e.rn = f.rn + 1))
select f.u "user", round(list_sum(f.v), 4) total, round(f.v[1], 4) "first" from f join (select distinct u, n from e) l on l.u = f.u and l.n = f.rn"""


def _shifted(spark, root, unit: bool):
    # interactions name items by their vec_id
    n = F.col("event_id") % 400
    e = table(spark, root, "events").where("event_type = 'click'").select((F.col("user_id") * 5 % 500).alias("user"), F.when(n % 5 == 0, n + 1).otherwise(n).alias("item"), "ts", "event_id")
    moved = O.shifted_user(S.vectors(spark, root, True), e, S.vectors(spark, root, False), unit=unit)
    return moved.select("user", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.col("vector")[0], 4).alias("first"))


@q("O10_shifted_vectors", _shift_sql(True))
def _(spark, root):
    return _shifted(spark, root, True)


@q("O10_moved_vectors", _shift_sql(False))
def _(spark, root):
    return _shifted(spark, root, False)


@q("O11_seeded_mastery", """with c as (select unnest(['C1', 'C2', 'C3', 'C4', 'C5', 'C6']) chapter), k as (select id_student, 'C1' chapter, arg_max(m, skill_name) m from (select id_student, skill_name, arg_max(p_known_after, order_id) m from mastery where contains(skill_name, 'C1') group by 1, 2) group by 1)
select i.id_student, c.chapter, coalesce(m, 0.4::double) mastery from (select distinct id_student from info) i cross join c left join k on k.id_student = i.id_student and k.chapter = c.chapter""")
def _(spark, root):
    from lectern.operators.marts import mastery_latest

    return O.seeded_mastery(S.info(spark, root), mastery_latest(S.mastery(spark, root), user="id_student"))


@q("O09_profile", f"""with {_SCORED}, k as (select id_student, arg_max(m, skill_name) m from (select id_student, skill_name, arg_max(p_known_after, order_id) m from mastery where contains(skill_name, 'C1') group by 1, 2) group by 1),
p as (select id_student, chapter, count(*) n, arg_max(score, (ts, event_id)) latest from sc group by 1, 2), pr as (select id_student, string_agg(chapter || ':' || n || ':' || floor(latest)::int, ',' order by chapter) progress from p group by 1),
tk as (select "user", string_agg(item, ',' order by rn) recommended from (select "user", item, row_number() over (partition by "user" order by s desc, item) rn from (select u.node "user", i.node item, array_inner_product(u.vector, i.vector) s from vu u, vi i)) where rn <= 5 group by 1)
select b.id_student, round(b.risk, 6) risk, round(2.0::double + coalesce(k.m, 0.4::double), 6) mastery, 'C1,C2,C3,C4,C5,C6' chapters, coalesce(pr.progress, '') progress, coalesce(tk.recommended, '') recommended
from (select id_student, min(risk) risk from info group by 1) b left join k using (id_student) left join pr using (id_student) left join tk on tk."user" = b.id_student""")
def _(spark, root):
    from lectern.operators.marts import mastery_latest

    risk = S.info(spark, root).groupBy("id_student").agg(F.min("risk").alias("risk"))
    mastery = O.seeded_mastery(S.info(spark, root), mastery_latest(S.mastery(spark, root), user="id_student"))
    progress = O.progress(_scored(spark, root), ["id_student", "chapter"], ["ts", "event_id"])
    ranked = R.top_k(S.vectors(spark, root, True), S.vectors(spark, root, False), 5).withColumnRenamed("user", "id_student")
    found = O.profile(risk, mastery, progress, ranked)
    line = lambda x: F.concat_ws(":", x["chapter"], x["submissions"].cast("string"), F.floor(x["latest_score"]).cast("int").cast("string"))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return found.select(
        "id_student", r6("risk").alias("risk"), r6(F.aggregate(F.map_values("mastery"), F.lit(0.0), lambda s, x: s + x)).alias("mastery"), listed(F.map_keys("mastery")).alias("chapters"),
        listed(F.transform("progress", line)).alias("progress"), listed(F.transform("recommended", lambda x: x.cast("string"))).alias("recommended"),
    )


@q("O13_feature_defaults", """select id_student, coalesce(round(avg(case when code_module = 'view' then risk end), 6), 0) risk, coalesce(max(case when code_module = 'view' then region end), 'Unknown') region from info group by 1""")
def _(spark, root):
    from lectern.operators.cleaning import fill_defaults

    i = S.info(spark, root)
    known = i.where("code_module = 'view'").groupBy("id_student").agg(r6(F.avg("risk")).alias("risk"), F.max("region").alias("region"))
    return fill_defaults(i.select("id_student").distinct().join(known, "id_student", "left"), ["risk"], ["region"])


def _tests(spark, root):
    """Chapters with tests and question ids: orders as tests, their lines as questions in order."""
    l = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("Questions"))
    return l.groupBy((F.col("l_orderkey") % 50).alias("ChapterID")).agg(F.collect_list(F.struct(F.col("l_orderkey").alias("TestID"), "Questions")).alias("Test"))


_QUESTIONS = """qs as (select l_orderkey % 50 ChapterID, l_orderkey TestID, (row_number() over (partition by l_orderkey order by k) - 1)::int pos, k QuestionID from (select distinct l_orderkey, l_partkey::varchar k from lineitem)), ky as (select qs.*, p_size % 4 answerID from qs join part on p_partkey::varchar = QuestionID and p_size > 5)"""


@q("N01_N02_questions", f"with {_QUESTIONS} select ChapterID, TestID, pos, QuestionID from qs", plain=True)
def _(spark, root):
    return CT.questions(_tests(spark, root))


def _key(spark, root):
    answers = table(spark, root, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("QuestionID"), (F.col("p_size") % 4).alias("answerID"))
    return CT.answer_key(CT.questions(_tests(spark, root)), answers)


@q("J16_answer_key", f"with {_QUESTIONS} select ChapterID, TestID, pos, QuestionID, answerID from ky", plain=True)
def _(spark, root):
    return _key(spark, root)


def _quiz(spark, root):
    key = _key(spark, root)
    answers = key.select("TestID", "pos", "ChapterID", F.when(F.col("pos") % 5 != 0, (F.col("TestID") + F.col("pos")) % 4).alias("answer"))
    return CT.quiz_scores(answers, key.select("TestID", "pos", "answerID"), ["ChapterID", "TestID"])


_QUIZ = _QUESTIONS + """, sq as (select ChapterID, TestID, sum(coalesce((case when pos % 5 <> 0 then (TestID + pos) % 4 end = answerID)::int, 0))::bigint correct, count(*) total from ky group by 1, 2), sr as (select *, round(100.0::double * correct / total)::bigint score, round(100.0::double * correct / total) >= 60 passed from sq)"""


@q("N03_quiz_scores", f"with {_QUIZ} select ChapterID, TestID, correct, total, score, passed from sr", plain=True)
def _(spark, root):
    return _quiz(spark, root)


@q("N04_course_progress", f"with {_QUIZ} select TestID % 150 student, round(100.0::double * count(distinct case when passed then ChapterID end) / 50)::bigint progress from sr group by 1", plain=True)
def _(spark, root):
    return CT.course_progress(_quiz(spark, root).withColumns({"student": F.col("TestID") % 150, "chapter": F.col("ChapterID")}), ["student"], 50)


@q("N05_chapter_radar", f"""with {_SCORED}, p as (select id_student, chapter, count(*) submissions, arg_max(score, (ts, event_id)) m from sc group by 1, 2) select id_student, chapter, case when submissions = 1 then 0 else least(greatest(case when m <= 1 then m * 100 else m end, 0), 100) end "value" from p""", plain=True)
def _(spark, root):
    p = O.progress(_scored(spark, root), ["id_student", "chapter"], ["ts", "event_id"])
    return CT.chapter_radar(p.select("id_student", "chapter", F.when(F.col("submissions") > 1, F.col("submissions")).alias("submissions"), F.col("latest_score").alias("mastery"))).select("id_student", "chapter", "value")
