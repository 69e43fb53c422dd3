"""Cleaning, projection, filter, quality, set and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import cleaning as C
from lectern.operators import marts as M
from lectern.operators import quality as Q
from lectern.plans import standins as S
from lectern.plans.book import Book, r6
from lectern.session import table

book = Book()
q = book.add


@q("P03_event_date", """select event_id, case when event_id % 7 = 0 then null else ts::date end event_date from events""", plain=True)
def _(spark, root):
    said = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return C.derive_date(table(spark, root, "events").select("event_id", said.alias("t")), "t").select("event_id", "event_date")


@q("P04_P05_trim_and_cast", """select p_partkey, trim(p_name) p_name, case when p_partkey % 5 = 0 then null else p_size end p_size, p_retailprice from part""", plain=True)
def _(spark, root):
    raw = table(spark, root, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"), F.when(F.col("p_partkey") % 5 == 0, "?").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"))
    return C.cast_columns(C.trim_strings(raw), {"p_size": "int", "p_retailprice": "double"})


@q("P06_pseudonymise", "select c_custkey, sha256(c_custkey::varchar) pseudonym from customer", plain=True)
def _(spark, root):
    return table(spark, root, "customer").select("c_custkey", X.pseudonym(F.col("c_custkey")).alias("pseudonym"))


@q("P08_deduplicate", "select distinct l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem", plain=True)
def _(spark, root):
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.lit("x").alias("_source"))
    return C.deduplicate(rows).drop("_source")


@q("P09_first_by_key", """select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) rn from events) where rn = 1""", plain=True)
def _(spark, root):
    return C.first_by_key(table(spark, root, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@q("P10_distinct_students", "select distinct id_student from info")
def _(spark, root):
    return S.info(spark, root).select("id_student").distinct()


@q("P12_until_cutoff", """select event_id, "date" from clicks where "date" is not null and "date" <= 15""")
def _(spark, root):
    return C.until(S.clicks(spark, root), "date", 15).select("event_id", "date")


@q("P13_recent_week", """select event_id, "date" from clicks where "date" > 8 and "date" <= 15""")
def _(spark, root):
    return C.recent(S.clicks(spark, root), "date", 15).select("event_id", "date")


@q("P14_open_until", """select id_assessment, "date" from defs where "date" is null or "date" <= 30""")
def _(spark, root):
    return C.open_until(S.definitions(spark, root), "date", 30).select("id_assessment", "date")


@q("P15_without_exams", "select id_assessment, assessment_type from defs where assessment_type <> 'Exam'")
def _(spark, root):
    return S.definitions(spark, root).where("assessment_type <> 'Exam'").select("id_assessment", "assessment_type")


@q("P16_drop_incomplete", "select count(*) n, sum(score) s from subs where score is not null and id_student is not null")
def _(spark, root):
    return S.submissions(spark, root).dropna(subset=["score", "id_student"]).agg(F.count("*").alias("n"), F.sum("score").alias("s"))


@q("P17_fill_defaults", """select id_assessment, coalesce("date", 0) "date", coalesce(weight, 0) weight, case when id_assessment % 3 = 0 then 'Unknown' else assessment_type end kind from defs""")
def _(spark, root):
    rows = S.definitions(spark, root).select("id_assessment", "date", "weight", F.when(F.col("id_assessment") % 3 != 0, F.col("assessment_type")).alias("kind"))
    return C.fill_defaults(rows, ["date", "weight"], ["kind"])


@q("P18_P19_target_class", """select source_key, case when final_result in ('Pass','Distinction') then 'Success' else final_result end target_class, (final_result in ('Withdrawn','Fail'))::int is_at_risk from info""")
def _(spark, root):
    rows = S.info(spark, root).select("source_key", X.target_class(F.col("final_result")).alias("target_class"))
    return rows.withColumn("is_at_risk", X.at_risk(F.col("target_class")))


@q("P20_binarise", "select passed, count(*) n from (select (score >= 50)::int passed from subs) group by 1")
def _(spark, root):
    return S.submissions(spark, root).select((F.col("score") >= 50).cast("int").alias("passed")).groupBy("passed").agg(F.count("*").alias("n"))


@q("P21_skill_key", """select order_id, skill_name, code_module module_part, kind kind_part from mastery""")
def _(spark, root):
    m = S.mastery(spark, root).select("order_id", X.skill_key(F.col("code_module"), F.col("kind")).alias("skill_name"))
    module, kind = X.skill_parts(F.col("skill_name"))
    return m.select("order_id", "skill_name", module.alias("module_part"), kind.alias("kind_part"))


@q("P22_risk_band", "select source_key, case when risk <= 0.3 then 'Safe' when risk <= 0.7 then 'Medium' else 'High' end band from info")
def _(spark, root):
    return S.info(spark, root).select("source_key", X.risk_band(F.col("risk")).alias("band"))


@q("P23_module_scope", "select order_id from mastery where starts_with(skill_name, 'view_')")
def _(spark, root):
    return M.module_scope(S.mastery(spark, root), "view", skill="skill_name").select("order_id")


@q("P24_search", "select p_name, lower(p_name) = 'red widget' exact, count(*) n from part where contains(lower(p_name), 'red widget') group by 1, 2", plain=True)
def _(spark, root):
    return M.search(table(spark, root, "part"), "p_name", "Red Widget").groupBy("p_name", "exact").agg(F.count("*").alias("n"))


@q("P25_six_digits", "select c_custkey, ('0x' || substr(md5(c_custkey::varchar), 1, 6))::bigint % 900000 + 100000 number from customer", plain=True)
def _(spark, root):
    return table(spark, root, "customer").select("c_custkey", X.six_digit_pseudonym(F.col("c_custkey")).alias("number"))


@q("P26_W12_friendly_label", """select id_student, code_module, 'Student ' || dense_rank() over (order by id_student) || case when code_module = 'error' then '' else ' (' || code_module || ')' end label from (select distinct id_student, code_module from info)""")
def _(spark, root):
    from lectern.operators.recsys import numbering

    pairs = S.info(spark, root).select("id_student", "code_module").distinct()
    numbers = numbering(pairs.select("id_student").distinct(), "id_student")
    label = X.friendly_label(F.col("id_student"), F.when(F.col("code_module") != "error", F.col("code_module")), F.col("index") + 1)
    return pairs.join(numbers, "id_student").select("id_student", "code_module", label.alias("label"))


@q("P27_best_title", """select p_partkey, coalesce(case when p_partkey % 3 = 0 then null else p_name end, p_brand) title from part""", plain=True)
def _(spark, root):
    p = table(spark, root, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, "AAA").otherwise(" ")).otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("brand_name"))
    return p.select("p_partkey", X.best_title(p.columns, ["title"], ("title", "name", "label"), ("AAA", "BBB", "CCC")).alias("title"))


@q("P28_content_type", """select p_partkey, case when contains(lower(p_name), 'ring') then 'video' when contains(lower(p_name), 'bolt') then 'quiz' when p_partkey % 2 = 0 then 'video' else 'document' end kind from part""", plain=True)
def _(spark, root):
    raw = F.when(F.lower("p_name").contains("ring"), "Recorded lecture").when(F.lower("p_name").contains("bolt"), "Final TEST")
    return table(spark, root, "part").select("p_partkey", X.content_type(raw, F.col("p_partkey")).alias("kind"))


@q("P29_duration", """select p_partkey, case when p_partkey % 3 = 0 then p_size || ' min' when p_partkey % 3 = 1 then p_size || ' pages' else '10 min' end duration from part""", plain=True)
def _(spark, root):
    minutes, pages = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise("?"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).otherwise("-1")
    return table(spark, root, "part").select("p_partkey", X.duration_text([minutes], [pages], "10 min").alias("duration"))


@q("P30_chapter_text", """select p_partkey, case when p_partkey % 3 = 0 then 'C' || p_size when p_partkey % 3 = 1 then 'Tuần ' || p_size || ' - ' || (p_size + 2) else 'Chapter' end chapter from part""", plain=True)
def _(spark, root):
    k, n = F.col("p_partkey"), F.col("p_size")
    explicit = F.when(k % 3 == 0, F.concat(F.lit(" C"), n.cast("string")))
    return table(spark, root, "part").select("p_partkey", X.chapter_text(explicit, F.when(k % 3 == 1, n), F.when(k % 3 == 1, n + 2), "Chapter").alias("chapter"))


@q("P31_chapter_of", """select o_orderkey, case when o_orderkey % 4 = 0 then 'C2' when o_orderkey % 4 = 1 then 'C' || (1 + o_orderkey % 6) when o_orderkey % 4 = 2 then 'C5' else 'C1' end chapter from orders""", plain=True)
def _(spark, root):
    k = F.col("o_orderkey")
    explicit = F.when(k % 4 == 0, "c2")
    assignment = F.when(k % 4 == 1, F.concat(F.lit("quiz-c"), (1 + k % 6).cast("string"))).when(k % 4 == 2, "546803").otherwise("other")
    return table(spark, root, "orders").select("o_orderkey", X.chapter_of(assignment, explicit, {"546803": "C5"}).alias("chapter"))


@q("P32_clip", "select source_key, round(least(greatest(risk * 1.5 - 0.25, 0), 1), 6) clipped, round((1 - risk) * 100, 6) pass_rate from info")
def _(spark, root):
    return S.info(spark, root).select("source_key", r6(X.clip(F.col("risk") * 1.5 - 0.25, 0.0, 1.0)).alias("clipped"), r6((1 - F.col("risk")) * 100).alias("pass_rate"))


@q("P33_nan_to_null", "select event_id, case when event_id % 9 = 0 then null else value end v from events", plain=True)
def _(spark, root):
    v = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return C.nan_to_null(table(spark, root, "events").select("event_id", v.alias("v")))


@q("P34_table_name", r"""select distinct c_name, case when trim(regexp_replace(lower(c_name || ' -' || c_mktsegment || '!'), '[^\p{L}\p{N}]+', '_', 'g'), '_') = '' then 'table' else trim(regexp_replace(lower(c_name || ' -' || c_mktsegment || '!'), '[^\p{L}\p{N}]+', '_', 'g'), '_') end table_name from customer""", plain=True)
def _(spark, root):
    return table(spark, root, "customer").select("c_name", X.table_name(F.concat("c_name", F.lit(" -"), "c_mktsegment", F.lit("!"))).alias("table_name")).distinct()


@q("P35_digits", "select s_suppkey, regexp_extract(s_name, '[0-9]+')::bigint number from supplier", plain=True)
def _(spark, root):
    return table(spark, root, "supplier").select("s_suppkey", X.digits(F.col("s_name")).alias("number"))


@q("P36_pruned", "select p_partkey, p_size from part", plain=True)
def _(spark, root):
    return C.pruned(table(spark, root, "part"), ["p_partkey", "p_size", "p_partkey", "absent"])


@q("P02_ensure_columns", "select n_nationkey, n_name, null::varchar note from nation", plain=True)
def _(spark, root):
    return C.ensure_columns(table(spark, root, "nation").select("n_nationkey", "n_name"), ["n_name", "note"])


@q("P01_P07_silver_orders", """select distinct sha256((o_custkey % 150)::varchar) id_student, (o_orderkey % 60)::int "date", o_orderpriority priority, 'orders' _silver_source_table from orders""", plain=True)
def _(spark, root):
    raw = table(spark, root, "orders").select((F.col("o_custkey") % 150).cast("string").alias("id_student"), F.concat(F.lit(" "), (F.col("o_orderkey") % 60).cast("string")).alias("date"), F.concat("o_orderpriority", F.lit(" ")).alias("priority"))
    return C.to_silver(C.add_audit_columns(raw, "orders", "orders.parquet"), "orders").select("id_student", "date", "priority", "_silver_source_table")


@q("DQ01_DQ03_expectations", """with f as (select count(*) filter (where c_custkey is null) a, count(*) filter (where c_acctbal < 0) b, count(*) filter (where c_custkey % 10 = 0) c from customer)
select 'customer' table_name, 'not_null' expectation, 'c_custkey' column_name, a failed, a = 0 ok from f union all select 'customer', 'between', 'c_acctbal', b, b = 0 from f union all select 'customer', 'between', 'odd', c, c = 0 from f""", plain=True)
def _(spark, root):
    rows = table(spark, root, "customer").withColumn("odd", F.when(F.col("c_custkey") % 10 == 0, "many").when(F.col("c_custkey") % 2 == 1, "5"))
    return Q.report(rows, "customer", [Q.not_null("c_custkey"), Q.between("c_acctbal", low=0), Q.between("odd", 0, 100)])


@q("DQ04_J15_reconcile", """with s as (select o_orderpriority table_name, count(*) n from orders group by 1), t as (select o_orderpriority table_name, count(*) n from orders where o_orderstatus <> 'P' group by 1 union all select 'extra', 1)
select table_name, coalesce(s.n, 0) source_rows, coalesce(t.n, 0) target_rows, coalesce(s.n, 0) = coalesce(t.n, 0) matches from s full join t using (table_name)""", plain=True)
def _(spark, root):
    o = table(spark, root, "orders")
    by = lambda d: d.groupBy(F.col("o_orderpriority").alias("table_name")).agg(F.count("*").alias("rows"))
    extra = o.limit(1).select(F.lit("extra").alias("table_name"), F.lit(1).cast("long").alias("rows"))
    return Q.reconcile(by(o), by(o.where("o_orderstatus <> 'P'")).unionByName(extra))


@q("DQ05_A24_conformance", """select round(avg((score is not null and id_student is not null)::int), 6) conformance from subs""")
def _(spark, root):
    return Q.conformance(S.submissions(spark, root), ["score", "id_student"]).select(r6("conformance").alias("conformance"))


@q("DQ06_freshness", "select epoch(max(ts))::bigint fresh_at from events", plain=True)
def _(spark, root):
    return Q.freshness(table(spark, root, "events"), "ts")


@q("A24_S18_table_counts", "select 'orders' table_name, count(*) \"rows\" from orders union all select 'lineitem', count(*) from lineitem union all select 'events', count(*) from events", plain=True)
def _(spark, root):
    return Q.counts({n: table(spark, root, n) for n in ("orders", "lineitem", "events")})


@q("U01_union_by_name", "select c_custkey k, c_name name, c_mktsegment segment from customer union all select s_suppkey, s_name, null from supplier", plain=True)
def _(spark, root):
    return M.union_all([table(spark, root, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), table(spark, root, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))])


@q("U05_set_difference", "select o_custkey k from orders intersect select c_custkey from customer where c_acctbal > 0 except select c_custkey from customer where c_mktsegment = 'MACHINERY'", plain=True)
def _(spark, root):
    o, c = table(spark, root, "orders").select(F.col("o_custkey").alias("k")), table(spark, root, "customer")
    return o.intersect(c.where("c_acctbal > 0").select("c_custkey")).exceptAll(c.where("c_mktsegment = 'MACHINERY'").select("c_custkey"))


@q("S14_sql_text", "select o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1", plain=True)
def _(spark, root):
    table(spark, root, "orders").createOrReplaceTempView("lectern_orders")
    return spark.sql("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from lectern_orders group by o_orderstatus")


@q("S17_preview", "select n_nationkey, n_name from nation order by n_nationkey limit 50", plain=True)
def _(spark, root):
    return table(spark, root, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").limit(50)
