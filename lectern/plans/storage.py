"""Source, sink and streaming queries: each writes data derived from the tables to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import marts as M
from lectern.operators import online as O
from lectern.operators import quality as Q
from lectern.operators import recsys as R
from lectern.plans import standins as S
from lectern.plans.book import Book, r6
from lectern.plans.online import raw
from lectern.session import materialise, rocksdb_states, shared_folder, table
from lectern.sources import inventory, readers, upserts, versions, writers
from lectern.streaming import events as E
from lectern.streaming import mastery, sinks, state, watch, windows

book = Book()
q = book.add
F_KEYS = ["id_student", "code_module", "code_presentation"]


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def _customers(spark: SparkSession, root: str, at: str) -> str:
    c = table(spark, root, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias(" "), F.col("c_name").alias(" name "), F.col("c_mktsegment").alias("segment"))
    rows.write.option("header", True).csv(f"{at}/OULAD/customers.csv")
    return f"{at}/OULAD/customers.csv"


def _small_files(spark: SparkSession, root: str, at: str) -> str:
    events = table(spark, root, "events").select(F.col("event_id").cast("string").alias("event"), "event_type")
    events.repartition(8).write.option("header", True).csv(f"{at}/EdNet/KT1")
    return f"{at}/EdNet/KT1"


def _bank(spark: SparkSession, root: str, at: str) -> str:
    bank = table(spark, root, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    bank.write.json(f"{at}/Test_Bank.json")
    return f"{at}/Test_Bank.json"


def _documents(spark: SparkSession, root: str, at: str) -> str:
    docs = table(spark, root, "documents").select(F.regexp_replace("text", "[\r\n]", " ").alias("text"), F.col("lang").alias("chapter"))
    docs.write.partitionBy("chapter").text(f"{at}/Data/docs")
    return f"{at}/Data"


def _named(spark: SparkSession, df: DataFrame, by: str, target: str, kind: str = "csv") -> None:
    """df's rows as one file a value of by, named after it: target has {} in the value's place."""
    staged = folder(spark)
    rows = df.repartition(by).write.partitionBy(by)
    rows.option("header", True).csv(staged) if kind == "csv" else rows.format(kind).save(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(path(f"{staged}/{by}=*/part-*")):  # one a value
        value = part.getPath().getParent().getName().split("=", 1)[1]
        to = path(target.format(value))
        files.mkdirs(to.getParent())
        files.rename(part.getPath(), to)


@q("S01_S02_inventory", """select 'oulad' dataset, 'oulad_' || lower(c_mktsegment) table_name, 'csv' file_type, 'code_module' partition_hint, 'csv' strategy, 1::bigint files, count(*) + 1 lines from customer group by c_mktsegment
union all select 'ednet', 'ednet_kt1_events', 'csv', '_ingest_date', 'csv', count(distinct user_id), count(*) + count(distinct user_id) from events
union all select 'ednet', 'ednet_' || lower(event_type), 'csv', '_ingest_date', 'csv', 1, count(*) + 1 from events group by event_type
union all select 'sed', 'sed_status_' || lower(o_orderstatus), 'csv', '_ingest_date', 'csv', 1, count(*) + 1 from orders group by o_orderstatus
union all select 'content', 'content_question_bank', 'json', '_ingest_date', 'json', 1, count(*) from nation
union all select 'ednet', 'ednet_lecture_bank', 'json', '_ingest_date', 'json', 1, count(*) from region
union all select 'content', 'content_documents', 'markdown', 'chapter', 'markdown:chapter_' || lang, 1, count(*) from documents group by lang""", plain=True)
def _(spark, root):
    at = folder(spark)
    events = table(spark, root, "events").select("event_id", "event_type", "user_id")
    _named(spark, table(spark, root, "customer").select("c_custkey", F.lower("c_mktsegment").alias("s")), "s", f"{at}/OULAD/{{}}.csv")
    _named(spark, events, "user_id", f"{at}/EdNet/KT1/u{{}}.csv")
    _named(spark, events, "event_type", f"{at}/EdNet/contents/{{}}.csv")
    _named(spark, table(spark, root, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", f"{at}/SED/Status_{{}}.csv")
    nations = table(spark, root, "nation").select("n_nationkey", F.lit("b").alias("bank"))
    _named(spark, nations, "bank", f"{at}/Question_Bank.json", "json")
    _named(spark, nations, "bank", f"{at}/EdNet/Question_Bank.json", "json")  # the copy at the root goes before it
    _named(spark, table(spark, root, "region").select("r_regionkey", F.lit("b").alias("bank")), "bank", f"{at}/EdNet/x/Lecture_Bank.json", "json")
    docs = table(spark, root, "documents").select(F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ").alias("text"), "lang")
    _named(spark, docs, "lang", f"{at}/Data/c1/chapter_{{}}.md", "text")
    _named(spark, docs, "lang", f"{at}/Data/c1/chapter_{{}}.txt", "text")  # no route
    inventory.write_manifest(inventory.discover(spark, at), f"{at}_manifest")
    found = inventory.load_manifest(spark, f"{at}_manifest")
    lines = spark.read.option("recursiveFileLookup", True).text(at).groupBy(F.regexp_extract(F.col("_metadata.file_path"), f"{at.rsplit('/', 1)[-1]}/(.*)$", 1).alias("relative_path")).agg(F.count("*").alias("n"))
    return found.join(lines, "relative_path").groupBy("dataset", "table_name", "file_type", "partition_hint", "strategy").agg(F.count("*").alias("files"), F.sum("n").alias("lines"))


@q("S03_csv_strings", "select c_custkey::varchar _row_idx, c_name name, c_mktsegment segment from customer", plain=True)
def _(spark, root):
    return readers.read_csv(spark, _customers(spark, root, folder(spark)))


@q("S04_json_with_raw", "select n_nationkey, n_name, true in_raw, (select sum(length(n_name)) from nation)::bigint chars from nation", plain=True)
def _(spark, root):
    found = readers.read_json(spark, _bank(spark, root, folder(spark)))
    chars = F.aggregate("nations", F.lit(0).cast("long"), lambda n, x: n + F.length(x["n_name"]))
    one = found.select(F.explode("nations").alias("x"), "_raw_json", chars.alias("chars"))
    return one.select("x.n_nationkey", "x.n_name", F.col("_raw_json").contains(F.concat(F.lit('"'), F.col("x.n_name"), F.lit('"'))).alias("in_raw"), "chars")


@q("S05_documents", "select lang chapter, count(*) n, sum(length(regexp_replace(text, '[\r\n]', ' ', 'g')))::bigint chars from documents group by 1", plain=True)
def _(spark, root):
    found = readers.read_documents(spark, _documents(spark, root, folder(spark)), "*.txt")
    lines = found.select(F.regexp_extract("path", "chapter=([a-z]+)", 1).alias("chapter"), F.explode(F.split(F.regexp_replace("content_text", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("chapter").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@q("S06_S07_merged_schemas", """select count(*) n, count(case when c_custkey % 2 = 1 then c_acctbal end) with_balance, round(sum(case when c_custkey % 2 = 1 then c_acctbal end), 2) balance, count(case when c_custkey % 2 = 0 then c_mktsegment end) with_segment from customer""", plain=True)
def _(spark, root):
    at, c = folder(spark), table(spark, root, "customer")
    c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment").write.parquet(f"{at}/batch=0")
    c.where("c_custkey % 2 = 1").select("c_acctbal", "c_custkey", "c_name").write.parquet(f"{at}/batch=1")
    found = readers.read_parquet(spark, at, merge=True)
    return found.agg(F.count("c_name").alias("n"), F.count("c_acctbal").alias("with_balance"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count("c_mktsegment").alias("with_segment"))


@q("S08_K09_compaction", "select count(*) n, count(distinct event_type) kinds, 3 files from events", plain=True)
def _(spark, root):
    at = folder(spark)
    small = readers.read_csv(spark, _small_files(spark, root, at))
    rows = writers.compact(small, f"{at}/kt1", 3)
    back = spark.read.parquet(f"{at}/kt1")
    return back.agg(F.when(F.count("*") == rows, F.count("*")).alias("n"), F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.col("_metadata.file_path")).cast("int").alias("files"))


@q("S09_S10_K02_catalog_tables", "select r_regionkey, r_name from region", plain=True)
def _(spark, root):
    name = f"lectern_{uuid.uuid4().hex}"
    writers.write_table(table(spark, root, "region"), name)
    return readers.first_existing(spark, [f"{name}_absent", name])


@q("S11_inferred_csv", "select sum(c_custkey)::bigint total from customer", plain=True)
def _(spark, root):
    rows = spark.read.option("header", True).option("inferSchema", True).csv(_customers(spark, root, folder(spark)))
    return rows.agg(F.sum(rows.columns[0]).alias("total"))


@q("K01_partitioned_parquet", "select o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total from orders where o_orderstatus = 'F' group by 1", plain=True)
def _(spark, root):
    at = folder(spark)
    writers.write_parquet(table(spark, root, "orders"), at, "o_orderstatus")
    return spark.read.parquet(at).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q("K05_K13_table_counts", "select 'orders' table_name, count(*) \"rows\" from orders union all select 'part', count(*) from part", plain=True)
def _(spark, root):
    at = folder(spark)
    for name in ("orders", "part"):
        writers.write_parquet(table(spark, root, name), f"{at}/{name}")
    writers.write_counts(writers.count_tables(spark, at), f"{at}_counts")
    return spark.read.schema("table_name string, rows long").json(f"{at}_counts")


@q("K06_K07_serving_export", "select count(*) n, sum(source_key)::bigint keys, round(sum(risk), 6) risk, count(distinct region) regions from info")
def _(spark, root):
    at = folder(spark)
    for _ in range(2):  # an export replaces the one before
        writers.write_parquet(S.info(spark, root), at, files=2)
    return spark.read.parquet(at).agg(F.count("*").alias("n"), F.sum("source_key").alias("keys"), r6(F.sum("risk")).alias("risk"), F.count_distinct("region").alias("regions"))


@q("S17_preview_rows", """select 'rows' part, count(*) "value", null::varchar name from part union all (select 'shown', p_partkey, p_name from part order by p_partkey limit 50)""", plain=True)
def _(spark, root):
    """A table's row count and its first rows."""
    count, rows = readers.preview(table(spark, root, "part").orderBy("p_partkey"))
    shown = rows.select(F.lit("shown").alias("part"), F.col("p_partkey").cast("long").alias("value"), F.col("p_name").alias("name"))
    return count.select(F.lit("rows").alias("part"), F.col("rows").alias("value"), F.lit(None).cast("string").alias("name")).unionByName(shown)


@q("DQ07_column_counts", """select 'alike' files, count(*) "rows", false refused from customer union all select 'one more column', 0::bigint, true union all select 'other names', 0::bigint, true""", plain=True)
def _(spark, root):
    """CSV folders whose files agree on their header are read whole; those with a file of other columns are refused."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    at, out = folder(spark), []
    base = table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name")
    odd = {"alike": base.limit(0), "one more column": base.limit(3).withColumn("more", F.lit("x")), "other names": base.limit(3).toDF("key", "title")}
    for kind, rows in odd.items():
        path = f"{at}/{kind.replace(' ', '_')}"
        base.coalesce(2).write.option("header", True).csv(path)
        rows.coalesce(1).write.mode("append").option("header", True).csv(path)
        try:
            n, refused = readers.read_csv(spark, path).agg(F.count("key")).first()[0], False  # reads every file
        except (Py4JJavaError, PySparkException, Q.ColumnCountError):
            n, refused = 0, True
        out.append((kind, n, refused))
    return spark.createDataFrame(out, "files string, rows long, refused boolean")


@q("K10_single_file_compaction", "select count(*) n, sum(c_custkey)::bigint keys, count(distinct c_mktsegment) segments, 1 files from customer", plain=True)
def _(spark, root):
    at = folder(spark)
    writers.compact(readers.read_csv(spark, _customers(spark, root, at)), f"{at}/customers", 1)
    back = spark.read.parquet(f"{at}/customers")
    return back.agg(F.count("*").alias("n"), F.sum(F.col("_row_idx").cast("long")).alias("keys"), F.count_distinct("segment").alias("segments"), F.count_distinct(F.col("_metadata.file_path")).cast("int").alias("files"))


@q("K11_rewritten_table", "select count(*) n, count(distinct p_brand) brands from part", plain=True)
def _(spark, root):
    name = f"lectern_{uuid.uuid4().hex}"
    writers.write_table(table(spark, root, "part").repartition(6), name)
    writers.rewrite(spark, name, 2, ["p_brand"])
    return spark.table(name).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@q("J01_bucketed_features", """with c as (select id_student, code_module, code_presentation, sum(sum_click)::bigint total_clicks, count(distinct "date") active_days from clicks where "date" <= 15 group by 1, 2, 3)
select i.id_student, i.code_module, i.code_presentation, date_registration, coalesce(total_clicks, 0) total_clicks, coalesce(active_days, 0) active_days from info i left join reg using (id_student, code_module, code_presentation) left join c using (id_student, code_module, code_presentation)""")
def _(spark, root):
    """Learners, registrations and click features of tables in the same buckets: no rows are exchanged."""
    name = f"lectern_{uuid.uuid4().hex}"
    for kind, rows in (("info", S.info(spark, root)), ("reg", S.registration(spark, root)), ("clicks", S.clicks(spark, root))):
        writers.write_bucketed(rows.where(" and ".join(f"{k} is not null" for k in F_KEYS)), f"{name}_{kind}", F_KEYS, 8)
    return bucketed_features(spark, name)


def bucketed_features(spark: SparkSession, name: str) -> DataFrame:
    from lectern.operators.features import vle_features

    clicked = vle_features(spark.table(f"{name}_clicks"), 15).select(*F_KEYS, "total_clicks", "active_days")
    out = spark.table(f"{name}_info").select(*F_KEYS).join(spark.table(f"{name}_reg").select(*F_KEYS, "date_registration"), F_KEYS, "left").join(clicked, F_KEYS, "left")
    return out.fillna(0, ["total_clicks", "active_days"])


@q("K09_K11_versions", "select count(*) n, sum(l_orderkey)::bigint keys, count(*) filter (where l_linenumber = 1) firsts, true as fewer from lineitem", plain=True)
def _(spark, root):
    """Many small files and a large one, added in two versions, then packed; the large one stays."""
    at, rows = folder(spark), table(spark, root, "lineitem")
    versions.add(rows.where("l_linenumber = 1").repartition(12), at)
    versions.add(rows.where("l_linenumber <> 1 or l_linenumber is null").coalesce(1), at)
    before = materialise(versions.file_list(spark, at))
    large = versions.sizes(spark, f"{at}/data").agg(F.max("length")).first()[0]
    versions.compact(spark, at, small=large, target=large)
    versions.vacuum(spark, at)
    fewer = F.lit(versions.file_list(spark, at).count() < before.count())
    found = versions.read(spark, at).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.count_if(F.col("l_linenumber") == 1).alias("firsts"))
    return found.select("n", "keys", "firsts", fewer.alias("fewer"))


@q("K12_reset_table", "select count(*) before, 0::bigint n, 3 columns from nation", plain=True)
def _(spark, root):
    name = f"lectern_{uuid.uuid4().hex}"
    writers.write_table(table(spark, root, "nation"), name)
    before = materialise(spark.table(name).agg(F.count("*").alias("before")))
    writers.reset(spark, name)
    left = spark.table(name)
    return before.crossJoin(F.broadcast(left.agg(F.count("*").alias("n"), F.lit(len(left.columns)).alias("columns"))))  # one row each


@q("T07_repartitioned", "select count(*) n, sum(l_orderkey)::bigint keys, sum(l_linenumber)::bigint numbers, 4 files from lineitem", plain=True)
def _(spark, root):
    at = folder(spark)
    writers.write_parquet(table(spark, root, "lineitem"), at, files=4)
    back = spark.read.parquet(at)
    return back.agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.sum(F.col("l_linenumber").cast("long")).alias("numbers"), F.count_distinct(F.col("_metadata.file_path")).cast("int").alias("files"))


def _stream(spark: SparkSession, root: str) -> tuple[str, DataFrame]:
    """The broker records of online.raw as files, and a routed stream of them."""
    at = folder(spark)
    raw(spark, root).select(F.col("value"), "timestamp").write.parquet(f"{at}/in")
    return at, E.routed(E.source(spark, "parquet", {"path": f"{at}/in"}))


@q("R09_K03_K04_stream_job", """select 'assessment' sink, count(*) n from events where event_id % 8 = 5 union all select 'rejected', count(*) from events where event_id % 8 in (1, 2, 4, 7)""", plain=True)
def _(spark, root):
    at, rows = _stream(spark, root)
    for query in sinks.start_job(rows, f"{at}/out", once=True):
        query.awaitTermination()
    count = lambda sink, name: spark.read.parquet(f"{at}/out/{name}").agg(F.count("*").alias("n")).select(F.lit(sink).alias("sink"), "n")
    return M.union_all([count("assessment", "assessments"), count("rejected", "rejected")])


@q("R06_stream_sessions_closed", """with s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) sn from (select *, (lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute)::int fresh from events where event_id % 8 in (0, 3, 6) window w as (partition by user_id order by ts, event_id))),
g as (select user_id, sn, max(ts) + interval 30 minute e, sum(floor(value)::bigint % 20) c from s group by 1, 2) select count(*) sessions, sum(c)::bigint sum_click from g where e <= (select max(ts) - interval 10 minute from events where event_id % 8 in (0, 3, 6))""", plain=True)
def _(spark, root):
    at, rows = _stream(spark, root)
    found = E.sessions(rows.where("route = 'clicks'"))
    sinks.append(E.as_click_rows(found), f"{at}/out", f"{at}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("sessions"), F.sum(F.col("sum_click").cast("long")).alias("sum_click"))


@q("O05_stream_state", """select user_id::varchar effective_id, sum(case when event_id % 8 in (0, 3, 6) then floor(value)::bigint % 20 else 0 end)::double total_clicks, count(*) filter (where event_id % 8 = 5) submission_count, round(count(*) filter (where event_id % 8 = 5) * 0.05::double, 6) risk_shift from events where event_id % 8 in (0, 3, 5, 6) group by 1""", plain=True)
def _(spark, root):
    at, rows = _stream(spark, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch_id={batch_id}")

    state.learner_state(rows).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{at}/out").groupBy("effective_id").agg(F.max_by(F.struct("total_clicks", "submission_count", "risk_shift"), "batch_id").alias("s"))
    return last.select("effective_id", "s.total_clicks", "s.submission_count", r6("s.risk_shift").alias("risk_shift"))


_DUE = """with recursive due as (select user_id::varchar learner, (event_id % 5)::varchar chapter, floor(value)::double % 101 score, ts, event_id from events where event_type = 'purchase' and epoch_ms(ts) <= (select max(epoch_ms(ts)) from events where event_type = 'purchase') - 86400000),
g as (select *, row_number() over (partition by learner, chapter order by epoch_ms(ts), event_id) rn, count(*) over (partition by learner, chapter) n, round_even(20 * score / 100, 0)::int k from due), f as (
  select learner, chapter, rn, n, k, 0.4::double p, 0 i from g where rn = 1
  union all
  select f.learner, f.chapter, case when f.i = 19 then f.rn + 1 else f.rn end, f.n, case when f.i = 19 then coalesce(g.k, 0) else f.k end, case when i < f.k then {R} + (1 - {R}) * 0.15::double else {W} + (1 - {W}) * 0.15::double end, case when f.i = 19 then 0 else f.i + 1 end
  from f left join g on g.learner = f.learner and g.chapter = f.chapter and g.rn = f.rn + 1 where f.rn <= f.n),
s as (select learner, chapter, arg_max(score, (epoch_ms(ts), event_id)) latest_score, round_even(arg_max(score, (epoch_ms(ts), event_id)) * 20 / 100, 0)::int correct from due group by 1, 2),
t as (select learner, count(*) submission_count, round(avg(score), 6) avg_score, min(score) min_score, round(sum(case when score >= 50 then 0.05 else -0.10 end)::double, 6) risk_shift from due group by 1)
select f.learner, f.chapter, round(f.p, 6) mastery, f.n submissions, latest_score, correct, submission_count, avg_score, min_score, risk_shift from f join s on s.learner = f.learner and s.chapter = f.chapter join t on t.learner = f.learner where f.rn = f.n + 1""".format(R="(p * 0.9::double / (p * 0.9::double + (1 - p) * 0.2::double))", W="(p * 0.1::double / (p * 0.1::double + (1 - p) * 0.8::double))")


@q("O01_O05_chapter_stream", _DUE, plain=True)
def _(spark, root):
    """Purchases as submissions, in files of any order: after the stream, each chapter's last row, and the learner's last scores."""
    at = folder(spark)
    rows = table(spark, root, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("id_student"), (F.col("event_id") % 5).alias("chapter"), (F.floor("value") % 101).cast("double").alias("score"), "ts", "event_id")
    rows.repartition(3).write.parquet(f"{at}/in")
    stream = mastery.chapter_states(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), delay="1 day", idle_days=4000.0)
    mastery.keep(stream, f"{at}/chapters", f"{at}/checkpoint", once=True).awaitTermination()
    last = upserts.current(spark, f"{at}/chapters")
    scores = last.groupBy("learner").agg(F.max_by(F.struct("submission_count", "avg_score", "min_score", "risk_shift"), "submission_count").alias("s"))
    found = last.select("learner", "chapter", r6("mastery").alias("mastery"), "submissions", "latest_score", "correct").join(scores, "learner")
    return found.select("learner", "chapter", "mastery", "submissions", "latest_score", "correct", "s.submission_count", r6("s.avg_score").alias("avg_score"), "s.min_score", r6("s.risk_shift").alias("risk_shift"))


def _event_stream(spark: SparkSession, root: str) -> tuple[str, DataFrame]:
    """Events as files of any order, and a stream of them."""
    at = folder(spark)
    rows = table(spark, root, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    rows.repartition(4).write.parquet(f"{at}/in")
    return at, spark.readStream.schema(rows.schema).parquet(f"{at}/in")


@q("R12_stream_levels", """with e as (select user_id, ts::date d, count(*) n from events where ts::date <= date '2024-01-30' group by 1, 2), m as (select user_id, max(n) m from e group by 1), c as (select user_id, m, unnest(generate_series(date '2024-01-30' - 181, date '2024-01-30', interval 1 day))::date d from m)
select c.user_id, c.d "day", coalesce(n, 0) events, least(greatest(round_even(coalesce(n, 0) * 4.0::double / m, 0)::int + 1, 1), 5) "level" from c left join e on e.user_id = c.user_id and e.d = c.d""", plain=True)
def _(spark, root):
    """Levels of the calendar from a stream's tumbling windows; the batch query is R12_activity_levels."""
    at, stream = _event_stream(spark, root)
    windows.keep(windows.daily_counts(stream, delay="400 days"), f"{at}/days", f"{at}/checkpoint", once=True).awaitTermination()
    daily = upserts.current(spark, f"{at}/days").select(F.col("user").alias("user_id"), F.to_date("start").alias("day"), "events")
    return O.levels_of(daily, "2024-01-30")


@q("R10_stream_active", """select distinct user_id "user" from events where ts >= timestamp '2024-01-30 22:00:00' - interval 2000 minute and ts < timestamp '2024-01-30 22:00:00'""", plain=True)
def _(spark, root):
    """Users of the sliding window of 2,000 minutes, anew every 40, that ends at a time; windows stand on whole steps since 1970."""
    at, stream = _event_stream(spark, root)
    with rocksdb_states(spark):  # a row of state for each event and no end in sight
        query = windows.keep(windows.pane_counts(stream, 2000, 40, delay="400 days"), f"{at}/panes", f"{at}/checkpoint", once=True)
    query.awaitTermination()
    return windows.active_in(upserts.current(spark, f"{at}/panes"), "2024-01-30 22:00:00", 2000, 40)


@q("DQ02_observed_write", "select 'score' column_name, count(*) filter (where score > 90) failed, count(*) n from subs")
def _(spark, root):
    """The report of DQ02_full_audit, counted by the write; n are the rows that were written."""
    at = folder(spark)
    report = watch.write_observed(S.submissions(spark, root), at, "submissions", [Q.between("score", 0, 90)])
    return report.select("column_name", "failed").crossJoin(F.broadcast(spark.read.parquet(at).agg(F.count("*").alias("n"))))  # one row


@q("DQ08_observed_stream", """select case event_id % 8 when 5 then 'assessment' when 0 then 'clicks' when 3 then 'clicks' when 6 then 'clicks' else 'rejected' end route, count(*) n from events group by 1""", plain=True)
def _(spark, root):
    """Routes counted while a stream writes them, from the table that a listener saves; the rows are as many."""
    at, rows = _stream(spark, root)
    listener = watch.Watch()
    spark.streams.addListener(listener)
    try:
        query = sinks.append(watch.observed(rows, "routes").select("route", "json_payload"), f"{at}/out", f"{at}/checkpoint", once=True)
        query.awaitTermination()
        watch.drained(spark)
    finally:
        spark.streams.removeListener(listener)
    listener.save(spark, f"{at}/report")
    seen = spark.read.parquet(f"{at}/report").where(F.col("query") == query.id).groupBy("metric").agg(F.sum("value").cast("long").alias("n"))
    seen = seen.where(F.col("metric").startswith("routes.") & (F.col("metric") != "routes.rows")).select(F.substring_index("metric", ".", -1).alias("route"), "n")
    written = spark.read.parquet(f"{at}/out").groupBy("route").agg(F.count("*").alias("n"))
    return seen.join(written, ["route", "n"])


@q("R11_stream_refresh", """select count(distinct u.node) * 5 n from vu u where u.node in (select user_id from events where event_id % 8 in (0, 3, 6))""")
def _(spark, root):
    at, rows = _stream(spark, root)
    clicks = rows.where("route = 'clicks'").withColumn("effective_id", F.col("effective_id").cast("long"))
    users, items = S.vectors(spark, root, True), S.vectors(spark, root, False)
    sinks.refresh_recommendations(clicks, users, items, f"{at}/serving", f"{at}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{at}/serving").agg(F.count("*").alias("n"))


@q("J04_graded_submissions", "select count(*) n, round(sum(score), 6) total from subs join defs using (id_assessment) where score is not null")
def _(spark, root):
    return S.submissions(spark, root).join(S.definitions(spark, root).select("id_assessment"), "id_assessment").dropna(subset=["score"]).agg(F.count("*").alias("n"), r6(F.sum("score")).alias("total"))


@q("J02_base_with_recent", """select i.id_student, i.code_module, i.code_presentation, coalesce(sum(c.sum_click), 0)::bigint recent from info i left join clicks c on c.id_student = i.id_student and c.code_module = i.code_module and c.code_presentation = i.code_presentation and c."date" > 8 and c."date" <= 15 group by 1, 2, 3""")
def _(spark, root):
    from lectern.operators.cleaning import recent
    from lectern.operators.features import KEYS

    week = recent(S.clicks(spark, root), "date", 15).groupBy(*KEYS).agg(F.sum("sum_click").alias("recent"))
    return S.info(spark, root).select(*KEYS).join(week, KEYS, "left").fillna(0, ["recent"])


@q("M15_denoised_edges", """with p as (select id_student u, id_site i, sum(sum_click) c from clicks group by 1, 2), m as (select i, quantile_disc(c, 0.5) m from p group by 1) select count(*) edges, count(distinct u) users, count(distinct i) items from p join m using (i) where c >= m""")
def _(spark, root):
    return R.denoised(R.interactions(S.clicks(spark, root))).agg(F.count("*").alias("edges"), F.count_distinct("user").alias("users"), F.count_distinct("item").alias("items"))


@q("R02_R04_effective_fields", """select case when event_id % 8 not in (2, 4) then user_id::varchar end effective_id, count(*) n, max(ts) last_time from events group by 1""", plain=True)
def _(spark, root):
    rows = E.parsed(raw(spark, root))
    return rows.groupBy("effective_id").agg(F.count("*").alias("n"), F.max("event_ts").alias("last_time"))


@q("P11_renamed", "select source_key, id_student student_id_hash, risk dropout_probability from info")
def _(spark, root):
    return S.info(spark, root).select("source_key", "id_student", "risk").withColumnsRenamed({"id_student": "student_id_hash", "risk": "dropout_probability"})


@q("DQ02_full_audit", "select 'score' column_name, count(*) filter (where score > 90) failed from subs")
def _(spark, root):
    return Q.report(S.submissions(spark, root), "submissions", [Q.between("score", 0, 90)]).select("column_name", "failed")


@q("U04_key_union", "select o_custkey k from orders union select c_custkey from customer", plain=True)
def _(spark, root):
    return table(spark, root, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, root, "customer").select("c_custkey")).distinct()


@q("S13_S16_audit_columns", "select 'customers' _source_dataset, count(*) n, 1 files from customer group by 1", plain=True)
def _(spark, root):
    rows = readers.ingest_csv(spark, _customers(spark, root, folder(spark)), "customers")
    return rows.groupBy("_source_dataset").agg(F.count("_ingest_at").alias("n"), F.count_distinct("_source_file").cast("int").alias("files"))


@q("U03_stacked_predictions", "select skill_name skill, count(*) n, round(sum(p_known_after), 6) known, sum(order_id)::bigint orders from mastery where skill_name in ('click_TMA', 'view_TMA') group by 1")
def _(spark, root):
    m = S.mastery(spark, root)
    stacked = M.union_all([m.where(f"skill_name = '{s}'").withColumn("skill", F.lit(s)) for s in ("click_TMA", "view_TMA")])
    return stacked.groupBy("skill").agg(F.count("*").alias("n"), r6(F.sum("p_known_after")).alias("known"), F.sum("order_id").alias("orders"))


@q("S12_stream_source", "select count(*) n, count(distinct ts) times, max(ts) last_time from events", plain=True)
def _(spark, root):
    at = folder(spark)
    raw(spark, root).select("value", "timestamp").write.parquet(f"{at}/in")
    sinks.append(E.source(spark, "parquet", {"path": f"{at}/in"}), f"{at}/out", f"{at}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("n"), F.count_distinct("timestamp").alias("times"), F.max("timestamp").alias("last_time"))


@q("S15_catalog", """select 'nation' table_name, count(*) "rows" from nation union all select 'part', count(*) from part""", plain=True)
def _(spark, root):
    name = f"lectern_{uuid.uuid4().hex}"
    spark.sql(f"create database {name}")
    for t in ("nation", "part"):
        writers.write_table(table(spark, root, t), f"{name}.{t}")
    listed = [r["table_name"] for r in readers.catalog_tables(spark).where(F.col("database") == name).collect()]
    return M.union_all([spark.table(f"{name}.{t}").agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t in listed])


@q("K14_dead_letters", """select case event_id % 8 when 1 then 'wrong_type' when 7 then 'missing_field' else 'malformed' end reason, count(*) n, count(distinct ts) times from events where event_id % 8 in (1, 2, 4, 7) group by 1""", plain=True)
def _(spark, root):
    at, rows = _stream(spark, root)
    for _ in range(2):  # a second run goes on from the checkpoint of the first and finds nothing new
        sinks.dead_letters(rows, f"{at}/rejected", f"{at}/checkpoint", once=True).awaitTermination()
    found = spark.read.parquet(f"{at}/rejected")
    return found.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("kafka_time").alias("times"))


@q("T05_limited_sample", "select least(1000, count(*)) n, least(1000, count(*)) known from events", plain=True)
def _(spark, root):
    rows = readers.ingest_csv(spark, _small_files(spark, root, folder(spark)), "events")
    sample = materialise(readers.audit_sample(rows, 1000))
    return sample.agg(F.count("*").alias("n"), F.count_if((F.col("_source_dataset") == "events") & F.col("_ingest_at").isNotNull() & F.col("_source_file").contains("part-")).alias("known"))


def _fitted(spark: SparkSession, root: str):
    """A fitted at-risk pipeline and the features that it scores."""
    from lectern.operators import ml
    from lectern.plans.learning import at_risk

    numbers = ["total_clicks", "active_days", "avg_score", "submission_count"]
    f = at_risk(spark, root).where("target_class is not null").withColumns({c: F.col(c).cast("double") for c in numbers})
    f = materialise(f.select(*F_KEYS, *numbers, "region", "target_class"))
    return ml.classifier(numbers, ["region"]).fit(ml.class_weights(f, "target_class")), f


_LABELLED = "f as (select * from info where final_result is not null)"


@q("O06_rescored", f"""with {_LABELLED} select id_student, code_module, code_presentation, 1 + (source_key % 3 = 0)::int changes, true as same from f""")
def _(spark, root):
    from lectern.operators import ml

    model, features = _fitted(spark, root)
    keyed = features.join(S.info(spark, root).select(*F_KEYS, "source_key"), F_KEYS)
    first = keyed.withColumn("changed_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    later = keyed.where("source_key % 3 = 0").withColumns({"changed_at": F.lit("2024-01-02 00:00:00").cast("timestamp"), "total_clicks": F.col("total_clicks") + 500.0})
    at, changes = folder(spark), first.unionByName(later)
    changes.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    sinks.rescore(stream, model, F_KEYS, f"{at}/scores", f"{at}/checkpoint", once=True).awaitTermination()
    live = sinks.latest_scores(spark, f"{at}/scores", F_KEYS)
    last = later.unionByName(first.join(later.select(*F_KEYS), F_KEYS, "left_anti"))
    batch = ml.scored(model, last, F_KEYS).select(*F_KEYS, F.col("at_risk_probability").alias("p"))
    return live.join(batch, F_KEYS).select(*F_KEYS, F.col("changes").cast("int").alias("changes"), (F.abs(F.col("p") - F.col("dropout_probability")) < 1e-9).alias("same"))


@q("K08_model_round_trip", f"""with {_LABELLED} select 'model' metric_type, 'rows' key_name, count(*)::double "value" from f union all select 'model', 'same', count(*)::double from f union all select 'gate', 'auc', 0.6::double union all select 'absent', 'rows', 0::double""")
def _(spark, root):
    from lectern.operators import ml

    at = folder(spark)
    model, features = _fitted(spark, root)
    scored = ml.scored(model, features, F_KEYS).withColumnRenamed("at_risk_probability", "p").select(*F_KEYS, "p")
    measured = features.agg(F.count("*").cast("double").alias("value")).select(F.lit("model").alias("metric_type"), F.lit("rows").alias("key_name"), "value")
    writers.save_model(model, measured, f"{at}/saved")
    again = ml.scored(writers.load_model(f"{at}/saved"), features, F_KEYS)
    same = scored.join(again, F_KEYS).where(F.abs(F.col("p") - F.col("at_risk_probability")) < 1e-12).agg(F.count("*").cast("double").alias("value"))
    found = writers.load_metrics(spark, f"{at}/saved").unionByName(same.select(F.lit("model").alias("metric_type"), F.lit("same").alias("key_name"), "value"))
    missing = ml.metric_table(writers.load_metrics(spark, f"{at}/nothing"), {("absent", "rows"): 0.0})
    return ml.metric_table(found, {("model", "rows"): -1.0, ("gate", "auc"): 0.6}).unionByName(missing)
