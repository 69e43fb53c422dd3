"""Chapter state of a stream with late events, expiry, restarts and an initial state; upserts; swaps stopped at every step."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import online as O
from lectern.sources import upserts, writers
from lectern.streaming import sinks
from lectern.streaming.events import routed
from lectern.streaming.mastery import OUTPUT, chapter_states

SCHEMA = "id_student string, chapter string, score double, ts timestamp, event_id long"
DAY = datetime(2024, 1, 1)


def at(days, minutes=0):
    return DAY + timedelta(days=days, minutes=minutes)


def feed(spark, folder, rows, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in{number}")
    os.makedirs(f"{folder}/in", exist_ok=True)
    for f in os.listdir(f"{folder}/in{number}"):
        if f.endswith(".parquet"):
            os.rename(f"{folder}/in{number}/{f}", f"{folder}/in/{number}-{f}")


def run(spark, folder, **options):
    seen = []
    stream = chapter_states(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), **options)

    def write(batch, batch_id):
        seen.extend(batch.collect())

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)
    return seen, late


def expected(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    mastery = {(r["id_student"], r["chapter"]): (r["mastery"], r["submissions"]) for r in O.mastery_updates(df, ["id_student", "chapter"], ["ts", "event_id"]).collect()}
    progress = {(r["id_student"], r["chapter"]): (r["latest_score"], r["correct"], r["total"], r["updated_at"]) for r in O.progress(df, ["id_student", "chapter"], ["ts", "event_id"]).collect()}
    return {k: (*mastery[k], *progress[k]) for k in mastery}


def test_chapters_equal_the_batch_result_across_late_events_and_restarts(spark, tmp_path):
    folder = str(tmp_path)
    first = [("a", "1", 80.0, at(0), 1), ("a", "2", 10.0, at(0, 5), 2), ("b", "1", 55.0, at(1), 3), ("a", "1", 40.0, at(2), 4)]
    # in the second run one submission is older than another of the first that waits, and one is later than the watermark
    second = [("a", "1", 100.0, at(1, 30), 5), ("a", "1", 0.0, at(0), 6), ("b", "2", 90.0, at(4), 7), ("a", "1", 95.0, at(4, 1), 8)]
    third = [("c", "9", 1.0, at(9), 9)]
    last, late = {}, 0
    for number, rows in enumerate((first, second, third)):
        feed(spark, folder, rows, number)
        seen, dropped = run(spark, folder, delay="1 day", idle_days=400.0)
        late += dropped
        for r in seen:
            assert r["kind"] == "update"
            last[r["learner"], r["chapter"]] = r
    assert late == 1
    want = expected(spark, [r for r in first + second if r[4] != 6])
    got = {k: (r["mastery"], r["submissions"], r["latest_score"], r["correct"], r["total"], r["updated_at"]) for k, r in last.items()}
    assert {k: (round(v[0], 9), *v[1:]) for k, v in got.items()} == {k: (round(v[0], 9), *v[1:]) for k, v in want.items()}
    a = max((r for k, r in last.items() if k[0] == "a"), key=lambda r: r["submission_count"])
    assert (a["submission_count"], round(a["avg_score"], 6), a["min_score"], round(a["risk_shift"], 6)) == (5, 65.0, 10.0, round(0.05 * 3 - 0.10 * 2, 6))


def test_a_learner_expires_and_an_initial_state_is_where_the_stream_begins(spark, tmp_path):
    folder = str(tmp_path)
    known = spark.createDataFrame([("a", "1", 0.9, 7, 60.0, at(-1)), ("z", "1", 0.5, 1, 20.0, at(-50))], "learner string, chapter string, mastery double, submissions long, latest_score double, updated_at timestamp")
    feed(spark, folder, [("a", "1", 80.0, at(0), 1), ("a", "1", float("nan"), at(0, 1), 2), ("a", "1", None, at(0, 2), 3), (None, "1", 1.0, at(0), 4)], 0)
    seen, _ = run(spark, folder, delay="1 hour", idle_days=30.0, initial=known)
    feed(spark, folder, [("b", "1", 50.0, at(3), 5)], 1)
    more, _ = run(spark, folder, delay="1 hour", idle_days=30.0, initial=known)
    seen += more
    a = [r for r in seen if r["learner"] == "a"][-1]
    from lectern.functions.folds import after_submission

    assert (round(a["mastery"], 9), a["submissions"], a["submission_count"], a["latest_score"]) == (round(after_submission(0.9, 80.0), 9), 10, 1, 80.0)
    feed(spark, folder, [("b", "1", 50.0, at(40), 6)], 2)
    gone, _ = run(spark, folder, delay="1 hour", idle_days=30.0, initial=known)
    expired = {r["learner"] for r in seen + gone if r["kind"] == "expired"}
    assert expired == {"a", "b", "z"} or expired == {"a", "z"}
    feed(spark, folder, [("a", "1", 80.0, at(41), 7), ("x", "1", 1.0, at(43), 8)], 3)
    again = [r for r in run(spark, folder, delay="1 hour", idle_days=30.0, initial=known)[0] if r["learner"] == "a"]
    assert [(r["submissions"], r["submission_count"]) for r in again] == [(1, 1)]
    assert [c.split()[0] for c in OUTPUT.split(", ")] == list(a.asDict())


def test_the_chapter_stream_runs_in_a_session_of_the_usual_state_store(spark, tmp_path):
    import duckdb

    from lectern.plans import ORACLES, QUERIES

    rows = [(i, i % 3, "purchase" if i % 4 else "click", float(i * 37 % 150), at(i % 9, i)) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    store = "spark.sql.streaming.stateStore.providerClass"
    before, usual = spark.conf.get(store), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(store, usual)
    try:
        df = QUERIES["O01_O05_chapter_stream"](spark, str(tmp_path))
        got = sorted(tuple(r) for r in df.collect())
        assert spark.conf.get(store) == usual
    finally:
        spark.conf.set(store, before)
    with duckdb.connect() as sql:
        sql.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(sql.sql(f"select {', '.join(df.columns)} from ({ORACLES['O01_O05_chapter_stream']})").fetchall())


def files(path):
    return {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_touch_only_their_buckets_and_can_be_repeated(spark, tmp_path):
    path = f"{tmp_path}/t"
    schema = "k long, v string, version int"
    base = spark.createDataFrame([(i, f"v{i}", 1) for i in range(200)], schema)
    assert upserts.upsert(base, path, ["k"], ["version"], 16) == 16
    before = files(path)
    change = spark.createDataFrame([(3, "new", 2), (3, "newer", 3), (1000, "added", 1), (5, "older", 0)], schema)
    written = upserts.upsert(change, path, ["k"], ["version"], 16)
    after = files(path)
    assert 1 <= written <= 2 and len(set(before) & set(after)) >= len(before) - written
    got = {r["k"]: (r["v"], r["version"]) for r in upserts.current(spark, path).collect()}
    assert got == {**{i: (f"v{i}", 1) for i in range(200)}, 3: ("newer", 3), 1000: ("added", 1)}
    # the same batch once more, and an older one, change no file
    assert upserts.upsert(change, path, ["k"], ["version"], 16) == 0 and upserts.upsert(base, path, ["k"], ["version"], 16) == 0
    assert files(path) == after
    assert upserts.upsert(change.limit(0), path, ["k"], ["version"], 16) == 0


def test_a_new_checkpoint_keeps_the_rejects_of_the_old_one(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(f"[{n},{i}]", DAY) for i in range(4)], "value string, timestamp timestamp")
    for n in (1, 2):
        rows(n).write.parquet(f"{tmp_path}/in{n}")
        stream = routed(spark.readStream.schema("value string, timestamp timestamp").parquet(f"{tmp_path}/in{n}"))
        for _ in range(2):
            sinks.dead_letters(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint{n}", once=True).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == 8 and found.select("run").distinct().count() == 2
    assert {r["json_payload"] for r in found.collect()} == {f"[{n},{i}]" for n in (1, 2) for i in range(4)}


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", range(1, 7))
def test_a_rewrite_that_stops_anywhere_leaves_a_whole_table_and_can_be_repeated(spark, monkeypatch, step):
    name = f"rewritten_{step}"
    for t in (name, f"{name}__new", f"{name}__old"):
        spark.sql(f"drop table if exists {t}")
    spark.range(100).withColumn("v", F.col("id") * 2).repartition(5).write.saveAsTable(name)

    class Limited:
        """A session whose n-th statement, or the write between them, is the last one that runs."""

        def __init__(self):
            self.left = step

        def __getattr__(self, what):
            return getattr(spark, what)

        def used(self):
            if self.left == 0:
                raise Stopped
            self.left -= 1

        def sql(self, text):
            self.used()
            return spark.sql(text)

        def table(self, t):
            self.used()
            return spark.table(t)

    try:
        writers.rewrite(Limited(), name, 2)
    except Stopped:
        pass
    whole = [t for t in (name, f"{name}__old", f"{name}__new") if spark.catalog.tableExists(t)]
    assert any(spark.table(t).count() == 100 for t in whole)
    writers.rewrite(spark, name, 2)
    assert spark.table(name).agg(F.count("*"), F.sum("v")).first() == (100, 9900)
    assert not spark.catalog.tableExists(f"{name}__old") and not spark.catalog.tableExists(f"{name}__new")
    spark.sql(f"drop table {name}")
