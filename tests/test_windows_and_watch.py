"""Stream windows with late rows against batch counts, observed writes, and a gate that stops a query."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import quality as Q
from lectern.sources import upserts
from lectern.streaming import sinks, watch, windows
from lectern.streaming.events import routed

DAY = datetime(2024, 3, 1)


def test_windows_equal_batch_counts_and_late_rows_are_counted(spark, tmp_path):
    folder, schema = str(tmp_path), "user_id long, ts timestamp"
    first = [(u, DAY + timedelta(hours=7 * i + u)) for u in (1, 2) for i in range(20)]
    second = [(1, DAY + timedelta(days=5, hours=22)), (1, DAY + timedelta(hours=1)), (3, DAY + timedelta(days=9))]  # the second is later than the watermark
    listener = watch.Watch()
    spark.streams.addListener(listener)
    queries = []
    try:
        for n, rows in enumerate((first, second)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
            queries.append(windows.keep(windows.daily_counts(stream, delay="1 day"), f"{folder}/days", f"{folder}/c1", once=True, buckets=8))
            queries[-1].awaitTermination()
            windows.keep(windows.recent_counts(stream, 60, 20, delay="1 day"), f"{folder}/recent", f"{folder}/c2", once=True, buckets=8).awaitTermination()
        watch.drained(spark)
    finally:
        spark.streams.removeListener(listener)
    assert queries[0].id == queries[1].id and listener.total(queries[0].id, "late_rows") == 1
    want = spark.createDataFrame(first + [second[0], second[2]], schema)
    days = {(r["user"], r["start"]): r["events"] for r in upserts.current(spark, f"{folder}/days").collect()}
    assert days == {(r["user_id"], r["w"]["start"]): r["n"] for r in want.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).collect()}
    now = DAY + timedelta(days=5, hours=22, minutes=40)
    assert {r["user"] for r in windows.active_at(upserts.current(spark, f"{folder}/recent"), now).collect()} == {r["user_id"] for r in want.where((F.col("ts") >= now - timedelta(minutes=60)) & (F.col("ts") < now)).collect()} == {1}


def test_panes_hold_the_users_of_every_sliding_window(spark, tmp_path):
    folder, schema, minutes, every = str(tmp_path), "user_id long, ts timestamp", 50, 20  # panes of 10 minutes
    first = [(u, DAY + timedelta(minutes=m)) for u in range(7) for m in range(13 * u, 300, 61)] + [(8, DAY + timedelta(hours=9)), (8, DAY + timedelta(hours=10))]
    second = [(9, DAY + timedelta(hours=8, minutes=21)), (10, DAY + timedelta(hours=8, minutes=15))]  # no window of the second is open
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        windows.keep(windows.pane_counts(stream, minutes, every, delay="1 hour"), f"{folder}/panes", f"{folder}/c1", once=True, buckets=4).awaitTermination()
        windows.keep(windows.recent_counts(stream, minutes, every, delay="1 hour"), f"{folder}/recent", f"{folder}/c2", once=True, buckets=4).awaitTermination()
    panes, recent = upserts.current(spark, f"{folder}/panes"), upserts.current(spark, f"{folder}/recent")
    kept = first + second[:1]
    assert panes.agg(F.sum("events")).first()[0] == len(kept) and recent.where("user = 9").count() > 0 and recent.where("user = 10").count() == 0
    users = lambda df: {r["user"] for r in df.collect()}
    for m in (10, 15, 29, 30, 49, 50, 131, 350, 370, 400, 510, 540, 541, 590, 610, 649, 650, 651, 670, 2000):
        now = DAY + timedelta(minutes=m)
        end = now - (now - datetime(1970, 1, 1) - timedelta(minutes=minutes)) % timedelta(minutes=every)
        want = {u for u, t in kept if end - timedelta(minutes=minutes) <= t < end}
        assert users(windows.active_in(panes, now, minutes, every)) == want, m
        assert users(windows.active_in(panes, str(now), minutes, every)) == want, m
        if end in {r["end"] for r in recent.select("end").distinct().collect()}:
            assert users(windows.active_at(recent, now)) <= want, m


def test_the_stream_of_active_users_keeps_an_event_once(spark, tmp_path, monkeypatch):
    import duckdb

    from lectern.plans import ORACLES, QUERIES

    end = datetime(2024, 1, 30, 22)
    edges = [end - timedelta(minutes=2000), end - timedelta(minutes=2000, microseconds=1), end - timedelta(microseconds=1), end, end + timedelta(days=1)]
    rows = [(i, i, t) for i, t in enumerate(edges)] + [(i, 100 + i % 40, end - timedelta(minutes=97 * i)) for i in range(100)]
    queries, keep = [], windows.keep
    monkeypatch.setattr(windows, "keep", lambda *a, **b: queries.append(keep(*a, **b)) or queries[-1])
    with duckdb.connect() as sql:
        for name, some in (("all", rows), ("old", rows[50:])):  # of the second no event is in the window
            spark.createDataFrame(some, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/{name}/events.parquet")
            sql.sql(f"create or replace view events as select * from '{tmp_path}/{name}/events.parquet/*.parquet'")
            got = sorted(r["user"] for r in QUERIES["R10_stream_active"](spark, f"{tmp_path}/{name}").collect())
            assert got == sorted(r[0] for r in sql.sql(ORACLES["R10_stream_active"]).fetchall())
            assert 0 < queries[-1].lastProgress["stateOperators"][0]["numRowsTotal"] <= len(some)


def test_an_observed_write_reports_what_an_audit_finds(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (None, 99.0), (3, None), (4, -1.0)], "k long, score double")
    rules = [Q.not_null("k"), Q.between("score", 0, 90)]
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(watch.write_observed(df, f"{tmp_path}/a", "t", rules)) == rows(Q.report(df, "t", rules))
    assert spark.read.parquet(f"{tmp_path}/a").count() == 4
    with pytest.raises(ValueError, match="2 of 4 rows"):
        watch.write_observed(df, f"{tmp_path}/b", "t", rules, most=0.3)
    assert rows(watch.write_observed(df.limit(0), f"{tmp_path}/c", "t", rules, most=0.0)) == [("t", "between", "score", 0, True), ("t", "not_null", "k", 0, True)]


def test_a_gate_stops_a_stream_of_rejects(spark, tmp_path):
    schema = "value string, timestamp timestamp"
    listener = watch.Watch()
    spark.streams.addListener(listener)
    try:
        for name, good, passed in (("bad", 50, False), ("fine", 190, True)):
            values = ['{"id_student":"1","id_site":"2","clicks":3}'] * good + ["[broken"] * (200 - good)
            spark.createDataFrame([(v, DAY) for v in values], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/in")
            rows = watch.observed(routed(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}/in")), "routes")
            query = sinks.append(rows.select("route"), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/c", once=passed, seconds=1)
            assert watch.gated(query, listener, "routes", most=0.5, least_rows=100) is passed
            assert not query.isActive
        watch.drained(spark)
        assert listener.total(query.id, "routes.rejected") == 10 and listener.report(spark).count() > 0
        listener.save(spark, f"{tmp_path}/report")
        assert not listener.kept and os.path.isdir(f"{tmp_path}/report")
    finally:
        spark.streams.removeListener(listener)
