"""Routing, sessions, streams and files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators.quality import ColumnCountError
from lectern.sources import inventory, readers, writers
from lectern.streaming import events as E
from lectern.streaming import sinks, state

CASES = [
    ('{"id_student":"a","id_site":"5","clicks":2}', "clicks"), ('{"clicks":"invalid","sum_click":1}', "rejected"), ('{"id_student":"a","cl', "rejected"),
    ('{"id_student":"a","sum_click":5}', "clicks"), ('{"event_type":"click","sum_click":3}', "clicks"), ('{"event_type":null,"clicks":1}', "clicks"), ("[1,2]", "rejected"),
    ('{"id_site":[1],"clicks":1}', "rejected"), ('{"event_type":"assessment_submission","score":80}', "assessment"), (None, "rejected"), ("", "rejected"), ('{"event_type":"click"}', "rejected"),
]


def test_every_record_has_one_route(spark):
    df = spark.createDataFrame([(v, datetime(2024, 1, 1)) for v, _ in CASES], "value string, timestamp timestamp")
    got = {(r["json_payload"], r["route"]) for r in E.routed(df).collect()}
    assert got == {(v, r) for v, r in CASES}


def test_strict_routing_needs_clicks(spark):
    df = spark.createDataFrame([('{"sum_click":5}', datetime(2024, 1, 1))], "value string, timestamp timestamp")
    assert E.routed(df, strict=True).first()["route"] == "rejected"


def test_session_gap_of_exactly_thirty_minutes_is_one_session(spark):
    t = datetime(2024, 1, 1, 10)
    times = [t, t + timedelta(minutes=29, seconds=59), t + timedelta(minutes=59, seconds=59), t + timedelta(minutes=90)]
    rows = [(f'{{"id_student":"a","clicks":1,"event_time":"{x:%Y-%m-%dT%H:%M:%SZ}"}}', t) for x in times]
    got = E.sessions(E.routed(spark.createDataFrame(rows, "value string, timestamp timestamp"))).orderBy("session_start").collect()
    assert [(r["events"], r["sum_click"]) for r in got] == [(3, 3), (1, 1)]


def test_stream_equals_batch_and_state_folds(spark, tmp_path):
    t = datetime(2024, 1, 1, 10)
    rows = [(f'{{"id_student":"u{i % 3}","clicks":{i}}}', t + timedelta(minutes=i)) for i in range(12)] + [('{"event_type":"assessment_submission","id_student":"u0","score":100}', t + timedelta(minutes=13)), ("{bad", t)]
    spark.createDataFrame(rows, "value string, timestamp timestamp").write.parquet(f"{tmp_path}/in")
    stream = E.routed(E.source(spark, "parquet", {"path": f"{tmp_path}/in"}))
    for q in sinks.start_job(stream, f"{tmp_path}/out", once=True):
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/assessments").count() == 1
    assert [r["reason"] for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()] == ["malformed"]
    # a late flush event closes what is open: in append mode a session ends when the watermark passes it
    assert spark.read.schema("sum_click string").parquet(f"{tmp_path}/out/clicks").count() == 0

    def write(batch, batch_id):
        batch.write.mode("append").parquet(f"{tmp_path}/state")  # a batch without data closes the run

    state.learner_state(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {r["effective_id"]: r for r in spark.read.parquet(f"{tmp_path}/state").collect()}
    assert got["u0"]["total_clicks"] == 0 + 3 + 6 + 9 and got["u0"]["submission_count"] == 1 and got["u0"]["mastery"] > 0.9 and got["u1"]["mastery"] == 0.4


def test_header_cleaning(spark, tmp_path):
    assert readers.clean_header(["﻿col1", " col2 ", "  ", " col4"]) == ["col1", "col2", "col_2", "col4"]
    assert readers.clean_header(["", "a"]) == ["_row_idx", "a"]
    f = tmp_path / "t.csv"
    f.write_text(',b ,\n1,x,"a, b"\n2,,\n', encoding="utf-8-sig")
    got = readers.read_csv(spark, str(f))
    assert got.columns == ["_row_idx", "b", "col_2"] and sorted(tuple(r) for r in got.collect()) == [("1", "x", "a, b"), ("2", None, None)]


def test_inventory_routes_and_prefers_the_root_copy(spark, tmp_path):
    root = tmp_path / "raw"
    for name in ("OULAD/courses.csv", "EdNet/KT1/u1.csv", "EdNet/KT1/u2.csv", "EdNet/contents/lectures.csv", "SED/Student_log.csv", "Test_Bank.json", "deep/er/Test_Bank.json", "Data/c1/a.md", "notes.bin"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    got = inventory.discover(spark, str(root)).collect()
    assert sorted((r["table_name"], r["relative_path"]) for r in got) == [
        ("content_documents", "Data/c1/a.md"), ("content_test_bank", "Test_Bank.json"), ("ednet_kt1_events", "EdNet/KT1/u1.csv"), ("ednet_kt1_events", "EdNet/KT1/u2.csv"),
        ("ednet_lectures", "EdNet/contents/lectures.csv"), ("oulad_courses", "OULAD/courses.csv"), ("sed_student_log", "SED/Student_log.csv"),
    ]


def test_compaction_counts_rows(spark, tmp_path):
    assert writers.compact(spark.range(1000).repartition(20), f"{tmp_path}/c", 2) == 1000
    assert len(list((tmp_path / "c").glob("part-*"))) == 2


def test_files_of_other_columns_fail_the_scan(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "x,y\n3,4\n")):
        (tmp_path / name).write_text(text)
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path)).collect()) == [("1", "2"), ("3", "4")]
    for other in ("x,y,z\n5,6,7\n", "x\n5\n", "y,x\n5,6\n"):
        (tmp_path / "c.csv").write_text(other)
        with pytest.raises(Exception, match="CSV header|header of"):
            readers.read_csv(spark, str(tmp_path)).collect()
    assert issubclass(ColumnCountError, ValueError)


def test_a_quoted_line_end_stays_in_its_field(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"two\nlines"\n2,x\n')
    got = readers.read_csv(spark, f"{tmp_path}/a.csv", multiline=True)
    assert sorted(tuple(r) for r in got.collect()) == [("1", "two\nlines"), ("2", "x")]


def test_banks_below_the_root_and_strategies(spark, tmp_path):
    root = tmp_path / "raw"
    for name in ("EdNet/Question_Bank.json", "Question_Bank.json", "EdNet/Lecture_Bank.json", "Data/Chapter 1/Some Notes.md", "OULAD/studentVle.csv", "Data/x.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    got = {(r["table_name"], r["relative_path"].split("/")[-1], r["partition_hint"], r["strategy"]) for r in inventory.discover(spark, str(root)).collect()}
    assert got == {
        ("content_question_bank", "Question_Bank.json", "_ingest_date", "json"), ("ednet_lecture_bank", "Lecture_Bank.json", "_ingest_date", "json"),
        ("content_documents", "Some Notes.md", "chapter", "markdown:some_notes"), ("oulad_studentvle", "studentVle.csv", "code_module", "csv"),
    }


def test_broker_options():
    got = E.kafka_options("h:9092", "events", startingOffsets="earliest")
    assert got == {"kafka.bootstrap.servers": "h:9092", "subscribe": "events", "startingOffsets": "earliest", "failOnDataLoss": "false"}
    assert E.kafka_options("h:9092", "events")["startingOffsets"] == "latest"


def test_state_of_idle_learners_is_dropped():
    class State:
        hasTimedOut, exists, removed = True, True, False

        def remove(self):
            self.removed = True

    held = State()
    assert list(state._update(("u",), iter(()), held, 1)) == [] and held.removed
