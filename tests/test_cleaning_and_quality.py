"""Cleaning, expectations and reconciliation on small hand-made tables."""

import math

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import cleaning as C
from lectern.operators import quality as Q


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_ensure_columns_adds_only_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1)], "name string, age int")
    assert C.ensure_columns(df, ["name"]).columns == ["name", "age"]
    assert rows(C.ensure_columns(df, ["name", "disability"])) == [("a", 1, None)]


def test_audit_columns(spark):
    out = C.add_audit_columns(spark.createDataFrame([("a",)], "name string"), "set", "path")
    assert {"_ingest_at", "_ingest_date", "_source_file", "_source_dataset"} <= set(out.columns)


def test_cast_turns_bad_text_into_null(spark):
    df = spark.createDataFrame([(" 7 ", "x"), ("?", " y"), (None, None)], "date string, note string")
    got = C.cast_columns(C.trim_strings(df), {"date": "int", "absent": "int"}).collect()
    assert [tuple(r) for r in got] == [(7, "x"), (None, "y"), (None, None)]


def test_silver_is_the_same_for_repeated_ingests(spark):
    df = spark.createDataFrame([("1", " 3", "9"), ("1", "3", "9")], "id_student string, sum_click string, score string")
    one = C.to_silver(C.add_audit_columns(df, "d", "first"), "t")
    assert one.count() == 1
    r = one.first()
    assert (r["sum_click"], r["score"], len(r["id_student"]), r["_silver_source_table"]) == (3, 9.0, 64, "t")


def test_cutoffs_and_nulls(spark):
    df = spark.createDataFrame([(d,) for d in (None, 8, 9, 15, 16)], "date int")
    assert rows(C.until(df, "date", 15)) == [(15,), (8,), (9,)]
    assert rows(C.recent(df, "date", 15)) == [(15,), (9,)]
    assert rows(C.open_until(df, "date", 15)) == [(15,), (8,), (9,), (None,)]


def test_first_by_key_and_nan(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 1.0), (2, float("nan")), (2, None)], "k int, v double")
    assert rows(C.first_by_key(df.where("k = 1"), ["k"], ["v"])) == [(1, 1.0)]
    assert all(r["v"] is None or not math.isnan(r["v"]) for r in C.nan_to_null(df).collect())


def test_text_functions(spark):
    df = spark.createDataFrame([("  My File-Name!.csv", "Pass", 0.3), ("--", "Withdrawn", 0.71), (None, None, None)], "raw string, result string, risk double")
    got = df.select(X.table_name(F.col("raw")), X.target_class(F.col("result")), X.at_risk(X.target_class(F.col("result"))), X.risk_band(F.col("risk"))).collect()
    assert [tuple(r) for r in got] == [("my_file_name_csv", "Success", 0, "Safe"), ("table", "Withdrawn", 1, "High"), ("table", None, 0, None)]


def test_six_digit_pseudonym_matches_python(spark):
    import hashlib

    got = spark.range(50).select("id", X.six_digit_pseudonym(F.col("id")).alias("p")).collect()
    assert all(r["p"] == int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:6], 16) % 900000 + 100000 for r in got)


def test_expectations(spark):
    df = spark.createDataFrame([("1", "50"), (None, "101"), ("2", "many"), ("3", None)], "id string, score string")
    assert rows(Q.report(df, "t", [Q.not_null("id"), Q.between("score", 0, 100)])) == [("t", "between", "score", 2, False), ("t", "not_null", "id", 1, False)]


def test_reconcile_counts_missing_tables(spark):
    s = spark.createDataFrame([("a", 3), ("b", 1)], "table_name string, rows long")
    t = spark.createDataFrame([("a", 3), ("c", 2)], "table_name string, rows long")
    assert rows(Q.reconcile(s, t)) == [("a", 3, 3, True), ("b", 1, 0, False), ("c", 0, 2, False)]


def test_freshness_rounds_to_the_nearest_second_as_its_sql_does(spark, tmp_path):
    import duckdb

    from lectern.plans import ORACLES, QUERIES

    times = ["2024-01-30 23:59:25.261702", "2024-01-30 23:59:25.7", "2024-01-30 23:59:24.5", "2024-01-30 23:59:25.5", "1969-12-31 23:59:58.4", "1969-12-31 23:59:59.7", "2024-03-10 02:30:00.9", "9999-12-31 23:59:57.499999", None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    with duckdb.connect() as sql:
        for i, t in enumerate(times):
            at = str(tmp_path / str(i))
            for kind in ("timestamp_ntz", "timestamp"):
                older = spark.sql(f"select cast(v as {kind}) ts from values ('1900-01-01 00:00:00.1'), ({t and repr(t) or 'null'}) as t(v)")
                older.where("ts > '1950-01-01'" if t else "ts is null").write.mode("overwrite").parquet(f"{at}/events.parquet")
                sql.sql(f"create or replace view events as select * from '{at}/events.parquet/*.parquet'")
                want = sql.sql(ORACLES["DQ06_freshness"]).fetchall()
                try:
                    for other in (zone, "America/New_York"):
                        spark.conf.set("spark.sql.session.timeZone", other)
                        got = QUERIES["DQ06_freshness"](spark, at)
                        assert got.columns == ["fresh_at"] and rows(got) == want, (t, kind, other)
                finally:
                    spark.conf.set("spark.sql.session.timeZone", zone)
