"""Compaction by size that stops at every step, and plans over buckets that exchange nothing."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import bkt
from lectern.operators.ranges import placed
from lectern.plans import storage
from lectern.sources import versions, writers


def filled(spark, root):
    versions.add(spark.range(0, 4000).withColumn("v", F.sha2(F.col("id").cast("string"), 512)).coalesce(1), root)
    versions.add(spark.range(4000, 4100).withColumn("v", F.lit("x")).repartition(9), root)
    return {r["path"] for r in versions.file_list(spark, root).collect()}


def whole(spark, root):
    return versions.read(spark, root).agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first() == (4100, 4100, 0, 4099)


def test_small_files_are_packed_and_large_ones_stay(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert versions.version(spark, root) == 0
    before = filled(spark, root)
    assert len(before) == 10 and versions.version(spark, root) == 2
    assert versions.compact(spark, root, small=50_000, target=1 << 20) == 9
    after = {r["path"] for r in versions.file_list(spark, root).collect()}
    assert len(after) == 2 and len(after & before) == 1 and whole(spark, root) and versions.version(spark, root) == 3
    assert versions.compact(spark, root, small=50_000, target=1 << 20) == 0 and versions.version(spark, root) == 3
    assert versions.vacuum(spark, root) == 9 and whole(spark, root) and versions.vacuum(spark, root) == 0


def test_bins_follow_the_target(spark, tmp_path):
    root = f"{tmp_path}/t"
    filled(spark, root)
    one = versions.sizes(spark, f"{root}/data").where("length < 50000").agg(F.max("length")).first()[0]
    versions.compact(spark, root, small=50_000, target=3 * one)
    files = versions.file_list(spark, root).count()
    assert 3 <= files <= 5 and whole(spark, root)


@pytest.mark.parametrize("step", ["sizes", "running", "_written", "commit", "rename", "collect"])
def test_a_crash_at_any_step_leaves_a_whole_table_and_a_retry_succeeds(spark, tmp_path, monkeypatch, step):
    root = f"{tmp_path}/t"
    filled(spark, root)

    def crash(*args, **options):
        raise OSError("gone")

    with monkeypatch.context() as m:
        if step == "rename":  # the version is written but not named
            files = versions._files
            m.setattr(versions, "_files", lambda s, f: crash() if f.endswith("/3") else files(s, f))
        elif step == "collect":  # the new files are written, their listing fails
            written = versions._written
            m.setattr(versions, "_written", lambda d, r: crash() if written(d, r) else None)
        else:
            m.setattr(versions, step, crash)
        with pytest.raises(OSError):
            versions.compact(spark, root, small=50_000, target=1 << 20)
    assert versions.version(spark, root) == 2 and whole(spark, root)
    assert versions.compact(spark, root, small=50_000, target=1 << 20) == 9
    assert versions.version(spark, root) == 3 and whole(spark, root)
    versions.vacuum(spark, root)
    assert whole(spark, root) and versions.sizes(spark, f"{root}/data").count() == 2


def test_two_jobs_cannot_make_the_same_version(spark, tmp_path):
    root = f"{tmp_path}/t"
    filled(spark, root)
    with pytest.raises(RuntimeError):
        versions.commit(spark, root, versions.file_list(spark, root), 1)
    assert whole(spark, root) and versions.version(spark, root) == 2


def test_features_of_bucketed_tables_exchange_nothing(spark):
    keys = storage.F_KEYS
    schema = "id_student int, code_module string, code_presentation string, "
    rows = [(i % 40, "AAA" if i % 3 else "BBB", "2013J", i % 20, 1) for i in range(400)]
    clicks = spark.createDataFrame([(*r, r[0]) for r in rows], schema + "date int, sum_click int, id_site int")
    people = clicks.select(*keys).distinct().cache()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kind, df in (("info", people), ("reg", people.withColumn("date_registration", F.lit(-3))), ("clicks", clicks)):
            writers.write_bucketed(df, f"bucketed_{kind}", keys, 4)
        found = storage.bucketed_features(spark, "bucketed")
        got = {tuple(r)[:3]: (r["total_clicks"], r["active_days"], r["date_registration"]) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") >= 3, plan
        early = [r for r in rows if r[3] <= 15]
        assert got == {k: (sum(1 for r in early if r[:3] == k), len({r[3] for r in early if r[:3] == k}), -3) for k in {r[:3] for r in rows}}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for kind in ("info", "reg", "clicks"):
            spark.sql(f"drop table if exists bucketed_{kind}")


def test_a_learner_with_half_of_the_rows_is_many_tasks(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("user_id"), F.lit("s").alias("skill_name"), "id", (F.col("id") % 3 == 0).cast("int").alias("correct"))
    found = placed(rows, bkt.KEYS, ["id"])
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 0.4 * 40_000, sizes
    hot = found.where("user_id = 7").agg(F.count("*"), F.min("place"), F.max("place"), F.count_distinct("place"), F.max("n")).first()
    assert hot[0] == hot[3] == hot[4] == hot[2] + 1 and hot[1] == 0
