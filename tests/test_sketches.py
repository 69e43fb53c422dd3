"""Merged daily sketches against exact results, and odd rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators import sketches as K

SCHEMA = "kind string, ts timestamp, value double, user_id long"


def test_merged_days_are_within_the_stated_bounds(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), datetime(2024, 1, 1) + timedelta(days=rng.randrange(20)), rng.lognormvariate(0, 2), rng.randrange(5000)) for _ in range(40_000)]
    mart = K.daily(spark.createDataFrame(rows, SCHEMA), ["kind"], "ts", "value", "user_id").cache()
    assert mart.count() == 40 and mart.agg(F.max(F.octet_length("quantile_sketch"))).first()[0] < 20_000
    for first, last in ((None, None), ("2024-01-04", "2024-01-10"), ("2024-01-20", None)):
        period = [r for r in rows if (first is None or str(r[1].date()) >= first) and (last is None or str(r[1].date()) <= last)]
        for r in K.merged(mart, ["kind"], first, last).select("kind", "rows", "low", "high", K.distinct().alias("n"), *[K.quantile(s / 100).alias(f"q{s}") for s in (1, 25, 50, 75, 99)]).collect():
            mine = sorted(x[2] for x in period if x[0] == r["kind"])
            users = len({x[3] for x in period if x[0] == r["kind"]})
            assert (r["rows"], r["low"], r["high"]) == (len(mine), mine[0], mine[-1]) and abs(r["n"] - users) <= 0.03 * users
            for s in (1, 25, 50, 75, 99):
                assert abs(sum(v <= r[f"q{s}"] for v in mine) / len(mine) - s / 100) < 0.03


def test_nulls_and_empty_tables(spark):
    rows = [("a", None, 1.0, 1), ("a", datetime(2024, 1, 1), None, None), (None, datetime(2024, 1, 1), float("nan"), 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["kind"]: (r["low"], r["median"], r["high"]) for r in K.box(K.daily(df, ["kind"], "ts", "value", "user_id"), ["kind"]).collect()}
    assert got == {"a": (1.0, 1.0, 1.0), None: (None, None, None)}
    assert K.merged(K.daily(df.limit(0), ["kind"], "ts", "value", "user_id"), ["kind"]).count() == 0
