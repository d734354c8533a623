"""What keeps queries in proportion to their input."""

import random

from pyspark.sql import functions as F

from recordspark import plans
from recordspark.functions import call
from recordspark.operators import frames


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_sketch_for_each_key(spark):
    df = plans.queries()["approximate_distinct"](spark, "/root/testdata/sf0.001")
    sketches = [x for x in plan(df).splitlines() if "approx_count_distinct" in x]
    assert len(sketches) == 1 and "Aggregate [l_returnflag" in sketches[0] and "l_orderkey" not in sketches[0].split("]")[0]
    assert "Expand" not in plan(df) and "count(distinct" not in plan(df)


def test_a_duration_is_matched_twice_at_most(spark):
    df = spark.createDataFrame([("P1Y",)], "s string").select(call("formatDuration", F.col("s")).alias("w"))
    # the test, and one replacement
    assert plan(df).count("^P(?:") <= 2


def test_durations_in_words(spark):
    cases = {
        "P1Y2M3DT4H5M6.5S": "1 year, 2 months, 3 days, 4 hours, 5 minutes, 6.5 seconds", "PT1.0S": "1 second", "P": "0 seconds", "PT": "0 seconds", "P0Y": "0 seconds", "PT0.04S": "0.0 seconds", "P1Y\n": "1 year", "PT5S ": "5 seconds",
        "P007D": "7 days", "P99999999999999999999D": "100000000000000000000.0 days", "": None, None: None, "1,2,3,4,5,6": None, "P1Y\nP1Y": None, "xP1Y": None, "P1.5Y": None, "p1y": None,
    }
    rows = spark.createDataFrame([(x,) for x in cases], "s string").select("s", call("formatDuration", F.col("s")).alias("w")).collect()
    assert {r.s: r.w for r in rows} == cases


def test_a_full_bin_is_cut_into_blocks(spark):
    rng = random.Random(8)
    points = [(i, rng.choice([None, 7.0, rng.uniform(0, 10), rng.uniform(-50, 200)]), {"a": i}) for i in range(400)]
    ranges = [(j, x, x + rng.choice([-1.0, 0.0, 1.0, 30.0])) for j, x in enumerate(rng.choice([7.0, rng.uniform(-1, 10), rng.uniform(-50, 200)]) for _ in range(150))]
    p, r = spark.createDataFrame(points, "i long, x double, m map<string, long>"), spark.createDataFrame([*ranges, (150, None, 1.0)], "j long, low double, high double")
    expected = sorted((i, j) for i, x, _ in points if x is not None for j, low, high in ranges if low <= x <= high)
    assert expected
    for more in ({}, {"block": 16, "pairs": 1000}, {"block": 1000, "pairs": 1}):
        out = frames.interval_join(p, r, "x", "low", "high", 20.0, **more)
        assert out.columns == ["i", "x", "m", "j", "low", "high"]
        assert sorted((x.i, x.j) for x in out.collect()) == expected
    out = frames.interval_join(p, r, "x", "low", "high", 1000.0, block=16, pairs=2000).groupBy(F.spark_partition_id()).count().collect()
    assert len(out) > 8 and max(x["count"] for x in out) < len(expected) / 3
