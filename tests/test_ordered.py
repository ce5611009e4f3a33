"""Ordered calculations in parts equal plain windows, also when one group holds most rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from markspan.operators import events, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows, seen = [], set()
    while len(rows) < 3000:
        group = 1 if rng.random() < 0.4 else rng.randrange(2, 60)
        pos = rng.randrange(0, 20000)
        if (group, pos) not in seen:
            seen.add((group, pos))
            rows.append((group, pos, rng.choice([None, 1.0, 2.0, 3.0, 4.0])))
    return spark.createDataFrame(rows, "g bigint, o bigint, v double").repartition(5)


def along():
    return Window.partitionBy("g").orderBy("o")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("rows", [40, 300, 10**6])
def test_numbers(skewed, rows):
    got = ordered.number_rows(skewed, ["g"], [F.col("o")], "n", "t", rows)
    want = skewed.withColumn("n", F.row_number().over(along()).cast("bigint")).withColumn("t", F.count("*").over(Window.partitionBy("g")))
    same(got.select("g", "o", "n", "t"), want.select("g", "o", "n", "t"))


@pytest.mark.parametrize("rows", [40, 10**6])
def test_running_max_sum_and_previous_value(skewed, rows):
    top = ordered.running_max(skewed, ["g"], [F.col("o")], F.col("v"), "m", rows)
    before = ordered.previous_value(skewed, ["g"], [F.col("o")], F.col("v"), "p", rows)
    total = ordered.running_sum(skewed, ["g"], [F.col("o")], F.col("o"), "s", rows)
    upto = along().rowsBetween(Window.unboundedPreceding, 0)
    same(top.select("g", "o", "m"), skewed.select("g", "o", F.max("v").over(upto)))
    same(before.select("g", "o", "p"), skewed.select("g", "o", F.lag("v").over(along())))
    same(total.select("g", "o", "s"), skewed.select("g", "o", F.sum("o").over(upto) - F.col("o")))


@pytest.mark.parametrize("rows", [1, 100])
def test_null_keys_and_orders_stay(spark, rows):
    df = spark.createDataFrame([(None, 5), (None, None), (1, None), (1, 3), (1, 70), (2, 9)], "g bigint, o bigint")
    got = ordered.number_rows(df, ["g"], [F.col("o")], "n", "t", rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, None, 1, 2), (None, 5, 2, 2), (1, None, 1, 3), (1, 3, 2, 3), (1, 70, 3, 3), (2, 9, 1, 1)], key=repr)
    top = ordered.running_max(df, ["g"], [F.col("o")], F.col("o"), "m", rows)
    assert sorted(map(tuple, top.collect()), key=repr) == sorted([(None, None, None), (None, 5, 5), (1, None, None), (1, 3, 3), (1, 70, 70), (2, 9, 9)], key=repr)


def test_no_rows_and_maps_among_the_columns(spark):
    df = spark.createDataFrame([(1, k, {"a": str(k)}) for k in range(9)], "g bigint, o bigint, m map<string,string>")
    assert [r["n"] for r in ordered.number_rows(df, ["g"], [F.col("o")], rows=2).orderBy("o").collect()] == list(range(1, 10))
    assert ordered.number_rows(df.filter("g > 1"), ["g"], [F.col("o")], rows=2).collect() == []


@pytest.mark.parametrize("step", ["0", "id"])
@pytest.mark.parametrize("rows", [100, 10**6])
def test_progress_along_times(spark, step, rows, monkeypatch):
    """Distinct seconds over days, and one single time for all."""
    monkeypatch.setattr(ordered.number_rows, "__defaults__", ("n", None, rows))
    log = spark.range(4000).selectExpr(
        "id", "if(id % 3 = 0, id % 7, null) AS submission_id", f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {step} * 97) AS created_at",
        "'page_progress' AS action",
    )
    got = events.running_progress(log).select("submission_id", "id", "completed", "total")
    w = Window.partitionBy("submission_id")
    want = log.select("submission_id", "id", F.row_number().over(w.orderBy("created_at", "id")).cast("bigint").alias("completed"), F.count("*").over(w).alias("total"))
    same(got, want)


# A group that holds all rows: sparse ids, one single time, no order at all.
HOT = {"dense": "id", "sparse": "id * 1000000", "one time": "cast(7 AS bigint)", "null": "cast(null AS bigint)"}


@pytest.mark.parametrize("kind", HOT)
def test_no_part_holds_more_than_its_share_of_a_hot_group(spark, kind):
    rows = spark.range(20_000).selectExpr("cast(1 AS bigint) AS g", f"{HOT[kind]} AS o", "id").repartition(3)
    parts = ordered.in_parts(rows, ["g"], ["o"], 1000, 20_000).groupBy(ordered._PART).count().collect()
    assert len(parts) == 20 and max(r["count"] for r in parts) <= 2000


@pytest.mark.parametrize("kind", ["sparse", "one time"])
def test_executed_windows_see_parts_only(spark, kind):
    """The tasks of the executed plan's windows: none has more than a share of the hot group."""
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        rows = spark.range(20_000).selectExpr("cast(1 AS bigint) AS g", f"{HOT[kind]} AS o", "id")
        out = ordered.number_rows(rows, ["g"], [F.col("o"), F.col("id")], rows=1000)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"windowspecdefinition\(g#\d+L?, __part#\d+", plan)
        tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.min("n"), F.max("n")).collect()
        assert len(tasks) > 8 and max(r["rows"] for r in tasks) <= 5000
        assert sorted(r["n"] for r in out.collect()) == list(range(1, 20_001))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_errors_of_one_submission_without_page(spark):
    """Equal messages without page are dealt over tasks, and each keeps its number."""
    errors = spark.range(3 * events.RUN).selectExpr("cast(1 AS bigint) AS submission_id", "if(id < 5, id, null) AS page", "if(id % 2 = 0, 'late', 'lost') AS message")
    changed = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = events.error_rollup(errors, 2)
        tasks = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", changed)
    assert max(r["count"] for r in tasks) <= 2 * events.RUN
    got = out.agg(F.count("*").alias("n"), F.countDistinct("n").alias("d"), F.max("n").alias("m"), F.min_by("error", "n").alias("first"), F.max_by("error", "n").alias("last")).first()
    assert tuple(got) == (3 * events.RUN, 3 * events.RUN, 3 * events.RUN, "Page None: late", "Page 4: late")


def test_latest_events_cut_rows_before_the_shuffle(spark):
    log = spark.range(1000).selectExpr("id", "id % 3 AS submission_id", "timestamp_ntz'2024-01-01 00:00:00' AS created_at")
    plan = events.latest_events(log, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("limit", [10, 1001])
def test_latest_events_keep_rows_without_submission(spark, limit):
    log = spark.createDataFrame([(1, None), (2, None), (3, 5)], "id bigint, submission_id bigint").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    assert events.latest_events(log, limit).count() == 3


def test_many_newest_events_meet_in_cut_groups(spark):
    log = spark.range(30_000).selectExpr("id", "cast(1 AS bigint) AS submission_id", "timestamp_ntz'2024-01-01 00:00:00' AS created_at")
    out = events.latest_events(log, 1500)
    assert sorted((r["id"], r["recency"]) for r in out.collect()) == [(30_000 - k, k) for k in range(1500, 0, -1)]
