"""Shapes of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from outings.functions.vectors import HashEmbedder
from outings.operators.keyed import latest_per_key
from outings.plans.itinerary import list_itinerary
from outings.plans.packing import packing_suggestions
from outings.plans.quality import count_orphans, default_checks, quality_report
from outings.plans.search import global_search
from outings.plans.views import trip_bundle, trip_header
from outings.plans.weather import silver_weather, trip_weather
from outings.settings import apply_sql_settings
from outings.sources.tables import by_partition
import __spark_entry__ as spark_entry
from workload.registry import Session

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return Session(spark, SF)


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_no_cross_join(spark, name):
    shape = plan(spark_entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in shape and "BroadcastNestedLoopJoin" not in shape


def test_core_stays_in_the_jvm(t):
    for df in (trip_weather(t("v_trips"), t("v_weather")),
               packing_suggestions(t("v_trips"), t("v_weather"), t("v_items"), t("v_activities"))):
        assert not re.search("Python|MapInArrow|MapInPandas", plan(df))


def test_groups_shrink_before_the_shuffle(spark):
    shape = plan(silver_weather(spark.createDataFrame(
        [], "destination_id long, forecast_ts timestamp, us_aqi int, _ingested_at timestamp")))
    assert re.search(r"WindowGroupLimit .*Partial", shape) and re.search(r"WindowGroupLimit .*Final", shape)
    keyed = plan(latest_per_key(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], [F.col("id").desc()]))
    assert keyed.index("Final") < keyed.index("Exchange") < keyed.index("Partial")


def test_orphans_are_an_anti_join_of_counts(spark, t):
    """With a parent too large to broadcast, references are counted before the shuffle of the anti join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shape = plan(count_orphans(t("v_items"), "trip_id", t("v_trips"), "trip_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shape.index("LeftAnti") < shape.index("partial_count")


def test_one_pass_per_checked_table(t):
    tables = {"weather_snapshots": t("events").select(
        F.col("user_id").alias("destination_id"), F.col("ts").alias("forecast_ts"), F.col("event_id").alias("us_aqi"),
        F.col("event_id").alias("precipitation_prob"))}
    checks = [c for c in default_checks() if getattr(c, "table", None) == "weather_snapshots" and hasattr(c, "bad")]
    assert len(checks) == 3 and plan(quality_report(tables, checks)).count("FileScan") == 1


def test_scan_reads_only_what_it_needs(t):
    shape = plan(trip_weather(t("v_trips").where(F.col("trip_id") == 5), t("v_weather")))
    orders = next(line for line in shape.splitlines() if "orders.parquet" in line)
    assert "EqualTo(o_orderkey,5)" in orders and "o_totalprice" not in orders


def test_global_search_keeps_k_rows_per_task(t):
    assert "TakeOrderedAndProject" in plan(global_search(t("v_activities"), "museum", HashEmbedder(64)))


def test_hot_join_key_is_split(spark):
    """A third of the items refer to one activity: adaptive execution divides its partition."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        ids = spark.range(0, 300_000, 1, 8)
        items = ids.select(F.col("id").alias("item_id"), (F.col("id") % 5000).alias("trip_id"),
                           F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 997).alias("activity_id"),
                           F.lit(None).cast("date").alias("day_date"), F.concat(F.lit("t"), F.col("id")).alias("title"),
                           F.lit("planned").alias("status"), F.lit(1).alias("sort_order"))
        activities = spark.range(0, 997).select(F.col("id").alias("activity_id"), (F.col("id") % 2 == 0).alias("is_outdoor"),
                                                F.lit("c").alias("category"))
        listed = list_itinerary(items, activities)
        assert len(listed.collect()) == 300_000
        assert "skew=true" in plan(listed)
    finally:
        for key in small:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_partition_writes_are_rebalanced(spark):
    shape = plan(by_partition(spark.range(10).withColumn("day", F.col("id") % 2), "day"))
    assert "REBALANCE_PARTITIONS_BY_COL" in shape and "hashpartitioning(day" in shape


def test_entries_of_a_trip_are_gathered_before_they_meet(spark, t):
    """Only lists meet the header, and they are dealt by trip already."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(trip_bundle(trip_header(t("v_trips"), t("v_destinations")), trip_weather(t("v_trips"), t("v_weather")),
                                 t("v_items"), t("v_packing"))).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    union = next(i for i, line in enumerate(lines) if re.search(r"\bUnion$", line))
    assert "collect_list" not in "".join(lines[:union]) and "Exchange" not in lines[union - 1]


def test_tasks_read_small_partitions(spark):
    """A task reads 16 MB of a shuffle and 32 MB of a table, unless the session states another size."""
    fresh = spark.newSession()
    for key, size in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"), ("spark.sql.files.maxPartitionBytes", "32m")):
        fresh.conf.unset(key)
        assert apply_sql_settings(fresh).conf.get(key) == size
        fresh.conf.set(key, "8m")
        assert apply_sql_settings(fresh).conf.get(key) == "8m"
