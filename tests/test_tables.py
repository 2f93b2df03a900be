"""Reads, writes and target names."""

import pytest

from outings.schemas import DDL, create_tables, empty
from outings.settings import Settings
from outings.sources.tables import (append_bronze, materialized, preview, quote, read_table, rows_to_frame, save,
                                    shared_folder, target_schema, write_snapshot)


def test_names(spark):
    assert (quote("my-catalog"), quote("`my-catalog`"), quote(" a`b ")) == ("`my-catalog`", "`my-catalog`", "`a``b`")
    assert target_schema(spark) == "`spark_catalog`.`default`"
    assert target_schema(spark, settings=Settings(catalog="c", schema="s")) == "`c`.`s`"
    assert target_schema(spark, "x", "y", Settings(catalog="c", schema="s")) == "`x`.`y`"


def test_save(spark):
    df = spark.range(3)
    settings = Settings(schema="save_test")
    first = save(df, "numbers", "append", settings=settings)
    save(df, "numbers", "append", settings=settings)
    assert first.status == "written" and spark.table(first.table).count() == 6
    assert preview(spark, first.table, 4).count() == 4
    save(df.selectExpr("id", "id * 2 AS other"), "numbers", "overwrite", settings=settings)
    assert spark.table(first.table).columns == ["id", "other"]
    failed = save(df, "numbers", "append", catalog="no_such_catalog", schema="s")
    assert failed.status == "failed" and failed.error
    with pytest.raises(Exception):
        save(df, "numbers", "append", catalog="no_such_catalog", schema="s", on_error="raise")
    assert save(df, "numbers", "append", settings=Settings(write_tables=False)).status == "skipped"


def test_tables_exist(spark):
    create_tables(spark, "ddl_test")
    create_tables(spark, "ddl_test")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN ddl_test").collect()} == set(DDL)
    for name in DDL:
        assert set(spark.table(f"ddl_test.{name}").columns) == set(empty(spark, name).columns)


def test_files(spark, tmp_path):
    path = str(tmp_path / "bronze")
    append_bronze(spark.range(2), path)
    append_bronze(spark.range(3), path)
    assert spark.read.parquet(path).count() == 5 and "_ingest_date" in spark.read.parquet(path).columns
    one, two = (write_snapshot(spark.range(n), str(tmp_path / "snap")) for n in (1, 2))
    assert one != two and read_table(spark, two).count() == 2
    assert materialized(spark.range(4), "test").count() == 4
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
    assert rows_to_frame(spark, [], "a int").columns == ["a"]


def test_environment():
    settings = Settings.from_env({"RAIN_PROB_THRESHOLD": "70", "OUTINGS_WRITE_TABLES": "False"})
    assert (settings.rain_prob_threshold, settings.aqi_threshold, settings.write_tables) == (70, 100, False)
