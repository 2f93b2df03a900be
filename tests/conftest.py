import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from outings.settings import apply_sql_settings, ship_packages

    warehouse = tmp_path_factory.mktemp("warehouse")
    builder = (SparkSession.builder.master("local[8]").appName("outings-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.warehouse.dir", str(warehouse))
               .config("spark.checkpoint.dir", os.environ.get("TEST_SHARED", str(tmp_path_factory.mktemp("shared")))))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_packages(apply_sql_settings(session))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seeds(spark):
    from seeds import seed_tables

    return {name: df.cache() for name, df in seed_tables(spark).items()}
