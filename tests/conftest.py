"""A session for all tests; SF_DIR names the tables they read."""

import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.local.dir": where, "spark.sql.warehouse.dir": f"{where}/warehouse", "spark.checkpoint.dir": f"{where}/shared", "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
