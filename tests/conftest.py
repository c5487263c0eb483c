"""One local session for all tests; its shared folder is a new temporary one."""

import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-tests-")
    builder = SparkSession.builder.master("local[4]").appName("tests")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.codegen.maxFields": "60", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
