"""One local session for all tests."""

import time

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def run_until(run, done, seconds=90):
    """Stops a streaming query that would not end by itself once done() is true."""
    end = time.time() + seconds
    while not done() and time.time() < end and run.isActive:
        time.sleep(0.3)
    failed = run.exception()
    run.stop()
    assert failed is None, failed
