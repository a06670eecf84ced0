"""One Spark session for all tests."""

from __future__ import annotations

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession

import folio

cloudpickle.register_pickle_by_value(folio)

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
LARGEST = "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
