"""One local session for all tests."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    made = (
        SparkSession.builder.master("local[4]").appName("statloom-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    from statloom.plans.lineage import ship

    ship(made)
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
