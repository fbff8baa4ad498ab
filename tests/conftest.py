import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def all_hot(monkeypatch):
    """Treat nearly every key as hot, so that small tables take the salted and blocked paths."""
    from inkferry.operators import history, skew

    monkeypatch.setattr(skew, "ROWS_PER_TASK", 2)
    monkeypatch.setattr(skew, "MOST_HOT_KEYS", 10_000_000)
    monkeypatch.setattr(history, "BLOCK_ROWS", 100)
