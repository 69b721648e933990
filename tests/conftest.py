from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session", autouse=True)  # types are parsed by an active session
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"file://{shared}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
