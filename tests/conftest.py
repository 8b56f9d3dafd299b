import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def planted(spark):
    """8,000 rows with one planted single rule and one planted pair."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    n = 8000
    a, b, c = rng.uniform(0, 1, n), rng.uniform(0, 1, n), rng.integers(0, 6, n)
    p = 0.05 + 0.4 * (a > 0.8) + 0.35 * ((b > 0.6) & (c <= 1))
    month = rng.integers(1, 13, n)
    pdf = pd.DataFrame(
        {
            "entity_id": [f"e{i}" for i in range(n)],
            "snapshot_date": [f"2024-{m:02d}-01" for m in month],
            "segment": rng.choice(["A", "B", "C"], n, p=[0.6, 0.3, 0.1]),
            "target": (rng.uniform(0, 1, n) < p).astype("int32"),
            "f_a": a,
            "f_b": np.where(rng.uniform(0, 1, n) < 0.05, np.nan, b),
            "f_c": c.astype("float64"),
        }
    )
    return spark.createDataFrame(pdf).repartition(4).cache()
