import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("boxstats-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def box():
    import boxstats as bs

    return bs.Box(256.0, 0.3, 1.0)


class Cloud:
    """Points on a fine lattice with a pile of copies and a dense clump, and brute force."""

    def __init__(self, n=600, seed=1, size=256.0):
        rng = np.random.default_rng(seed)
        self.size, self.n = size, n
        x = rng.integers(0, 4096, (n, 3)) / 16.0
        third = n // 3
        x[:third] = x[0]
        x[third : third + n // 4] = (x[third] + rng.integers(0, 128, (n // 4, 3)) / 16.0) % size
        self.x = x
        self.v = rng.integers(-1000, 1000, (n, 3)).astype(float)

    def frame(self, spark, key="pid"):
        columns = {key: np.arange(self.n)}
        columns |= {f"x{i}": self.x[:, i] for i in range(3)}
        columns |= {f"v{i}": self.v[:, i] for i in range(3)}
        return spark.createDataFrame(pd.DataFrame(columns))

    def d2(self, other=None):
        y = self.x if other is None else other
        d = np.abs(self.x[:, None] - y[None])
        d = np.minimum(d, self.size - d)
        return (d * d).sum(-1)


@pytest.fixture(scope="session")
def cloud():
    return Cloud()


@pytest.fixture(scope="session")
def cloud_df(spark, cloud):
    return cloud.frame(spark).cache()


@pytest.fixture()
def points(spark):
    def make(rows, v=None):
        x = np.array(rows, float).reshape(-1, 3)
        v = np.zeros_like(x) if v is None else np.array(v, float).reshape(-1, 3)
        data = {"pid": np.arange(len(x))}
        data |= {f"x{i}": x[:, i] for i in range(3)}
        data |= {f"v{i}": v[:, i] for i in range(3)}
        return spark.createDataFrame(pd.DataFrame(data))

    return make
