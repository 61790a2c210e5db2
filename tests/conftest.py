import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Makes (symbol, seq, <names>) from {symbol: rows}."""

    def make(values, *names):
        rows = [(s, k, *map(float, v if isinstance(v, (tuple, list)) else (v,))) for s, vs in values.items() for k, v in enumerate(vs, 1)]
        return spark.createDataFrame(rows, "symbol string, seq int, " + ", ".join(f"{n} double" for n in names))

    return make
