"""A session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """The value of an expression over one row of columns a, b, c, ..."""
    from pyspark.sql import functions as F

    def value(function, *cells, types=None):
        names = [chr(97 + k) for k in range(len(cells))]
        schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(cells), strict=True))
        return spark.createDataFrame([cells], schema).select(function(*map(F.col, names)).alias("v")).first()["v"]

    return value
