import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS FROM '{SMALL}/{t}'")
    return c


def plain(v):
    """A value as both engines show it."""
    if v is None or str(v) == "<NA>" or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(int(v)) if hasattr(v, "is_integer") and v == int(v) else str(v)


def multiset(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="session")
def compare():
    return multiset
