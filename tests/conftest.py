import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same_rows(a, b):
    """Rows of two pandas frames, regardless of order, columns by name."""
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)

    def plain(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v

    def rows(f):
        f = f[columns].astype(object)
        return sorted(repr(tuple(None if x is None or x is x and str(x) in ("nan", "<NA>", "NaT") else plain(x.item() if hasattr(x, "item") else x) for x in r)) for r in f.values.tolist())

    return rows(a) == rows(b)
