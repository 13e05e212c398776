import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def same(ours, theirs):
    """Rows of two pandas frames as sorted tuples of text, numbers to six places."""
    import pandas as pd

    def text(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "null"
        if isinstance(v, str):
            return v
        return f"{round(float(v), 6) + 0.0:.6f}"

    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    rows = [sorted(tuple(map(text, r)) for r in f[cols].itertuples(index=False, name=None)) for f in (ours, theirs)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]
