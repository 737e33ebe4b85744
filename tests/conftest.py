import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"{folder}/checkpoint", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def same_rows(got, expected):
    """Both data frames hold the same rows, in any order."""
    assert sorted(got.columns) == sorted(expected.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a, b = (sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=key) for df in (got, expected))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and isinstance(v, (int, float)) and abs(u - v) < 2e-6 * max(1, abs(u))), (x, y)
