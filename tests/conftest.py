import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
os.environ.setdefault("TZ", "UTC")
DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(data).iterdir():
        con.sql(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(value):
    """A value that compares equal across engines."""
    import pandas as pd

    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    if isinstance(value, float):
        return round(value, 5)
    if hasattr(value, "item"):
        return plain(value.item())
    return value


@pytest.fixture(scope="session")
def same_rows():
    def check(ours, theirs):
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        a, b = (sorted((tuple(plain(v) for v in row) for row in d[columns].itertuples(index=False)), key=repr) for d in (ours, theirs))
        assert a == b

    return check
