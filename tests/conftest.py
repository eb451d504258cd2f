import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    return folder


@pytest.fixture(scope="session")
def oracle(data):
    """Rows of DuckDB SQL over the test tables, as a pandas frame."""
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{data}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return lambda sql: con.execute(sql).df()


@pytest.fixture(scope="session")
def same():
    """Whether two frames hold the same rows, whatever their order."""

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        columns = sorted(a.columns, key=lambda c: (b[c].dtype == float, c))
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
        assert len(a) == len(b)
        for c in columns:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c

    return check
