import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("STEPLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="steploom-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            p = f"{data}/{f}" + ("/*.parquet" if os.path.isdir(f"{data}/{f}") else "")
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with the result of SQL, whatever the order of rows and columns."""

    def rows(pdf):
        pdf = pdf.convert_dtypes()[sorted(pdf.columns)]
        return sorted(map(tuple, pdf.astype(str).values))

    def check(df, sql):
        a, b = df.toPandas(), duck.execute(sql).fetchdf()
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
