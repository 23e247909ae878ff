import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def same_rows(sf_dir):
    """Compares a DataFrame with DuckDB SQL over the test tables, whatever the row order."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        name = t.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{t}'")

    def rows(f):
        cols = sorted(f.columns)
        return sorted(tuple("-" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in f[cols].itertuples(index=False))

    def check(df, sql):
        got, want = df.toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
