import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("events", "part", "documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        path = f"{DATA}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether a Spark result and DuckDB rows agree, in any order."""

    def value(x):
        if x is None or x != x:
            return ""
        return f"{x:.6g}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)

    def check(df, con, sql):
        rel = con.sql(sql)
        names = list(rel.columns)
        want = sorted(tuple(value(x) for x in r) for r in rel.fetchall())
        got = sorted(tuple(value(r[c]) for c in names) for r in df.collect())
        assert sorted(df.columns) == sorted(names)
        assert got == want

    return check
