from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Compares a query with its SQL, value by value, rows in any order."""
    def plain(v):
        if isinstance(v, bool) or v is None or v != v:
            return v if isinstance(v, bool) else None
        return round(float(v), 5) + 0.0 if isinstance(v, int | float) else str(v)

    def check(query, sql: str) -> None:
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
        assert got == want

    return check
