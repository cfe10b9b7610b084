from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    conf = {
        "spark.master": "local[4]",
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def agree(spark, duck) -> Callable:
    """Compares a query with its SQL: names, and rows in any order, exactly."""

    def compare(query: Callable, sql: str) -> None:
        df = query(spark, str(DATA))
        names = sorted(df.columns)
        cursor = duck.execute(sql)
        theirs = [c[0] for c in cursor.description]
        assert names == sorted(theirs)
        at = [theirs.index(n) for n in names]
        key = lambda row: [(x is None, repr(x)) for x in row]
        ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
        assert ours == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=key)

    return compare
