from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    base = "/root/testdata/sf0.001"
    for t in TABLES:
        path = f"{base}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(fixed(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Whether a query and its SQL have the same columns and rows on the smallest tables."""

    def check(query, sql):
        mine = query(spark, "/root/testdata/sf0.001")
        theirs = duck.sql(sql)
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert _rows(mine.columns, [tuple(r) for r in mine.collect()]) == _rows(theirs.columns, theirs.fetchall())

    return check
