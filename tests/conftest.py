"""One local session for all tests, with folders of its own."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.local.dir", str(home)).config("spark.sql.warehouse.dir", f"{home}/warehouse").config("spark.checkpoint.dir", f"file://{home}/shared")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def _plain(value):
    """A value as text that both engines agree on."""
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_plain, value)) + "]"
    if isinstance(value, dict):
        return _plain(list(value.values()))
    if type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    return str(value)


@pytest.fixture(scope="session")
def same(spark):
    """Compares a query with its SQL in DuckDB."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")

    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        ours = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        theirs = sorted(tuple(_plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in cursor.fetchall())
        assert sorted(names) == columns
        assert ours == theirs

    return check
