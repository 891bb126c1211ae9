"""One small session for all tests."""

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def against_sql(small):
    """A check that a query's rows equal those of its SQL over the same files."""
    import duckdb

    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")

    def rows(table):
        names = sorted(table.column_names)
        own = [tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in table.to_pylist()]
        return names, sorted(own, key=lambda r: [(v is None, str(v)) for v in r])

    def check(df, sql):
        assert rows(df.toArrow()) == rows(con.execute(sql).to_arrow_table())

    return check
