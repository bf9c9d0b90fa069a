import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def duck():
    """run(sql, sf_dir) -> (column names, rows) over the driver's tables."""
    import duckdb

    def run(sql, sf_dir):
        con = duckdb.connect()
        for path in sorted(Path(sf_dir).glob("*.parquet")):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        rel = con.sql(sql)
        return rel.columns, rel.fetchall()

    return run


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a frame and SQL give the same bag of rows."""

    def check(df, sql, sf_dir):
        columns, rows = duck(sql, sf_dir)
        names = sorted(df.columns)
        assert names == sorted(columns)
        ours = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
        theirs = sorted(tuple(str(r[columns.index(c)]) for c in names) for r in rows)
        assert ours == theirs

    return check
