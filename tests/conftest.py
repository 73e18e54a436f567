import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(rows):
    def plain(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck, sf):
    """Compare a query with its SQL, on the small tables."""

    def check(query, sql):
        got = query(spark, sf)
        columns = sorted(got.columns)
        want = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql}) q").fetchall()
        rows = [tuple(r) for r in got.select(*columns).collect()]
        assert canonical(rows) == canonical(want)
        return len(rows)

    return check
