import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", f"{tmp}/local").config("spark.checkpoint.dir", f"file://{tmp}/shared")
        .config("spark.sql.warehouse.dir", f"{tmp}/warehouse").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value, digits=9):
    """Values that compare alike whichever engine they come from."""
    if isinstance(value, float):
        return round(value, digits) if value == value else "nan"
    if isinstance(value, list | tuple):
        return tuple(plain(v, digits) for v in value)
    return bytes(value) if isinstance(value, bytearray) else value


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        if p.suffix == ".parquet":
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def assert_same(spark, run, sql, sf_dir):
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    c = duck(sf_dir).execute(sql)
    found = [d[0] for d in c.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in c.fetchall()), key=repr)
