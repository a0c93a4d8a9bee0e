import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(v):
    """A value that compares equal between engines."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return f"{v + 0.0:.8g}"
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def against_sql(spark, query, sql, sf="sf0.001"):
    """Rows of a query and of its SQL, by sorted column names, sorted."""
    import duckdb

    folder = f"{DATA}/{sf}"
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in Path(folder).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    df = query(spark, folder)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    order = lambda cols: sorted(range(len(cols)), key=lambda i: cols[i])
    left = sorted((tuple(plain(r[i]) for i in order(df.columns)) for r in df.collect()), key=key)
    right = sorted((tuple(plain(r[i]) for i in order(rel.columns)) for r in rel.fetchall()), key=key)
    return left, right
