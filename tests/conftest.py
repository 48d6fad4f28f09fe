import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def _normal(v):
    if isinstance(v, float):
        return float("%.9g" % v)
    if v is None or isinstance(v, (int, str, bool)):
        return v
    return tuple(map(_normal, v)) if hasattr(v, "__iter__") else str(v)


@pytest.fixture(scope="session")
def against_sql(spark):
    """Runs a query and its SQL over a folder of tables and compares columns and rows, whatever their order."""
    import duckdb

    def compare(query, sql, folder):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        want = sorted((tuple(_normal(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
        df = query(spark, folder)
        assert sorted(df.columns) == sorted(names)
        got = sorted((tuple(_normal(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
        assert got == want

    return compare
