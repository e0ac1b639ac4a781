import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    tmp = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tmp).config("spark.sql.warehouse.dir", f"{tmp}/warehouse").config("spark.checkpoint.dir", f"file://{tmp}/shared").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def same_rows():
    """Compare a Spark result with a SQL text run by DuckDB on the same tables."""
    import datetime
    import decimal
    import glob

    import duckdb

    def plain(v):
        if isinstance(v, float):
            return round(v, 9)
        if isinstance(v, decimal.Decimal):
            return int(v)
        return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v

    def rows(names, columns):
        return sorted(repr([plain(v) for v in r]) for r in zip(*columns, strict=True))

    def check(df, sql, sf_dir):
        con = duckdb.connect()
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
        got, want = df.toArrow(), con.execute(sql).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        names = sorted(got.column_names)
        a, b = (rows(names, [t.column(c).to_pylist() for c in names]) for t in (got, want))
        assert len(a) == len(b)
        assert a == b

    return check
