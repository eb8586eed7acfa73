from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tmp_path_factory.mktemp("checkpoint").as_uri())
        .config("spark.sql.warehouse.dir", tmp_path_factory.mktemp("warehouse").as_uri()).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def oracle(sql: str, sf: str):
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in (DATA / sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    q = c.sql(sql)
    return q.columns, q.fetchall()


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, bool) or v is None:
        return v
    return v if isinstance(v, (int, str)) else str(v)


def ordered(columns, rows) -> list:
    by = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in by) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture
def same_as_oracle(spark):
    def check(name: str, f, sql: str, sf: str = "sf0.001") -> None:
        if not (DATA / sf).exists():
            pytest.skip("no test data here")
        df = f(spark, str(DATA / sf))
        columns, rows = oracle(sql, sf)
        assert sorted(df.columns) == sorted(columns), name
        assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(columns, rows), name

    return check
