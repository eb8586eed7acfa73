"""A folder that driver and executors share, for state that a query makes for itself. It goes when the driver ends."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, label: str) -> str:
    """Below spark.checkpoint.dir; where that is unset, a local one in local mode, else one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.split("[")[0] == "local"
        root = Path(tempfile.gettempdir(), f"kinfold-{os.getpid()}").as_uri() if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kinfold"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


_made: list[tuple[SparkSession, str]] = []


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def passes(tables: Iterable[DataFrame], each: int = 512 << 20, most: int = 8) -> int:
    """How often tables of so many bytes are read, for shuffle files of about `each` bytes of them at a time."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    return max(1, min(most, -(-size // each)))


def share(rows: DataFrame, k: int, n: int, *key: str) -> DataFrame:
    """The rows of each n-th key: all k from 0 to n - 1 have each row once, and all rows of a key together."""
    return rows if n == 1 else rows.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k)


def put(df: DataFrame, path: str, *more: DataFrame) -> DataFrame:
    """df written to path, and read again. more: are added to it, one after the other."""
    with shuffles_removed(df.sparkSession):
        for x in (df, *more):
            x.write.mode("error" if x is df else "append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Work tables below root: each is written once, and goes with `drop` when nothing reads it any more."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._paths: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame, *more: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df = put(df, path, *more)
        self._paths.append((df, path))
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Removes those of the tables that were written here; what is made from them can't be read any more."""
        for _, path in [x for x in self._paths if any(x[0] is t for t in tables)]:
            remove(self.spark, path)
        self._paths = [x for x in self._paths if not any(x[0] is t for t in tables)]

    def since(self) -> Callable[..., None]:
        """What removes the tables that are written from now on until it is called, but those that it is given."""
        before = {path for _, path in self._paths}
        return lambda *but: self.drop(*(t for t, path in self._paths if path not in before and not any(t is x for x in but)))


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_sweep)
