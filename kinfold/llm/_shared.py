"""What the corpus operators have in common: tables, scratch space, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that is ever broadcast on purpose. A row here is at most a few hundred bytes.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        root = Path(tempfile.gettempdir(), f"kinfold-{os.getpid()}").as_uri()
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kinfold_scratch"
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and is read by columns.

    The folder is removed when the driver's interpreter ends."""
    spark = df.sparkSession
    path = owned(spark, f"{scratch_root(spark)}/kinfold/{label}-{uuid.uuid4().hex}")
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts go to Python in batches of fewer rows, whose bytes JVM and worker hold twice each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def owned(spark: SparkSession, path: str) -> str:
    """path, which is removed when the driver's interpreter ends."""
    _written.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written_alone(make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, Callable[[], None]]:
    """(make() as a table in the shared folder, what removes it). What make() wrote on its way is removed at once."""
    first = len(_written)
    out = written(make(), label)
    for spark, path in _written[first:-1]:
        _remove(spark, path)
    del _written[first:-1]
    own = _written[-1]

    def remove() -> None:
        _remove(*own)
        _written.remove(own)

    return out, remove


def _sweep() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_sweep)


def fits(df: DataFrame) -> bool:
    """Whether df has few enough rows to be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows; beyond that Spark chooses a shuffled join."""
    return F.broadcast(df) if (fits(df) if rows is None else rows <= BROADCAST_ROWS) else df


def ship_package(spark: SparkSession) -> None:
    """Python workers import this package from a zip that Spark hands to every executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="kinfold-zip-"), "kinfold_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does that where every character is one byte."""
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, az, az.lower()))


#: Fixed by the contract of the decontamination query: what stands between words, before A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def fenced_words(c: Column) -> Column:
    """The words of a text, not yet lower-cased, with an empty string before the first and after the last.

    split() takes time in proportion to the text; regexp_extract_all() copies the text at each match."""
    return F.split(F.concat(F.lit(" "), c, F.lit(" ")), BETWEEN_WORDS)


def words(c: Column) -> Column:
    w = fenced_words(ascii_lower(c))
    return F.slice(w, F.lit(2), F.size(w) - 2)
