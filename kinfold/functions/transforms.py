"""Table transforms: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import nullcheck


def date_spine(spark: SparkSession, part: str, start: str, end: str, name: str | None = None) -> DataFrame:
    """A row for each `part` from start up to, not including, end."""
    a, b, step = f"TIMESTAMP'{start}'", f"TIMESTAMP'{end}'", f"INTERVAL 1 {part}"
    rows = spark.range(1).select(F.explode(F.expr(f"sequence({a}, {b}, {step})")).alias(name or f"date_{part}"))
    return rows.where(F.col(rows.columns[0]) < F.expr(b))


def intervals_between(start: Column, end: Column, part: str) -> Column:
    return F.timestamp_diff(part.upper(), start, end)


def generate_series(spark: SparkSession, upper: int) -> DataFrame:
    if upper < 1:
        raise ValueError("a series ends at 1 or more")
    return spark.range(1, upper + 1).select(F.col("id").alias("generated_number"))


def deduplicate(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The first row of each partition, nulls being a partition like others."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Rows that a function may bring to the driver.
MOST_ROWS = 100_000


def _brought(df: DataFrame, what: str) -> list:
    """df's rows on the driver; more than MOST_ROWS are an error, not a cut."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"{what} has more than {MOST_ROWS} rows, too many for the driver")
    return rows


def column_values(df: DataFrame, column: str, max_records: int | None = None, where: str | None = None, default: list | None = None) -> list:
    """Distinct values, most frequent first, ties in order of value."""
    rows = (df.where(where) if where else df).groupBy(column).count().orderBy(F.desc("count"), column)
    found = [r[0] for r in _brought(rows.limit(max_records) if max_records else rows, f"the list of values of {column}")]
    return found or (default or [])


def pivot(df: DataFrame, by: Sequence[str], column: str, values: Sequence, agg: str = "sum", then: Column | int = 1, otherwise: Column | int | None = 0, cmp: str = "=", prefix: str = "", suffix: str = "") -> DataFrame:
    """A column for each value by conditional aggregation: one pass, without looking up the values first."""
    ops = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v}
    of = getattr(F, agg)
    cols = [of(F.when(ops[cmp](F.col(column), v), then).otherwise(otherwise)).alias(f"{prefix}{v}{suffix}") for v in values]
    return df.groupBy(*by).agg(*cols)


def unpivot(df: DataFrame, exclude: Sequence[str] = (), remove: Sequence[str] = (), cast_to: str = "string", field_name: str = "field_name", value_name: str = "value") -> DataFrame:
    rest = [c for c in df.columns if c not in exclude and c not in remove]
    return df.select(*exclude, *(F.col(c).cast(cast_to) for c in rest)).unpivot(list(exclude), rest, field_name, value_name)


def union_relations(frames: dict[str, DataFrame], include: Sequence[str] = (), exclude: Sequence[str] = (), source_column: str | None = "_source_relation", where: str | None = None) -> DataFrame:
    """All rows over the union of the columns; source_column says which table a row is from."""
    parts = []
    for name, df in frames.items():
        df = df.where(where) if where else df
        df = df.select(*(c for c in df.columns if (not include or c in include) and c not in exclude))
        parts.append(df.withColumn(source_column, F.lit(name)) if source_column else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def star(df: DataFrame, exclude: Sequence[str] = (), prefix: str = "", suffix: str = "") -> DataFrame:
    gone = {c.lower() for c in exclude}
    return df.select(*(F.col(c).alias(f"{prefix}{c}{suffix}") for c in df.columns if c.lower() not in gone))


def filtered_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    gone = {c.lower() for c in exclude}
    return [c for c in df.columns if c.lower() not in gone]


def group_by_first(df: DataFrame, n: int, *aggs: Column) -> DataFrame:
    return df.groupBy(*df.columns[:n]).agg(*aggs)


def nullcheck_table(df: DataFrame) -> DataFrame:
    return df.select(*(nullcheck(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else f.name for f in df.schema))


def single_value(df: DataFrame, default=None):
    row = df.first()
    return default if row is None or row[0] is None else row[0]


def results_as_dict(df: DataFrame) -> dict[str, list]:
    rows = _brought(df, "the result")
    return {c: [r[i] for r in rows] for i, c in enumerate(df.columns)}


def not_in(df: DataFrame, column: str, other: DataFrame, field: str) -> DataFrame:
    """NOT IN with SQL's nulls: no row if `other` has a null, none whose own value is null unless `other` is empty.

    The nulls are counted beside the join, so that it stays an equi-join and isn't planned as a nested loop."""
    counts = other.agg(F.count("*").alias("_all"), F.count_if(F.col(field).isNull()).alias("_none"))
    rows = df.crossJoin(F.broadcast(counts)).where((F.col("_all") == 0) | ((F.col("_none") == 0) & F.col(column).isNotNull())).drop("_all", "_none")
    values = other.select(F.col(field).alias("_v"))
    return rows.join(values, F.col(column) == F.col("_v"), "left_anti")


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """On all columns that both have, each of which comes once."""
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared) if shared else a.crossJoin(b)


def numbered(df: DataFrame, order: Sequence[str], keep: Callable[[DataFrame], DataFrame], name: str = "row_id") -> DataFrame:
    """row_number() over the whole table, without bringing it to one task: rows are sorted in ranges and numbered in each,
    and a range's first number comes from a table of one row for each. keep: writes a DataFrame and returns it read again."""
    ranged = keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rows = ranged.join(F.broadcast(firsts), "_part")
    return rows.withColumn(name, F.col("_first") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).drop("_part", "_first")


def tables(spark: SparkSession, database: str, pattern: str = "%", prefix: str = "", exclude: str = "", kinds: Sequence[str] = ()) -> DataFrame:
    """(name, kind) of the catalog's tables by a LIKE pattern and a prefix without regard to case, and by kind (MANAGED,
    EXTERNAL, VIEW, TEMPORARY). The catalog's listing is the driver's."""
    rows = spark.createDataFrame([(x.name, x.tableType) for x in spark.catalog.listTables(database)], "name string, kind string")
    found = rows.where(F.col("name").ilike(pattern) & F.lower("name").startswith(prefix.lower()))
    found = found.where(~F.col("name").ilike(exclude)) if exclude else found
    return found.where(F.col("kind").isin(*kinds)) if kinds else found


def relations_by_pattern(spark: SparkSession, database: str, pattern: str, exclude: str = "") -> list[str]:
    """Names of tables that match a LIKE pattern without regard to case."""
    rows = spark.createDataFrame([(t.name,) for t in spark.catalog.listTables(database)], "name string").where(F.col("name").ilike(pattern))
    if exclude:
        rows = rows.where(~F.col("name").ilike(exclude))
    return sorted(r[0] for r in rows.collect())
