"""Data checks: each returns the rows (or groups) that fail, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted_range(df: DataFrame, column: str, low=None, high=None, inclusive: bool = True) -> DataFrame:
    c, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | ~(c >= low if inclusive else c > low)
    if high is not None:
        bad = bad | ~(c <= high if inclusive else c < high)
    return df.where(bad)


def at_least_one(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_by).agg(F.count(column).alias("filled")).where("filled = 0")


def cardinality_equality(a: DataFrame, column: str, b: DataFrame, other: str) -> DataFrame:
    x = a.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("num_rows"))
    y = b.groupBy(F.col(other).alias("value")).agg(F.count("*").alias("num_rows"))
    return x.subtract(y).union(y.subtract(x))


def _counts(a: DataFrame, b: DataFrame, group_by: Sequence[str]) -> DataFrame:
    x, y = a.groupBy(*group_by).agg(F.count("*").alias("count_a")), b.groupBy(*group_by).agg(F.count("*").alias("count_b"))
    both = x.join(y, list(group_by), "full_outer") if group_by else x.crossJoin(y)
    return both.select(*group_by, F.coalesce("count_a", F.lit(0)).alias("count_a"), F.coalesce("count_b", F.lit(0)).alias("count_b"))


def equal_rowcount(a: DataFrame, b: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    return _counts(a, b, group_by).withColumn("diff", F.abs(F.col("count_a") - F.col("count_b"))).where("diff > 0")


def fewer_rows_than(a: DataFrame, b: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Fails where a has as many rows as b or more; by how many too many it has."""
    return _counts(a, b, group_by).withColumn("row_count_delta", F.greatest(F.lit(0), F.col("count_a") - F.col("count_b") + 1)).where("row_count_delta > 0")


def equality(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (), precision: int | None = None) -> DataFrame:
    """Distinct rows of one without the other, tagged; numbers rounded to `precision` digits."""
    names = [c for c in (columns or a.columns) if c not in exclude]

    def of(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        number = lambda c: kinds[c] in ("double", "float") or kinds[c].startswith("decimal")
        return df.select(*(F.round(c, precision).alias(c) if precision is not None and number(c) else c for c in names))

    x, y = of(a), of(b)
    return x.subtract(y).withColumn("which_diff", F.lit("a_minus_b")).union(y.subtract(x).withColumn("which_diff", F.lit("b_minus_a")))


def expression_is_true(df: DataFrame, expression: str) -> DataFrame:
    return df.where(F.expr(f"NOT ({expression})"))


def mutually_exclusive_ranges(df: DataFrame, lower: str, upper: str, partition_by: Sequence[str] = (), gaps: str = "allowed", zero_length: bool = False) -> DataFrame:
    """gaps: allowed, not_allowed or required between a range and the next."""
    w = Window.partitionBy(*partition_by).orderBy(lower, upper)
    x = df.withColumn("_next", F.lead(lower).over(w))
    start, end, following = F.col(lower), F.col(upper), F.col("_next")
    sound = (start <= end) if zero_length else (start < end)
    apart = {"allowed": end <= following, "not_allowed": end == following, "required": end < following}[gaps]
    ok = F.coalesce(sound, F.lit(False)) & F.coalesce(apart, following.isNull())
    return x.where(~ok).drop("_next")


def not_accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(*values)).select(column).distinct()


def not_constant(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_by).agg(F.countDistinct(column).alias("filled")).where("filled = 1")


def not_empty_string(df: DataFrame, column: str, trim: bool = True) -> DataFrame:
    c = F.trim(F.col(column)) if trim else F.col(column)
    return df.where(c == "")


def not_null_proportion(df: DataFrame, column: str, at_least: float, at_most: float = 1.0, group_by: Sequence[str] = ()) -> DataFrame:
    p = df.groupBy(*group_by).agg(F.avg(F.col(column).isNotNull().cast("double")).alias("not_null_proportion"))
    return p.where((F.col("not_null_proportion") < at_least) | (F.col("not_null_proportion") > at_most))


def recency(df: DataFrame, column: str, part: str, interval: int, now: Column | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    threshold = F.timestamp_add(part.upper(), F.lit(-interval), now if now is not None else F.current_timestamp())
    latest = df.groupBy(*group_by).agg(F.max(column).alias("most_recent"))
    return latest.withColumn("threshold", threshold).where(F.col("most_recent") < F.col("threshold"))


def relationships_where(child: DataFrame, column: str, parent: DataFrame, field: str, from_condition: str = "1=1", to_condition: str = "1=1") -> DataFrame:
    keys = parent.where(to_condition).select(F.col(field).alias("_k"))
    rows = child.where(from_condition).where(F.col(column).isNotNull())
    return rows.join(keys, rows[column] == keys["_k"], "left_anti").select(F.col(column).alias("id"))


def sequential_values(df: DataFrame, column: str, interval: int = 1, datepart: str | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    before = F.lag(column).over(Window.partitionBy(*group_by).orderBy(column))
    step = F.timestamp_add(datepart.upper(), F.lit(interval), before) if datepart else before + interval
    return df.withColumn("_should", step).where((F.col("_should") != F.col(column)) & F.col("_should").isNotNull()).drop("_should")


def unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    return unique_combination(df.where(F.col(column).isNotNull()), [column])
