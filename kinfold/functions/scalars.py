"""Scalar column functions: built-in expressions only, so that they stay inside generated code."""

from __future__ import annotations

import logging
import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of canonical forms.
CANONICAL = ("NONE", "LOWERCASE", "UPPERCASE", "TRIM", "PHONE_DIGITS", "CLEAN_PHONE")


def canonicalize(value: Column, kind: str | None) -> Column:
    kind = (kind or "NONE").upper()
    if kind == "LOWERCASE":
        return F.lower(value)
    if kind == "UPPERCASE":
        return F.upper(value)
    if kind == "TRIM":
        return F.trim(value)
    if kind in ("PHONE_DIGITS", "CLEAN_PHONE"):
        return F.regexp_replace(value, "[^0-9]", "")
    if kind == "NONE":
        return value
    raise ValueError(f"no canonical form {kind!r}; there are {', '.join(CANONICAL)}")


def entity_key(table_id: str, key_expr: str) -> Column:
    """table id, colon, key; null if the key is."""
    return F.concat(F.lit(table_id + ":"), F.expr(key_expr).cast("string"))


def normalize_company(name: Column) -> Column:
    """Upper case, without legal form, punctuation and repeated spaces."""
    up = F.upper(F.trim(name))
    bare = F.regexp_replace(up, r"[,\s]+(INC|LLC|LTD|CORP|CO|GMBH|PLC)\.?$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^A-Z0-9 ]", ""), " +", " "))


#: Fixed value: stands for null in a surrogate key.
NULL_KEY = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*cols: Column) -> Column:
    return F.md5(F.concat_ws("-", *(F.coalesce(c.cast("string"), F.lit(NULL_KEY)) for c in cols)))


def nullcheck(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def safe_add(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in cols))


def safe_subtract(*cols: Column) -> Column:
    return reduce(lambda a, b: a - b, (F.coalesce(c, F.lit(0)) for c in cols))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def width_bucket(x: Column, low: float, high: float, n: int) -> Column:
    """1..n for low <= x < high, 0 below, n + 1 from high on; a value on an edge belongs to the bucket above."""
    size = (high - low) / n
    place = (x.cast("double") - low) / size
    on_edge = F.when(F.pmod(x.cast("double") - low, F.lit(size)) == 0, 1).otherwise(0)
    inner = (F.ceil(place) + on_edge).cast("int")
    return F.when(x < low, 0).when(x >= high, n + 1).otherwise(inner)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "mi") -> Column:
    """Great-circle distance with a radius of 3961 miles; a kilometre is 1/1.60934 mile."""
    if unit not in ("mi", "km"):
        raise ValueError("unit is mi or km")
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 3961 * F.asin(F.sqrt(a)) * (1.60934 if unit == "km" else 1.0)


def url_host(url: Column) -> Column:
    bare = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), ("android-app://", "http://", "https://"), url)
    return F.split_part(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))


def url_path(url: Column) -> Column:
    """What follows the host's slash, up to the query; empty if there is none."""
    bare = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), ("http://", "https://"), url)
    slash = F.instr(bare, "/")
    return F.when(slash == 0, "").otherwise(F.split_part(F.substr(bare, slash + 1), F.lit("?"), F.lit(1)))


def url_parameter(url: Column, name: str) -> Column:
    """The value after `name=`, up to the next ampersand; null if there is none."""
    return F.nullif(F.split_part(F.split_part(url, F.lit(name + "="), F.lit(2)), F.lit("&"), F.lit(1)), F.lit(""))


def slugify(s: str) -> str:
    s = re.sub(r"[ -]+", "_", s.lower())
    s = re.sub(r"[^a-z0-9_]+", "", s)
    return "_" + s if re.match("[0-9]", s) else s


def surrogate_key_of_columns(*_) -> None:
    """The macro's former name, which is an error as it was there."""
    raise ValueError("surrogate_key_of_columns was replaced by surrogate_key")


def pretty_time(when: datetime | None = None, format: str = "%H:%M:%S") -> str:
    return (when or datetime.now()).strftime(format)


def pretty_log_format(message: str, when: datetime | None = None) -> str:
    return f"{pretty_time(when)} + {message}"


def log_info(message: str) -> None:
    logging.getLogger("kinfold").info(pretty_log_format(message))
