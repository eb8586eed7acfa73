"""Exact dedup by content sort (operator 7).

Sampled splitters range-partition the normalised bytes, each range is sorted outside memory so that equal
texts are adjacent, and full comparison of neighbours forms the runs of equal texts. Only DataFrame functions.

A text that many rows share would make one range too large. A first pass counts rows by a 64-bit hash of the
normalised text (combined before the shuffle); a hash with more rows than a quarter of a partition's fair share
is hot, and there are at most 4 x partitions of those, so that list can be broadcast. Rows of hot texts get a
salt that is part of the sort key, so that a hot text becomes up to SALTS runs in many ranges. The best rows of
those runs, at most SALTS a hot text, are compared in full in a second, small content sort.

`dedup` finds the rows that stay by a 64-bit hash of doc_id, normalised text and length, as `classes` finds hot texts;
`classes` itself compares texts whole.

Defined results: null text counts as empty; empty texts are equal to each other; an empty table gives an empty one; texts
of any length are compared whole, with a prefix and a hash as range key; of rows that tie in code points and doc_id one
is kept, whichever, and it is the same in spelling or equal but for white space; a repeated row (same doc_id and
text) counts towards group_size and one of its rows is kept; a null doc_id sorts after all others; further columns,
whatever their names, are ignored by `classes` and kept by `dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import text_of, written

SALTS = 256
PREFIX = 48


def normalised(c: Column) -> Column:
    """Without space, tab, line feed, vertical tab, form feed and carriage return."""
    for x in " \t\n\x0b\x0c\r":
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def _runs(rows: DataFrame) -> DataFrame:
    """Adds best_id, best_len and run_rows of each run of equal (norm, salt), by a range-partitioned sort.

    The range key (a prefix, the hash, the salt) is a part of the window's key, so the window needs no further
    exchange; the sort within the range compares the whole texts."""
    ranged = rows.repartitionByRange("prefix", "h", "salt")
    run = Window.partitionBy("prefix", "h", "salt", "norm").orderBy(F.desc("n_cp"), F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranged.select(
        "*",
        F.first("doc_id").over(whole).alias("best_id"),
        F.first("n_cp").over(whole).alias("best_len"),
        F.sum("size").over(whole).alias("run_rows"),
        F.row_number().over(run).alias("rn"),
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, norm_hash, n_cp), a row for each row of docs.

    norm_hash: xxhash64 of the normalised text; n_cp: code points of the text as it is."""
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    base = docs.select(docs[id_col].alias("doc_id"), normalised(text).alias("norm"), F.length(text).alias("n_cp"))
    base = base.withColumn("h", F.xxhash64("norm"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(64, docs.count() // (4 * parts))
    hot = base.groupBy("h").count().where(F.col("count") > share).select(F.col("h").alias("hot_h"))  # at most 4 x parts rows
    rows = base.join(F.broadcast(hot), base.h == hot.hot_h, "left").select(
        "doc_id", "norm", "n_cp", "h", F.substring("norm", 1, PREFIX).alias("prefix"), F.lit(1).cast("long").alias("size"),
        F.when(F.col("hot_h").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id", "n_cp"), F.lit(SALTS)).cast("int")).alias("salt"),
    )
    runs = _runs(rows).select(
        "doc_id", "n_cp", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "salt", "h", "best_id", "best_len", "run_rows", "rn",
        F.when((F.col("salt") >= 0) & (F.col("rn") == 1), F.col("norm")).alias("rep"),
    )
    runs = written(runs, "dedup-runs")
    reps = runs.where(F.col("rep").isNotNull()).select(
        F.col("best_id").alias("doc_id"), F.col("rep").alias("norm"), F.col("best_len").alias("n_cp"), "h", F.substring("rep", 1, PREFIX).alias("prefix"),
        F.lit(-1).alias("salt"), F.col("salt").alias("of_salt"), F.col("run_rows").alias("size"), "text_sha256",
    )
    merged = _runs(reps).select(
        F.col("text_sha256").alias("m_sha"), F.col("of_salt").alias("m_salt"), F.col("best_id").alias("m_id"), F.col("run_rows").alias("m_rows"),
        (F.col("rn") == 1).alias("m_first"),
    )
    out = runs.join(merged, (runs.salt == merged.m_salt) & (runs.text_sha256 == merged.m_sha), "left")
    keep, rows_in = F.when(F.col("salt") >= 0, F.col("m_id")).otherwise(F.col("best_id")), F.coalesce("m_rows", "run_rows")
    return out.select(
        "doc_id", keep.alias("keep_id"), rows_in.cast("long").alias("group_size"),
        ((F.col("rn") == 1) & ((F.col("salt") < 0) | F.col("m_first"))).alias("kept"), "text_sha256", F.col("h").alias("norm_hash"), "n_cp",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of a repeated row (same doc_id and text) one stays."""
    found = classes(docs, id_col, text_col).where("kept").select(F.xxhash64("doc_id", "norm_hash", "n_cp").alias("key"))
    text = text_of(docs, text_col)
    # the row as one value, so that no column of docs can clash with the key
    rows = docs.select(F.xxhash64(docs[id_col], F.xxhash64(normalised(text)), F.length(text)).alias("key"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    one = Window.partitionBy("key").orderBy("key")
    return rows.join(found, "key", "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


#: For DuckDB, over the table documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST) AS rn
  FROM d
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM g
"""
