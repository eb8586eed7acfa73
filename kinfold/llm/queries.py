"""The queries of the corpus operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, language_id, ngram_join, packing, quality, site_style_tree, token_output, toxicity, warc_revisit
from .language_id import remainder
from ._shared import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style_tree.extract(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.score(docs, model, fold == 0)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents")).drop("norm_hash", "n_cp")


def op8_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.report(table(spark, sf_dir, "pages"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder(F.col("doc_id"), 4)
    return language_id.identify(table(spark, sf_dir, "documents"), fold != 2, fold == 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_quality, op3_site_style_tree, op4_decontamination, op5_packing, op6_toxicity, op7_exact_dedup, op8_warc_revisit, op9_token_output, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontamination.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_warc_revisit": warc_revisit.SQL}
