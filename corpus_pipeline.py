"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; `run` writes each stage's rows
to the shared folder and reads them back, and removes what a stage no longer needs. All but the last return the columns
of documents, whatever further ones there are.

Defined results, for every stage: rows are judged each on its own, also those that share a doc_id; null counts as empty
text. The quality stage drops null and empty texts and those without letters and digits. Of equal texts one row stays, and of near copies one (see
exact_dedup and ngram_join for which). A document goes with the first benchmark item of which a window occurs in it: a
leak of one passage is a leak. Empty tables pass through; an empty benchmark removes nothing; texts of any length are
read whole; the last stage packs what is left, and returns a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontamination, exact_dedup, ngram_join, packing, quality
from kinfold.llm._shared import table, written_alone


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return quality.keep(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return ngram_join.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of any benchmark item occurs."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", sequences),
]

#: The first and the last stage learn and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, remove = written_alone(lambda: stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))  # noqa: B023
        if before:
            before()
        before = remove
    return docs
