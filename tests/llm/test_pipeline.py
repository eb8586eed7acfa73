"""The corpus pipeline on planted documents, against plain Python."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import packing

WORDS = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("ran", "sel", "vin", "do") for c in ("ta", "nes", "ri", "um")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + ("." if k % 9 == 8 else "") for k in range(n)).capitalize()


def corpus():
    """(rows of documents, items of benchmark, the texts that have to stay)."""
    rnd = random.Random(20)
    items = [(f"i{k}", prose(rnd, 14)) for k in range(4)]
    clean = [prose(rnd, 60 + k) for k in range(30)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[0].replace(" ", "  ")), (102, clean[1] + " nochwas"), (0, clean[0])]  # copies; 101 is the longest
    rows += [(200 + k, prose(rnd, 30) + " " + text + " " + prose(rnd, 30)) for k, (_, text) in enumerate(items)]  # leaks of one passage
    rows += [(300 + k, "### $$ ~~ || ^^ @@## " * 30) for k in range(5)] + [(310, None), (311, ""), (312, "...")]
    same = prose(rnd, 80)
    rows += [(5, same), (None, prose(rnd, 70)), (200, prose(rnd, 90))]  # ids that other rows have, or none
    keep = [clean[0].replace(" ", "  "), *clean[1:], same, rows[-2][1], rows[-1][1]]
    return rows, items, keep


def written(spark, folder, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("s"), "n_chars": F.length("text"), "key": F.lit(1), "h": F.lit("h"), "row": F.lit(2)})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs.columns


def test_stages_take_out_what_is_planted(spark, tmp_path):
    rows, items, keep = corpus()
    columns = written(spark, tmp_path, rows, items)
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        left.append(docs.count())
    assert left == [len(rows) - 8, len(rows) - 8 - 3, len(rows) - 8 - 4, len(keep)]
    assert sorted(r["text"] for r in docs.collect()) == sorted(keep)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "one two three four five six seven eight nine ten eleven twelve")]])
def test_empty_tables_pass(spark, tmp_path, rows):
    written(spark, tmp_path, rows, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(t is not None for _, t in rows)


def test_a_very_long_text_stays_whole(spark, tmp_path):
    rnd = random.Random(3)
    long = prose(rnd, 150_000)
    written(spark, tmp_path, [(1, long), (2, long + " mehr"), (3, prose(rnd, 50))], [("i", prose(rnd, 20))])
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in got} == {1, 3} and {r["doc_id"]: r["n"] for r in got}[1] == len(tokenizer.encode(long).ids) + 1
