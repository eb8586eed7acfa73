"""Best-fit packing of token sequences by minimum bin slack (operator 5).

1. Every whole text is tokenised; a document is its ids and an end id. One longer than the capacity is cut into
   pieces of the capacity, of which the first may be shorter. The pieces' facts are written once.
2. How many pieces have each length is a table of at most `capacity` rows, whatever the input, and goes to the driver.
3. Minimum bin slack: the longest remaining length opens a bin, and a subset-sum over the available lengths (a bitset,
   bounded by how many pieces each has) finds the fullest feasible combination, which is removed as often as
   the counts allow. Each removal leaves some length with fewer pieces than the combination takes. The number of
   different combinations is small beside the input, but grows with the number of pieces until every length is common;
   the table of their places is broadcast only up to a checked size.
4. The k-th piece of a length takes the k-th place that the combinations have for that length. Ranks are counted
   within (length, salt) and shifted by sums over that table, so a very common length is ranked by many tasks.

Defined results: null text counts as empty, and an empty document is its end id alone; an empty table gives no
sequence; a document of any length is cut into as many pieces as it needs; ties in length are ranked by doc_id, and equal
rows in any order, which places alike pieces alike; repeated rows and null doc_ids are packed like any others; further
columns are ignored. Ids are 32 bits wide, for a tokenizer of any vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ship_package, small, written

CAPACITY, END, SALTS, STRETCHES = 2048, 0, 64, 1 << 16


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and the ids themselves if with_ids."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm.bpe import byte_bpe
        from kinfold.llm.bytewords import texts

        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for row, buf, offs in texts(batch.column(1)):
                ids, first = bpe.encode(buf, offs)
                ids = ids.astype("<u4")
                out: list[list] = [[], [], [], [], []]
                kept = []
                for k in range(len(offs) - 1):
                    of = np.append(ids[first[k] : first[k + 1]], np.uint32(end))
                    for i, (s, n) in enumerate(cut(len(of), capacity)):
                        for column, x in zip(out, (row + k, i, s, n, zlib.crc32(of[s : s + n].tobytes()))):
                            column.append(x)
                        if with_ids:
                            kept.append(of[s : s + n].astype(np.int32))
                arrays = [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, schema + ", ids array<int>" * with_ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills most of room: {length: how many}. Longer lengths come first."""
    reach, steps = 1, []
    goal, mask = 1 << room, (1 << room + 1) - 1
    for n in sorted((n for n in counts if n <= room), reverse=True):
        steps.append((n, reach))
        left, k = min(counts[n], room // n), 1
        while left:  # 1, 2, 4, ... copies, so that any number up to the count is reached
            k = min(k, left)
            reach |= reach << n * k & mask
            left, k = left - k, 2 * k
        if reach & goal:
            break
    at, taken = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        k = 0
        while not before >> at & 1:
            at, k = at - n, k + 1
        if k:
            taken[n] = k
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, copies in a bin, offset in the bin) of the places, with no piece left over."""
    counts = {n: c for n, c in counts.items() if c}
    ranks, places, bins = dict.fromkeys(counts, 0), [], 0
    while counts:
        top = max(counts)
        counts[top] -= 1
        taken = fullest({n: c for n, c in counts.items() if c}, capacity - top)
        counts[top] += 1
        taken[top] = taken.get(top, 0) + 1
        times, offset = min(counts[n] // k for n, k in taken.items()), 0
        for n in sorted(taken, reverse=True):
            k = taken[n]
            places.append((n, ranks[n], ranks[n] + times * k, bins, k, offset))
            ranks[n] += times * k
            counts[n] -= times * k
            offset += n * k
            if not counts[n]:
                del counts[n]
        bins += times
    return places


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    cutup = pieces(docs, capacity, end, tokenizer).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    cutup = written(cutup, "pieces")
    sizes = written(cutup.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")  # at most capacity x SALTS rows
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(counts, capacity)
    # a stretch of ranks is part of the join's key, so that beyond the bound of a broadcast no length is one task's
    stretch = max(1, sum(counts.values()) // STRETCHES)
    rows = sum((end - 1) // stretch - first // stretch + 1 for _, first, end, *_ in made)
    places = spark.createDataFrame(made, "p_length long, first_rank long, end_rank long, first_bin long, copies long, base long")
    places = places.withColumn("p_stretch", F.explode(F.sequence(F.floor(F.col("first_rank") / stretch), F.floor((F.col("end_rank") - 1) / stretch))))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("length").alias("s_length"), F.col("salt").alias("s_salt"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cutup.withColumn("rn", F.row_number().over(within) - 1)
    ranked = ranked.join(small(shifts, rows=capacity * SALTS), (ranked.length == shifts.s_length) & (ranked.salt == shifts.s_salt))
    ranked = ranked.withColumn("rank", F.col("rn") + F.col("shift")).withColumn("stretch", F.floor(F.col("rank") / stretch))
    at = (F.col("length") == F.col("p_length")) & (F.col("stretch") == F.col("p_stretch")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    k = F.col("rank") - F.col("first_rank")
    return ranked.join(small(places, rows=rows), at).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(k, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
