"""Toxicity by a counterfactual-regularised classifier (operator 6).

A logistic model over the distinct lower-cased words of a whole text and over how they begin (their first PREFIXES
bytes, as languages with compounds and endings have few whole words in common), hashed to SLOTS slots. It is trained by
follow-the-regularised-leader with an L1 penalty, so that only what has evidence keeps a weight.

Labelled texts that mention groups of people get counterfactual copies: texts in which every identity term is swapped
for another of its list, neutral words for people among them. A copy has features of its own, words and beginnings, and
the loss of a text has, besides its log loss, COUNTERFACTUAL times the mean of (f(text) - f(copy))^2 over its copies, f
being the logit of the whole text. A group that toxic texts mention more often thus cannot make a text toxic by its
name: its weights are pulled to those of the other terms, and terms that no labelled text has to 0.

It learns from at most 2 x SAMPLE labelled rows (about SAMPLE, by a hash of the doc_id), which are joined to their texts
as a broadcast of that bounded size, and only from slots that MIN_DOCS of those have: the texts stay with the executors,
which count the slots first; the driver gets the known slots of each row. Every whole text is scored.

Defined results: null and empty texts have the score of the intercept; an empty table gives an empty one; texts of any
length are read whole; a score of exactly 0.5 is predicted 1; rows whose label is null aren't learned from; without
labelled rows of both labels every score is near the share of label 1, or 0; repeated rows get equal results; repeated
labels of one doc_id count once each; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ship_package, text_of, written

SAMPLE, MIN_DOCS = 20_000, 4
SLOT_BITS, PREFIXES = 22, (4, 5, 6, 7, 8, 9)
SLOTS = 1 << SLOT_BITS
L1, L2, COUNTERFACTUAL, COPIES, EPOCHS, POSITIVE = 6.0, 1.0, 5.0, 3, 6, 1.0

#: Terms that may stand for each other: people and groups of people, in the corpus's languages.
IDENTITY = (
    ("people", "persons", "neighbours", "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "gays", "lesbians", "asians", "africans", "europeans", "americans", "mexicans"),
    ("person", "neighbour", "woman", "man", "girl", "boy", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "gay", "lesbian", "asian", "african", "european", "american", "mexican", "black", "white", "transgender", "disabled", "jewish", "deaf", "blind", "old", "young"),
    ("leute", "menschen", "nachbarn", "frauen", "männer", "muslime", "christen", "juden", "flüchtlinge", "ausländer", "schwule", "lesben"),
    ("gens", "personnes", "voisins", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "lesbiennes"),
    ("gente", "personas", "vecinos", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "lesbianas"),
)


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def features(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text) of each word and of each word's beginnings, with repetitions."""
    from kinfold.llm import bytewords as B

    t = table[buf]
    # the capitals of Latin-1, which are 0xC3 and one byte more in UTF-8
    t[1:] += np.where((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97), 0x20, 0).astype(np.uint8)
    starts, ends, at = B.segments(t != 0, offs)
    of = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    h = B.span_hashes(t, starts, ends)
    size = ends - starts
    long = [np.flatnonzero(size >= k) for k in PREFIXES]
    first = np.concatenate([starts[x] for x in long])
    begun = B.mix(B.span_hashes(t, first, first + np.repeat(PREFIXES, [len(x) for x in long])) + np.uint64(1))
    return slots(np.concatenate([h, begun])), np.concatenate([of, *(of[x] for x in long)])


def slots_of(text: str, table: np.ndarray) -> np.ndarray:
    """The sorted distinct slots of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]), table)[0]) if len(raw) else np.zeros(0, np.int64)


_WORD = "0-9A-Za-z\u0080-\U0010ffff"


def swapper(identity: tuple[tuple[str, ...], ...]) -> re.Pattern | None:
    terms = sorted({t for g in identity for t in g}, key=len, reverse=True)
    return re.compile(rf"(?<![{_WORD}])(?:{'|'.join(map(re.escape, terms))})(?![{_WORD}])", re.I) if terms else None


def counterfactuals(text: str, identity: tuple[tuple[str, ...], ...], pattern: re.Pattern | None, copies: int = COPIES) -> list[str]:
    """Copies of a text with each identity term swapped for another of its list; none if it has no such term."""
    if pattern is None or not pattern.search(text):
        return []
    of, rnd = {t: g for g in identity for t in g if len(g) > 1}, random.Random(zlib.crc32(text.encode()))
    out = []
    for _ in range(copies):
        chosen: dict[str, str] = {}

        def other(m: re.Match) -> str:
            term = m[0].lower()
            if term not in chosen:
                chosen[term] = rnd.choice([x for x in of[term] if x != term]) if term in of else term
            return chosen[term]

        out.append(pattern.sub(other, text))
    return out


class Rows:
    """Texts as features. slots[i]: of text i; swaps[i]: (gained, lost) slots of each of its copies."""

    def __init__(self, y: np.ndarray, slots: list[np.ndarray], swaps: list[list[tuple[np.ndarray, np.ndarray]]]):
        self.y, self.slots, self.swaps = np.asarray(y, float), slots, swaps


def fit(rows: Rows, dims: int, counterfactual: float = COUNTERFACTUAL, seed: int = 7, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, positive: float = POSITIVE) -> tuple[np.ndarray, float]:
    """(weights, intercept). positive: what a toxic text counts, a clean one counting 1."""
    y = rows.y
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return np.zeros(dims), -20.0 if p == 0 else 20.0
    alpha, beta = 0.3, 1.0
    z, n = np.zeros(dims), np.zeros(dims)
    bias, bias_n = float(np.log(y.mean() / (1 - y.mean()))), 0.0

    def weights(x) -> np.ndarray:
        zx = z[x]
        return np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(n[x])) / alpha + l2))

    def move(x: np.ndarray, wx: np.ndarray, g: np.ndarray | float) -> None:
        nx = n[x]
        z[x] += g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * wx
        n[x] = nx + g * g

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x = rows.slots[i]
            wx = weights(x)
            p = 1 / (1 + np.exp(-np.clip(bias + wx.sum(), -35, 35)))
            g = (p - y[i]) * (positive if y[i] else 1.0)
            move(x, wx, g)
            bias_n += g * g
            bias -= 0.1 * g / (1 + np.sqrt(bias_n))
            if counterfactual:
                for gained, lost in rows.swaps[i]:
                    x = np.concatenate([gained, lost])
                    sign = np.concatenate([np.ones(len(gained)), -np.ones(len(lost))])
                    wx = weights(x)
                    change = float(sign @ wx)  # f(copy) - f(text)
                    if change:
                        move(x, wx, 2 * counterfactual / len(rows.swaps[i]) * change * sign)
    return weights(slice(None)), bias


def _slices(column: pa.ChunkedArray | pa.Array, of=lambda values: values.to_numpy()) -> list:
    """The lists of a column as views of one array; of(values): what a column of lists of lists is made of."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = of(column.values), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def train(docs: DataFrame, labels: DataFrame, learn: Column, identity: tuple[tuple[str, ...], ...] = IDENTITY, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, their weights, intercept)."""
    spark = docs.sparkSession
    ship_package(spark)
    named = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
    total = named.count()
    rank = F.xxhash64("id", F.lit(6)).bitwiseAND(F.lit((1 << 30) - 1))
    named = named.where(rank < min(1 << 30, (1 << 30) * SAMPLE // max(1, total))).limit(2 * SAMPLE)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import bytewords as B
        from kinfold.llm import toxicity as T

        table, pattern = B.word_table(), T.swapper(identity)
        for batch in batches:
            for k in range(0, len(batch), 64):  # a few texts at a time, which may be long
                part = batch.slice(k, 64)
                texts, own, gained, lost = part.column(1).to_pylist(), [], [], []
                for text in texts:
                    x = T.slots_of(text, table)
                    copies = [T.slots_of(c, table) for c in T.counterfactuals(text, identity, pattern)]
                    own.append(x.astype(np.int32))
                    gained.append([np.setdiff1d(c, x, True).astype(np.int32) for c in copies])
                    lost.append([np.setdiff1d(x, c, True).astype(np.int32) for c in copies])
                one, two = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, one), pa.array(gained, two), pa.array(lost, two)], names=["y", "slots", "gained", "lost"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import toxicity as T

        n = np.zeros(T.SLOTS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=T.SLOTS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["slot", "n"])

    both = docs.select(docs["doc_id"], text_of(docs).alias("text")).join(F.broadcast(named), F.col("doc_id") == F.col("id")).select("y", "text")
    seen = written(both.mapInArrow(featured, "y int, slots array<int>, gained array<array<int>>, lost array<array<int>>"), "toxicity-rows")
    often = seen.select("slots").mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    known = np.sort(often.select("slot").toArrow().column(0).to_numpy())  # at most SLOTS
    shared = spark.sparkContext.broadcast(known)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(SLOTS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value))
        one, two = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))

        def of(x: list[int]) -> np.ndarray:
            at = place[np.asarray(x, np.int64)]
            return at[at >= 0]

        for batch in batches:
            y, own, gained, lost = (batch.column(k) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [y, pa.array([of(x) for x in own.to_pylist()], one), *(pa.array([[of(c) for c in x] for x in side.to_pylist()], two) for side in (gained, lost))],
                names=["y", "slots", "gained", "lost"],
            )

    got = seen.mapInArrow(narrowed, "y int, slots array<int>, gained array<array<int>>, lost array<array<int>>").toArrow()
    y, own = got.column(0).to_numpy(), _slices(got.column(1))
    sides = [_slices(got.column(k), _slices) for k in (2, 3)]
    order = sorted(range(len(y)), key=lambda k: (zlib.crc32(own[k].tobytes()), len(own[k]), y[k]))  # whatever order the tasks ended in
    rows = Rows(y[order], [own[k] for k in order], [list(zip(sides[0][k], sides[1][k])) for k in order])
    w, bias = fit(rows, len(known), counterfactual)
    some = np.flatnonzero(w)
    return known[some], w[some], bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import bytewords as B

        some, values, bias = shared.value
        weights = np.zeros(SLOTS)
        weights[some] = values
        table = B.word_table()
        for batch in batches:
            for row, buf, offs in B.texts(batch.column(1)):
                slot, of = features(buf, offs, table)
                hit = np.flatnonzero(weights[slot])
                pair = np.unique(of[hit] << SLOT_BITS | slot[hit])
                n = len(offs) - 1
                logit = bias + np.bincount(pair >> SLOT_BITS, weights[pair & (SLOTS - 1)], n)
                p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], text_of(docs).alias("text"), held_out.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
