"""Quality by a weak-label model and a hashed linear scorer (operator 2).

1. Heuristic labellers look at each whole text and vote bad, good or not at all.
2. Rows with the same votes are counted over all documents: at most 3^(labellers) rows, whatever the input.
   Expectation-maximisation on those counts estimates how often each labeller says bad of bad and of good texts
   (Dawid and Skene's model with abstentions), and so each pattern's posterior.
3. A logistic scorer over hashed features (character-class trigrams of the text, and what bin each of its statistics
   falls into) is trained on the posteriors of at most SAMPLE documents, chosen by a hash of the doc_id, and scores all.

Defined results: null and empty texts, and texts without letters and digits, are bad for certain (score 0, rejected), whatever else is
learned; in an empty table nothing is learned and nothing returned; a text of any length is looked at as a whole, in
features of fixed number; a score of exactly 0.5 is not rejected; repeated rows get equal results; further columns,
whatever their names, are kept by `keep` and ignored by `assess`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship_package, text_of, written

SAMPLE, DIMS, ROUNDS = 20_000, 4096, 60

#: (statistic, bad from, good up to, words it needs): a labeller abstains between its two values and on shorter texts.
#: The values are constants set by hand, around what running prose of the test data's languages has; how far each
#: labeller can be believed is estimated, but texts of another kind (source code, tables) need other values.
LABELLERS = (
    ("marked", 0.20, 0.02, 4),  # words that end in a sign that no sentence has
    ("signs", 0.07, 0.045, 12),  # share of characters that are neither letters, digits nor white space
    ("upper", 0.40, 0.12, 12),  # share of capitals among letters
    ("adjacent", 0.20, 0.05, 12),  # words that repeat the word before
    ("repeated", 0.75, 0.50, 30),  # words that occurred before in the text
    ("lines", 0.45, 0.35, 10),  # lines that occurred before in the text
    ("bars", 0.12, 0.02, 8),  # words that are a bar
    ("wordless", 0.5, 0.5, 0),
)
#: What the last labeller's vote alone makes of a pattern: bad for certain.
WORDLESS = len(LABELLERS) - 1
STATS = tuple(x[0] for x in LABELLERS)

UPPER, LOWER, DIGIT, SPACE, LINE, STOP, SIGN, BAR, HIGH = range(9)


def _kinds() -> np.ndarray:
    t = np.full(256, SIGN, np.uint8)
    t[0x41:0x5B], t[0x61:0x7B], t[0x30:0x3A], t[0x80:] = UPPER, LOWER, DIGIT, HIGH
    t[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    t[0x0A] = LINE
    for c in b".,;:?'\"()-+@/":
        t[c] = STOP
    t[ord("|")] = BAR
    return t


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, hashed features): a row for each text."""
    from kinfold.llm import bytewords as B

    n, kinds = len(offs) - 1, _kinds()
    k = kinds[buf] if len(buf) else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offs))
    by_kind = np.bincount(row * 9 + k, minlength=9 * n).reshape(n, 9).astype(float)
    stats = np.zeros((n, len(LABELLERS)))
    starts, ends, at = B.segments((k != SPACE) & (k != LINE), offs)
    words = np.diff(at).astype(float)
    h = B.span_hashes(buf.astype(np.uint16) + np.uint16(1), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(n), np.diff(at))
    one = np.maximum(words, 1)
    last = k[ends - 1] if len(ends) else k
    lone = (ends - starts) == 1
    stats[:, 0] = np.bincount(of, (last == SIGN) & ~lone, n) / one
    letters = by_kind[:, UPPER] + by_kind[:, LOWER]
    stats[:, 1] = (by_kind[:, SIGN] + by_kind[:, BAR] + by_kind[:, STOP]) / np.maximum(by_kind.sum(1) - by_kind[:, SPACE] - by_kind[:, LINE], 1)
    stats[:, 2] = by_kind[:, UPPER] / np.maximum(letters, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    stats[:, 3] = np.bincount(of, same, n) / one
    l_starts, l_ends, l_at = B.segments(k != LINE, offs)
    lines = B.span_hashes(buf.astype(np.uint16) + np.uint16(1), l_starts, l_ends) if len(l_starts) else np.zeros(0, np.uint64)
    for i in range(n):
        if words[i]:
            stats[i, 4] = 1 - len(np.unique(h[at[i] : at[i + 1]])) / words[i]
        m = l_at[i + 1] - l_at[i]
        if m > 1:
            stats[i, 5] = 1 - len(np.unique(lines[l_at[i] : l_at[i + 1]])) / m
    stats[:, 6] = np.bincount(of, lone & (last == BAR), n) / one
    stats[:, 7] = by_kind[:, [UPPER, LOWER, DIGIT, HIGH]].sum(1) == 0
    out = np.zeros((n, DIMS), np.float32)
    if len(k) > 2:
        inside = row[2:] == row[:-2]
        code = k[:-2].astype(np.int64) * 81 + k[1:-1] * 9 + k[2:]
        tri = np.bincount((row[2:] * 729 + code)[inside], minlength=729 * n).reshape(n, 729)
        slot = (np.arange(729) * 2654435761 % (1 << 32)) * DIMS >> 32
        share = np.sqrt(tri / np.maximum(tri.sum(1, keepdims=True), 1))
        for c in np.flatnonzero(tri.any(0)):
            out[:, slot[c]] += share[:, c]
    for j in range(len(STATS)):
        bins = np.minimum(np.floor(np.sqrt(stats[:, j]) * 8), 7).astype(np.int64)
        slot = ((j * 8 + bins + 1000) * 2246822519 % (1 << 32)) * DIMS >> 32
        out[np.arange(n), slot] += 1
    return stats, np.concatenate([out, words[:, None].astype(np.float32)], 1)


def votes(stats: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A base-3 number for each row: 0 abstains, 1 good, 2 bad, the first labeller last."""
    code = np.zeros(len(stats), np.int64)
    for j, (_, bad, good, least) in enumerate(LABELLERS):
        v = np.where(words < least, 0, np.where(stats[:, j] >= bad, 2, np.where(stats[:, j] < good, 1, 0)))
        code += v * 3**j
    return code


def weak_labels(patterns: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """(probability that a pattern's texts are bad, [of bad texts, of good texts] how often each labeller says bad)."""
    certain = [c for c in patterns if c // 3**WORDLESS % 3 == 2]
    codes = np.array(sorted(set(patterns) - set(certain)), np.int64)
    count = np.array([patterns[c] for c in codes.tolist()], float)
    v = codes[:, None] // 3 ** np.arange(len(LABELLERS))[None, :] % 3
    bad, spoke = (v == 2).astype(float), (v > 0).astype(float)
    says = np.array([[0.5] * len(LABELLERS), [0.02] * len(LABELLERS)])
    prior, post = 0.15, np.zeros(0)
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior)) + (bad * np.log(says[0] / says[1]) + (spoke - bad) * np.log((1 - says[0]) / (1 - says[1]))).sum(1)
        post = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        for k, share in enumerate((post, 1 - post)):
            w = count * share
            # the prior counts keep a labeller that met few texts better than chance
            says[k] = ((w[:, None] * bad).sum(0) + (2, 0.2)[k]) / ((w[:, None] * spoke).sum(0) + (8, 20)[k])
        says = np.clip(says, 1e-4, 1 - 1e-4)
        prior = float(np.clip((count * post).sum() / max(count.sum(), 1), 0.001, 0.5))
    return dict(zip(codes.tolist(), post.tolist())) | dict.fromkeys(certain, 1.0), says


def train(row: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps. row, idx, val: the texts' features that aren't 0."""
    if not len(y):
        return np.zeros(DIMS), 0.0
    used, column = np.unique(idx, return_inverse=True)
    x = np.zeros((len(y), len(used)), np.float32)  # only the slots in use, which are a few hundred
    x[row, column] = val
    y = y.astype(np.float32)
    w, b, momentum, n = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), max(1, len(y))
    rate = 4.0 / (1 + float(np.dot(val, val)) / n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * momentum[:-1]).astype(np.float32) + np.float32(b + 0.9 * momentum[-1]), -35, 35)))
        g = np.append((p - y) @ x / n + 1e-5 * w, (p - y).mean())
        momentum = 0.9 * momentum - rate * g
        w, b = w + momentum[:-1], b + momentum[-1]
    full = np.zeros(DIMS)
    full[used] = w
    return full, b


def _looked_at(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import quality as Q
        from kinfold.llm.bytewords import texts

        for batch in batches:
            for row, buf, offs in texts(batch.column(1), 1 << 20):
                for k in range(0, len(offs) - 1, 512):
                    o = offs[k : k + 513]
                    stats, x = Q.features(buf[o[0] : o[-1]], o - o[0])
                    r, c = np.nonzero(x[:, :-1])
                    ptr = pa.array(np.searchsorted(r, np.arange(len(x) + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row + k, len(x)), batch.column(2).slice(row + k, len(x)), pa.array(Q.votes(stats, x[:, -1]).astype(np.int32)),
                         pa.ListArray.from_arrays(ptr, pa.array(c.astype(np.int16))), pa.ListArray.from_arrays(ptr, pa.array(x[r, c]))],
                        names=["doc_id", "h", "pattern", "idx", "val"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_of(docs)
    return docs.select("doc_id", text, F.xxhash64(text)).mapInArrow(run, f"doc_id {kind}, h long, pattern int, idx array<short>, val array<float>")


def _assess(docs: DataFrame) -> DataFrame:
    """What `assess` returns, and h, the hash of the text."""
    spark = docs.sparkSession
    seen = written(_looked_at(docs), "quality")
    patterns = {r["pattern"]: r["count"] for r in seen.groupBy("pattern").count().collect()}  # at most 3^(labellers) rows
    weak, _ = weak_labels(patterns)
    total = sum(patterns.values())
    rank = F.xxhash64("doc_id", "h", F.lit(2)).bitwiseAND(F.lit((1 << 30) - 1))
    # DIMS slots at most of each of at most 2 x SAMPLE rows, whatever the texts' lengths
    rows = seen.where(rank < min(1 << 30, (1 << 30) * SAMPLE // max(1, total))).limit(2 * SAMPLE).select("pattern", "idx", "val").toArrow()
    batches, y = rows.to_batches(), np.array([weak[p] for p in rows.column("pattern").to_pylist()])
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(b.column(1).offsets.to_numpy()) for b in batches)])
    idx, val = (np.concatenate([np.zeros(0, kind), *(b.column(k).flatten().to_numpy() for b in batches)]) for k, kind in ((1, np.int16), (2, np.float32)))
    shared = spark.sparkContext.broadcast((*train(np.repeat(np.arange(len(y)), sizes), idx, val, y), weak))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, weak = shared.value
        for batch in batches:
            pattern, idx, val = batch.column(2), batch.column(3), batch.column(4)
            n = np.diff(idx.offsets.to_numpy())
            c = np.concatenate([[0.0], np.cumsum(w[idx.flatten().to_numpy()] * val.flatten().to_numpy())])
            at = np.concatenate([[0], np.cumsum(n)])
            bad = 1 / (1 + np.exp(-np.clip(c[at[1:]] - c[at[:-1]] + b, -35, 35)))
            bad[pattern.to_numpy() // 3**WORDLESS % 3 == 2] = 1.0
            post = np.array([weak[p] for p in pattern.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pattern, pa.array(post), pa.array(1 - bad), pa.array(bad > 0.5)], names=["doc_id", "h", "pattern", "weak_bad", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return seen.mapInArrow(run, f"doc_id {kind}, h long, pattern int, weak_bad double, score double, rejected boolean")


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, weak_bad, score, rejected), a row for each row of docs. score: 1 is good."""
    return _assess(docs).drop("h")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns.

    Rows are found again by a 64-bit hash of doc_id and text: rows that share a doc_id are judged each on its own."""
    gone = _assess(docs).where("rejected").select(F.xxhash64("doc_id", "h").alias("key")).distinct()
    return docs.join(gone, F.xxhash64(docs["doc_id"], F.xxhash64(text_of(docs))) == gone["key"], "left_anti")
