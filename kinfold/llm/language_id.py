"""Language identification by segmentation-marginalised unigrams (operator 10).

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over
its words, so a word is worked out once for each language and worker, then looked up. Probabilities are learned by
expectation-maximisation on a sample of labelled rows (about 1.2 SAMPLE_DOCS for each language, chosen by a hash of the
doc_id) with expected counts from forward and backward sums. The words of the sampled rows' whole texts are counted on
the executors; the driver gets a row for each word of a language. There is a model for each value of `lang`, so that
their number is a property of the labels, not of the corpus's size.

Words are runs of lower-cased letters and marks with a letter among them, taken from the whole text; anything else
(digits, dashes, quotes, signs, emoji) separates words. A word of any length is summed over as a whole: those of less
than SHORT bytes many at once, those of less than MIDDLE many at once in logarithms, longer ones one by one.

Defined results: null text, or one with no letter, is `und` with score 0; without any labelled row every text
is `und`; an empty table gives an empty one; texts of any length are read whole; ties go to the language first in order;
repeated rows get equal results; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ship_package

#: Documented bound of what is learned from: rows for each language.
SAMPLE_DOCS = 1_500
SHORT, MIDDLE, ROUNDS, EDGE_BATCHES = 64, 512, 4, 20
TOGETHER = 1024  # words of middle length
START = 1  # the byte that stands for a word's beginning, for the vocabulary's mark of it


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces that can occur in a word: letters, with or without the mark of its beginning, and every byte."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in (START, *range(0x61, 0x7B), *range(0x80, 0x100))}
    for k in range(sp.get_piece_size()):
        if sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k):
            continue
        p = sp.id_to_piece(k)
        body = p.removeprefix("▁").lower()
        raw = body.encode()
        if body.isalpha():
            found.add((bytes([START]) if p != p.removeprefix("▁") else b"") + raw)
    return sorted(found)


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point: 2 for letters, 1 for marks, 0 for the rest."""
    if not _kinds:
        of = {"L": 2, "M": 1}
        _kinds.append(np.fromiter((of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000))
    return _kinds[0]


class Lattice:
    """All pieces at all places of many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.most = max(map(len, pieces))
        self.p = np.cumprod(np.array([1] + [0x9E3779B97F4A7C15] * self.most, np.uint64), dtype=np.uint64)
        keys = np.array([self._key(np.frombuffer(x, np.uint8)[None, :].astype(np.uint64))[0] for x in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order

    def _key(self, chars: np.ndarray) -> np.ndarray:
        """Of equally long byte strings, a row each."""
        from kinfold.llm.bytewords import mix

        k = chars.shape[1]
        return mix((chars * self.p[:k]).sum(1, dtype=np.uint64) + np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)))

    def edges(self, grid: np.ndarray, size: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces) for each start and end at which some word has a piece. grid: bytes, a word a row."""
        out = []
        width = grid.shape[1]
        wide = grid.astype(np.uint64)
        for end in range(1, width + 1):
            some = np.flatnonzero(size >= end)
            if not len(some):
                break
            for start in range(max(0, end - self.most), end):
                key = self._key(wide[some, start:end])
                at = np.minimum(np.searchsorted(self.keys, key), self.n - 1)
                hit = self.keys[at] == key
                if hit.any():
                    out.append((start, end, some[hit], self.ids[at[hit]]))
        return out

    def forward(self, edges: list, size: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word by language, forward sums). logp: language x piece."""
        n, width = len(size), int(size.max(initial=1))
        # scaled by 2^20 a byte, so that a long word's sum stays a normal number
        p = np.exp(logp)
        alpha = np.zeros((width + 1, n, len(logp)))
        alpha[0] = 1.0
        for start, end, w, k in edges:
            alpha[end, w] += alpha[start, w] * p[:, k].T * float(1 << 10) ** (end - start)
        total = alpha[size, np.arange(n)]
        return np.log(np.maximum(total, 1e-300)) - size[:, None] * 10 * np.log(2), alpha

    def expected(self, edges: list, size: np.ndarray, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of pieces, language x piece. weight: word x language."""
        _, alpha = self.forward(edges, size, logp)
        p = np.exp(logp)
        beta = np.zeros_like(alpha)
        n = len(size)
        beta[size, np.arange(n)] = 1.0
        total = np.maximum(alpha[size, np.arange(n)], 1e-300)
        counts = np.zeros_like(logp)
        for start, end, w, k in reversed(edges):
            through = p[:, k].T * float(1 << 10) ** (end - start) * beta[end, w]
            beta[start, w] += through
            share = alpha[start, w] * through / total[w] * weight[w]
            for j in range(len(logp)):
                counts[j] += np.bincount(k, share[:, j], self.n)
        return counts


    def log_sums(self, edges: list, size: np.ndarray, logp: np.ndarray, back: bool = False) -> np.ndarray:
        """Logarithms of the forward (or backward) sums of many words, place x word x language."""
        n = len(size)
        sums = np.full((int(size.max(initial=1)) + 1, n, len(logp)), -np.inf)
        if back:
            sums[size, np.arange(n)] = 0.0
        else:
            sums[0] = 0.0
        for start, end, w, k in reversed(edges) if back else edges:
            a, b = (end, start) if back else (start, end)
            sums[b, w] = np.logaddexp(sums[b, w], sums[a, w] + logp[:, k].T)
        return sums

    def log_expected(self, edges: list, size: np.ndarray, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """`expected` by log_sums."""
        alpha, beta = self.log_sums(edges, size, logp), self.log_sums(edges, size, logp, True)
        total, counts = alpha[size, np.arange(len(size))], np.zeros_like(logp)
        for start, end, w, k in edges:
            share = np.exp(alpha[start, w] + logp[:, k].T + beta[end, w] - total[w]) * weight[w]
            for j in range(len(logp)):
                counts[j] += np.bincount(k, share[:, j], self.n)
        return counts

    def long_edges(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, pieces) of all pieces in one word with its mark, in order of their ends."""
        from kinfold.llm.bytewords import _BYTES, mix

        chars = np.frombuffer(bytes([START]) + word, np.uint8).astype(np.uint64)
        p, q = _BYTES.get(len(chars) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * p[: len(chars)])])
        out = []
        for k in range(1, min(self.most, len(chars)) + 1):
            first = np.arange(len(chars) - k + 1)
            key = mix((sums[first + k] - sums[first]) * q[first] + np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)))
            at = np.minimum(np.searchsorted(self.keys, key), self.n - 1)
            hit = self.keys[at] == key
            out.append((first[hit], first[hit] + k, self.ids[at[hit]]))
        starts, ends, pieces = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(ends, kind="stable")
        return starts[order], ends[order], pieces[order]

    def long_forward(self, starts: np.ndarray, ends: np.ndarray, pieces: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Logarithms of the forward sums, place x language; the last is the word's."""
        size = int(ends[-1])
        alpha, cost, at = np.full((size + 1, len(logp)), -np.inf), logp[:, pieces].T, np.searchsorted(ends, np.arange(size + 2))
        alpha[0] = 0.0
        for e in range(1, size + 1):
            x = alpha[starts[at[e] : at[e + 1]]] + cost[at[e] : at[e + 1]]
            top = x.max(0)
            alpha[e] = top + np.log(np.exp(x - top).sum(0))
        return alpha

    def long_expected(self, word: bytes, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of pieces, language x piece, in `weight` (of each language) such words."""
        starts, ends, pieces = self.long_edges(word)
        alpha = self.long_forward(starts, ends, pieces, logp)
        # the backward sums are the forward sums of the word from its end
        size, back = int(ends[-1]), np.argsort(-starts, kind="stable")
        beta = self.long_forward(size - ends[back], size - starts[back], pieces[back], logp)[::-1]
        share = np.exp(alpha[starts] + logp[:, pieces].T + beta[ends] - alpha[-1]) * weight
        return np.stack([np.bincount(pieces, share[:, j], self.n) for j in range(len(logp))])


def grid_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words with the mark of their beginning, as a matrix of bytes."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    grid = np.zeros((len(words), int(size.max(initial=1))), np.uint8)
    grid[:, 0] = START
    for k, w in enumerate(words):
        grid[k, 1 : len(w) + 1] = np.frombuffer(w, np.uint8)
    return grid, size


def cut_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first of each text) of the words in lower-cased texts."""
    from kinfold.llm.bytewords import segments

    if len(buf) and buf.max() >= 0x80:
        kind = kinds()[np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)]
        first = np.flatnonzero((buf & 0xC0) != 0x80)
        kind = np.repeat(kind, np.diff(np.append(first, len(buf))))
    else:
        kind = kinds()[buf]
    starts, ends, at = segments(kind > 0, offs)
    if len(starts):  # marks alone are no word
        real = np.maximum.reduceat(kind, starts) == 2
        starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(starts, offs)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def count_words(rows: Iterator[tuple[str, str]]) -> Counter[tuple[str, bytes]]:
    """Of (text, language) rows, by (language, word). A language whose texts have no word has the empty one, 0 times."""
    counts: Counter[tuple[str, bytes]] = Counter()
    for text, lang in rows:
        data = np.frombuffer(text.lower().encode(), np.uint8)
        if len(data):
            s, e, _ = cut_words(data, np.array([0, len(data)]))
            raw = data.tobytes()
            counts[lang, b""] += 0
            counts.update((lang, raw[a:b]) for a, b in zip(s.tolist(), e.tolist()))
    return counts


def train(words: pa.Table, pieces: list[bytes], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities language x piece) from (language, word, count) rows."""
    counts: dict[str, dict[bytes, int]] = {}
    for lang, word, n in zip(*(words.column(k).to_pylist() for k in range(3))):
        of = counts.setdefault(lang, {})
        if n:
            of[word] = n
    langs = sorted(counts)
    every = sorted(set().union(*counts.values()), key=lambda w: (len(w) >= SHORT, len(w) >= MIDDLE, w)) if counts else []
    logp = np.full((len(langs), len(pieces)), -np.log(len(pieces)))
    if not every:
        return langs, logp
    lattice = Lattice(pieces)
    weight = np.array([[counts[x].get(w, 0) for x in langs] for w in every], float)
    prior = np.array([256.0 ** -len(p) for p in pieces])  # what a piece gets without evidence falls with its length

    short, middle = (sum(len(w) < k for w in every) for k in (SHORT, MIDDLE))

    def batch(k: int) -> tuple[list, np.ndarray]:
        grid, size = grid_of(every[k : min(k + 20_000, short)])
        return lattice.edges(grid, size), size

    firsts = range(0, short, 20_000)
    ready = {k: batch(k) for k in firsts[:EDGE_BATCHES]}  # those beyond are worked out in each round, to spare memory
    for _ in range(rounds):
        new = sum(lattice.expected(*(ready.get(k) or batch(k)), logp, weight[k : min(k + 20_000, short)]) for k in firsts)
        for k in range(short, middle, TOGETHER):
            grid, size = grid_of(every[k : min(k + TOGETHER, middle)])
            new = new + lattice.log_expected(lattice.edges(grid, size), size, logp, weight[k : k + len(size)])
        new = new + sum(lattice.long_expected(every[k], logp, weight[k]) for k in range(middle, len(every)))
        new = new + 0.05 + prior
        logp = np.log(new / new.sum(1, keepdims=True))
    return langs, logp


class Scorer:
    """Remembers the words that it has scored, until there are MOST of them."""

    SLOTS_LOG2 = 21

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.lattice, self.logp = Lattice(pieces), logp
        self.key = np.zeros(1 << self.SLOTS_LOG2, np.uint64)
        self.value = np.zeros((1 << self.SLOTS_LOG2, len(logp)), np.float32)

    def words(self, t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        from kinfold.llm.bytewords import span_hashes

        h = span_hashes(t.astype(np.uint16) + np.uint16(1), starts, ends) | np.uint64(1)
        slot = (h >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)
        out = self.value[slot].astype(np.float64)
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            _, first, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            where, raw = miss[first], t.tobytes()
            order = np.argsort(ends[where] - starts[where], kind="stable")  # words of like length share a matrix
            got = np.zeros((len(where), len(self.logp)))
            short, middle = np.searchsorted((ends - starts)[where[order]], (SHORT, MIDDLE)).tolist()
            for k in range(short, middle, TOGETHER):
                some = order[k : min(k + TOGETHER, middle)]
                grid, size = grid_of([raw[s:e] for s, e in zip(starts[where[some]].tolist(), ends[where[some]].tolist())])
                got[some] = self.lattice.log_sums(self.lattice.edges(grid, size), size, self.logp)[size, np.arange(len(size))]
            for k in order[middle:]:
                got[k] = self.lattice.long_forward(*self.lattice.long_edges(raw[starts[where[k]] : ends[where[k]]]), self.logp)[-1]
            for k in range(0, short, 8192):
                some = order[k : min(k + 8192, short)]
                grid, size = grid_of([raw[s:e] for s, e in zip(starts[where[some]].tolist(), ends[where[some]].tolist())])
                got[some] = self.lattice.forward(self.lattice.edges(grid, size), size, self.logp)[0]
            out[miss] = got[inv]
            self.key[slot[where]], self.value[slot[where]] = h[where], got
        return out


def remainder(id_col: Column, mod: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def identify(docs: DataFrame, learn: Column, held_out: Column, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score). Learns from rows where `learn` holds and lang is not null."""
    spark = docs.sparkSession
    ship_package(spark)
    named = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    rank = F.xxhash64("doc_id", F.lit(10)).bitwiseAND(F.lit((1 << 30) - 1))
    below = {lang: min(1 << 30, int((1 << 30) * (1.2 * SAMPLE_DOCS + 50) / n)) for lang, n in sorted(counts.items())}
    limits = F.create_map(*(F.lit(x) for pair in below.items() for x in pair)) if below else None
    sample = named.where(rank < limits[F.col("lang")] if below else F.lit(False)).select(F.col("text").cast("string"), F.col("lang").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import language_id as M

        for batch in batches:
            got = M.count_words((t.as_py(), x.as_py()) for t, x in zip(batch.column(0), batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.binary()), pa.array(list(got.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    words = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pieces = vocabulary(path)
    langs, logp = train(words.toArrow(), pieces)
    model = spark.sparkContext.broadcast((zlib.compress(b"\0".join(pieces)), langs, logp.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import language_id as M
        from kinfold.llm.bytewords import texts

        packed, langs, logp = model.value
        scorer = M.Scorer(zlib.decompress(packed).split(b"\0"), logp.astype(np.float64)) if langs else None
        for batch in batches:
            for row, buf, offs in texts(M.lowered(batch.column(1)), 1 << 20):
                n = len(offs) - 1
                best, score = np.full(n, -1), np.zeros(n)
                if scorer is not None and len(buf):
                    starts, ends, at = M.cut_words(buf, offs)
                    c = np.zeros((len(starts) + 1, len(langs)))
                    np.cumsum(scorer.words(buf, starts, ends), axis=0, out=c[1:])
                    total = c[at[1:]] - c[at[:-1]]
                    post = np.exp(total - total.max(1, keepdims=True))
                    post /= post.sum(1, keepdims=True)
                    some = np.flatnonzero(at[1:] > at[:-1])
                    best[some] = post[some].argmax(1)
                    score[some] = post[some, best[some]]
                names = np.array([*langs, "und"], object)[best]
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string"), held_out.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
