"""Token ids of many texts by a byte-level BPE of the tokenizers library.

The library encodes each piece that its pre-tokenizer cuts out on its own, so a piece needs encoding once. Pieces
are cut here, on the bytes of many texts at once, by the rules of the public pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
for texts of characters whose class never changed between versions of Unicode (ASCII, Latin letters, common
punctuation) in which no added token of the tokenizer (<|endoftext|> and the like) stands; the library encodes pieces it
has not met, and every other text as a whole.
"""

from __future__ import annotations

import os

import numpy as np

from .bytewords import span_hashes

L, N, S, O, BAD = 0, 1, 2, 3, 4
_VALUES = np.arange(1, 257, dtype=np.uint64)


def _classes() -> np.ndarray:
    t = np.full(256, BAD, np.uint8)
    t[0x21:0x7F] = O
    t[0x30:0x3A] = N
    t[0x41:0x5B] = t[0x61:0x7B] = L
    t[[0x20, 0x09, 0x0A, 0x0D]] = S
    t[0x80:0xC0] = L  # the rest of a character has its first byte's class, which is L unless set below
    t[0xC3:0xCA] = L  # U+00C0 to U+024F
    return t


class ByteBPE:
    #: Slots of the table of known pieces, and ids it may hold before it is emptied.
    SLOTS_LOG2, MOST_IDS = 21, 6_000_000
    TOGETHER = 4096

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings that the library takes out of a text before it cuts pieces
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # of each id: a character of the vocabulary stands for a byte
        self.bytes[np.fromiter(vocab.values(), np.int64, len(vocab))] = np.fromiter(map(len, vocab), np.int64, len(vocab))
        self.classes = _classes()
        self._empty()

    def _empty(self) -> None:
        n = 1 << self.SLOTS_LOG2
        self.key, self.at, self.n = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _batch(self, strings: list[str]) -> list[list[int]]:
        """Ids alone: the library's way that leaves out offsets and words."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _cut(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and which texts are for the library as a whole."""
        c = self.classes[buf]
        size = len(buf)

        def at(i: np.ndarray, k: int) -> np.ndarray:
            return buf[np.minimum(i + k, size - 1)]

        i = np.flatnonzero(buf == 0xC2)  # U+0080 to U+00BF
        if len(i):
            b = at(i, 1)
            ok = (b >= 0xA1) & ~np.isin(b, [0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])
            c[i] = np.where(ok, O, BAD)
            c[i[ok] + 1] = O
        i = np.flatnonzero(buf == 0xC3)  # the two signs among the letters
        if len(i):
            i = i[np.isin(at(i, 1), [0x97, 0xB7])]
            c[i] = c[i + 1] = O
        i = np.flatnonzero(buf == 0xE2)  # U+2010 to U+2027, U+20AC
        if len(i):
            b, d = at(i, 1), at(i, 2)
            ok = ((b == 0x80) & (d >= 0x90) & (d <= 0xA7)) | ((b == 0x82) & (d == 0xAC))
            c[i] = np.where(ok, O, BAD)
            c[i[ok] + 1] = c[i[ok] + 2] = O
        bad = np.zeros(len(offs) - 1, bool)
        bad[np.searchsorted(offs, np.flatnonzero(c == BAD), "right") - 1] = True
        raw = buf.tobytes()
        for token in self.added:
            at_token = raw.find(token)
            while at_token >= 0:
                bad[np.searchsorted(offs, at_token, "right") - 1] = True
                at_token = raw.find(token, at_token + 1)
        new = np.ones(size + 1, bool)
        new[1:size] = c[1:] != c[:-1]
        new[offs] = True
        ends = np.zeros(size + 1, bool)
        ends[offs] = True
        # the last of several white-space characters before something stands apart; a space joins what follows it
        last = np.flatnonzero((c[:-1] == S) & new[1:size] & ~ends[1:size]) if size > 1 else np.zeros(0, np.int64)
        new[last] = True
        new[last[buf[last] == 0x20] + 1] = False
        # contractions
        i = np.flatnonzero((buf[:-1] == 0x27) & new[: size - 1] & new[1:size] & ~ends[1:size] & (c[1:] == L)) if size > 1 else last[:0]
        if len(i):
            a, b = at(i, 1), np.where((i + 2 < size) & ~ends[np.minimum(i + 2, size)], at(i, 2), 0)
            one = np.isin(a, list(b"stmd"))
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            hit = one | two
            i, k = i[hit], np.where(one, 1, 2)[hit]
            new[i + 1] = False
            new[i + 1 + k] = True
        return np.flatnonzero(new[:size]), bad

    def _encoded(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, how many it has). Pieces of a space and letters are cut the same when they stand
        one after another, so that the library takes TOGETHER of them in one call; the bytes of the ids tell which are whose."""
        plain = (ends - starts > 1) & (buf[starts] == 0x20) & (self.classes[buf[np.minimum(starts + 1, len(buf) - 1)]] == L)
        which, alone = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        order, counts, flat = [], [], []
        for k in range(0, len(which), self.TOGETHER):
            some = which[k : k + self.TOGETHER]
            n = ends[some] - starts[some]
            at = np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            ids = np.array(self._batch([buf[at].tobytes().decode()])[0], np.uint32)
            upto, want = np.cumsum(self.bytes[ids]), np.cumsum(n)
            last = np.minimum(np.searchsorted(upto, want), len(ids) - 1)
            if not len(ids) or upto[-1] != want[-1] or (upto[last] != want).any():
                alone.append(some)
                continue
            order.append(some)
            counts.append(np.diff(last, prepend=-1))
            flat.append(ids)
        order.append(np.concatenate(alone))
        raw = buf.tobytes()
        each = self._batch([raw[s:e].decode() for s, e in zip(starts[order[-1]].tolist(), ends[order[-1]].tolist())])
        counts.append(np.fromiter(map(len, each), np.int64, len(each)))
        flat.append(np.fromiter((x for y in each for x in y), np.uint32, int(counts[-1].sum())))
        lens, place = np.zeros((2, len(starts)), np.int64)
        count = np.concatenate(counts)
        lens[np.concatenate(order)], place[np.concatenate(order)] = count, np.cumsum(count) - count
        return np.concatenate(flat), place, lens

    def _known(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in flat, number of ids) of each piece."""
        h = span_hashes(_VALUES[buf], starts, ends) | np.uint64(1)
        slot = (h >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)
        at, n = self.at[slot], self.n[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):  # a piece stands in its slot or in the one beside it
            beside = slot[miss] ^ 1
            found = self.key[beside] == h[miss]
            at[miss[found]], n[miss[found]] = self.at[beside[found]], self.n[beside[found]]
            miss = miss[~found]
        if len(miss):
            _, first, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            where = miss[first]
            flat, place, lens = self._encoded(buf, starts[where], ends[where])
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(flat), len(self.flat)), np.uint32)])
            self.flat[self.used : self.used + len(flat)] = flat
            place = self.used + place
            self.used += len(flat)
            at[miss], n[miss] = place[inv], lens[inv]
            put = slot[where] ^ (self.key[slot[where]] != 0)
            self.key[put], self.at[put], self.n[put] = h[where], place, lens
        return at, n

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the total)."""
        rows = len(offs) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if self.used > self.MOST_IDS:
            self._empty()
        starts, bad = self._cut(buf, offs)
        if bad.any():
            text = np.searchsorted(offs, starts, "right") - 1
            ends = np.append(starts[1:], len(buf))
            keep = ~bad[text]
            starts, ends = starts[keep], ends[keep]
        else:
            ends = np.append(starts[1:], len(buf))
        at, n = self._known(buf, starts, ends)
        out = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(at - out[:-1], n) + np.arange(out[-1])]
        first = out[np.searchsorted(starts, offs)]
        if not bad.any():
            return ids, first
        raw = buf.tobytes()
        which = np.flatnonzero(bad)
        whole = dict(zip(which.tolist(), self._batch([raw[offs[k] : offs[k + 1]].decode() for k in which])))
        parts = [np.asarray(whole[k], np.uint32) if k in whole else ids[first[k] : first[k + 1]] for k in range(rows)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_made: dict[str, ByteBPE] = {}


def byte_bpe(path: str | None = None) -> ByteBPE:
    """One for each Python worker. path: a file of the tokenizers library; the public one of 50,257 ids if None."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _made:
        _made[path] = ByteBPE(path)
    return _made[path]
