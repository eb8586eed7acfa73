"""N-gram Jaccard join by MinHash banding (operator 1).

1. Words are hashed and every five of them make a shingle (a shorter text has one, of all its words). Texts of the
   same words in the same order are copies and become one text, with a number of its own.
2. MinHash: `bands` bands of `rows` minima each. `banding` chooses the least number of bands that finds a pair at the
   threshold with probability `recall`. Texts are shuffled by band hash; those that share one share a bucket.
3. A pair is verified in one bucket only, its first by order of the bands. Which texts have such a partner in which of
   their buckets is found from the band hashes alone, so that a text's shingles go only where they are compared.
4. There the full shingle sets are intersected (a matrix product), and every pair of the bucket that has not met before
   is verified. A large bucket is cut into blocks by a hash of the texts' numbers, of bounded size, and each pair of
   blocks is a group of its own. A group returns a number for each text and a spanning forest of its links, not the links.
5. Connected components of the verified links are the near-duplicate classes.

Only pairs that share a band are compared. The work on n different texts that all resemble each other is n^2 comparisons,
as their links need; it is spread over (n / BLOCK_TEXTS)^2 / 2 groups for each band, and no row stands for a pair.

Defined results: null and empty texts, and those without words, have no shingles and are classes of their own; texts
shorter than five words match only copies; a text of any length has all its shingles compared; an empty table gives an
empty one; repeated rows are copies; a null doc_id is never an id, but its text is compared as any other, and a class all
of whose doc_ids are null has a null class_id; different texts under one doc_id are different texts; of a class the least
doc_id stays, of rows that tie in it the one with the least hash of its text, of equal rows one; further columns are
ignored by `near_duplicates` and kept by `dedup`, whatever their names. Sets are sets of 64-bit hashes of the shingles,
copies are known by 128 bits, and rows are found again by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ._shared import fits, ship_package, small, text_of, written

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Bounds of a block: its texts and their shingles; and its texts where only band hashes are compared. A group is two blocks.
BLOCK_TEXTS, BLOCK_SHINGLES, BLOCK_KEYS = 128, 1_000_000, 1024
#: Buckets of up to so many texts are compared together, many at once.
TOGETHER = 12


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): with p = threshold^rows, a pair at the threshold meets in a band with 1 - (1 - p)^bands."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))), rows


def _signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    ship_package(docs.sparkSession)
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import bytewords as B

        table = B.word_table()
        for batch in batches:
            for row, buf, offs in B.texts(batch.column(1)):
                h, _, _, at = B.words(buf, offs, table)
                s, first = B.shingles(h, at, width)
                n, docs_in = np.diff(first), len(offs) - 1
                some = np.flatnonzero(n)
                mins = np.zeros((bands * rows, len(some)), np.uint32)
                if len(some):
                    s32, v = (s >> np.uint64(32)).astype(np.uint32), np.empty(len(s), np.uint32)
                    for k in range(bands * rows):
                        np.multiply(s32, a[k], out=v)
                        v += b[k]
                        mins[k] = np.minimum.reduceat(v, first[:-1][some])
                keys = np.zeros((docs_in, bands), np.uint64)
                for t in range(bands):
                    x = np.full(len(some), t + 1, np.uint64)
                    for k in range(t * rows, t * rows + rows):
                        x = B.mix(x ^ mins[k].astype(np.uint64))
                    keys[some, t] = x
                one, _ = B.shingles(h, at, 1 << 40)
                two, _ = B.shingles(B.mix(h + np.uint64(1)), at, 1 << 40)
                sig = np.zeros((2, docs_in), np.uint64)
                sig[0, some], sig[1, some] = one, two
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(keys[some].ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, docs_in), batch.column(2).slice(row, docs_in), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64)), pa.array(n), lists],
                    names=["doc_id", "h", "sig1", "sig2", "n", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "h").mapInArrow(run, f"doc_id {kind}, h long, sig1 long, sig2 long, n long, bands array<long>")


def _blocks(of: str, n_blocks: str) -> tuple[list, list]:
    """Expressions for the pairs of blocks that a row takes part in: to explode, and to select then."""
    own = F.pmod(F.xxhash64(of), F.col(n_blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.col(n_blocks).cast("int") - 1)).alias("other")
    return [own, every], [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block"]


def _homes(met: DataFrame) -> DataFrame:
    """(band, bh, cid): the texts that have a partner in the bucket whom they meet in no earlier band.

    met: (band, bh, cid, m, bands), m being the size of the bucket."""
    first, then = _blocks("cid", "n_blocks")
    tiles = met.withColumn("n_blocks", F.ceil(F.col("m") / BLOCK_KEYS)).select("band", "bh", "cid", "bands", *first).select("band", "bh", *then, "cid", "bands")
    dealt = tiles.repartition("band", "bh", "lo", "hi").sortWithinPartitions("band", "bh", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import ngram_join as M

        def found(rows: pa.Table) -> pa.RecordBatch:
            band, bh, lo, hi, block, cid = (rows.column(k).to_numpy() for k in range(6))
            keys = rows.column(6).combine_chunks().flatten().to_numpy().reshape(len(band), -1)
            new = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (bh[1:] != bh[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            keep = M.with_partners(keys, band, block, lo != hi, new)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (band, bh, cid)], names=["band", "bh", "cid"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            if len(rows) < 4 * M.BLOCK_KEYS:
                continue
            last = [rows.column(k)[-1] for k in range(4)]  # the last group may go on
            cut = len(rows)
            while cut and [rows.column(k)[cut - 1] for k in range(4)] == last:
                cut -= 1
            if cut:
                yield found(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).combine_chunks().to_batches()
        if held and sum(map(len, held)):
            yield found(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "band int, bh long, cid long").distinct()


def with_partners(keys: np.ndarray, band: np.ndarray, block: np.ndarray, across: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which rows have a partner in their group that they share no earlier band with.

    keys: all band hashes of each row; first: where the groups begin; across: of groups of two blocks, whose pairs within
    a block are another group's."""
    out = np.zeros(len(band), bool)
    sizes = np.diff(np.append(first, len(band)))
    for m in range(2, TOGETHER + 1):
        of = first[sizes == m]
        for i, j in zip(*np.triu_indices(m, 1)):
            a, b = of + i, of + j
            use = ~across[a] | (block[a] != block[b])
            a, b = a[use], b[use]
            equal = keys[a] == keys[b]
            new = equal.argmax(1) == band[a]  # the first band that both share
            out[a[new]] = out[b[new]] = True
    for k, m in zip(first[sizes > TOGETHER], sizes[sizes > TOGETHER]):
        ok = ~met_before(keys[k : k + m], band[k])
        np.fill_diagonal(ok, False)
        if across[k]:
            ok &= block[k : k + m, None] != block[None, k : k + m]
        out[k : k + m] = ok.any(1)
    return out


def met_before(keys: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of rows share an earlier band."""
    out = np.zeros((len(keys), len(keys)), bool)
    for t in range(band):
        out |= keys[:, t, None] == keys[None, :, t]
    return out


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """rows: (cid, bands, at, text). The same, with the text's distinct shingle hashes as bytes instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import bytewords as B

        table = B.word_table()
        for batch in batches:
            for row, buf, offs in B.texts(batch.column(3)):
                h, _, _, at = B.words(buf, offs, table)
                s, first = B.shingles(h, at, width)
                sets = [np.unique(s[first[k] : first[k + 1]]).tobytes() for k in range(len(offs) - 1)]
                part = batch.slice(row, len(offs) - 1)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(sets, pa.binary())], names=["cid", "bands", "at", "set"])

    kinds = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in ("cid", "bands", "at"))
    return rows.select("cid", "bands", "at", "text").mapInArrow(run, f"{kinds}, set binary")


def _verified(threshold: float):
    def run(tile: pa.Table) -> pa.Table:
        from kinfold.llm import ngram_join as M

        tile = tile.take(pc.sort_indices(tile, [("cid", "ascending")]))
        cid, block, band = tile.column("cid").to_numpy(), tile.column("block").to_numpy(), tile.column("band")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("set")]
        keys = tile.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        n = np.array([len(x) for x in sets], np.int64)
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        use = count[inverse] > 1
        column, owner = shared[inverse[use]], owner[use]
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        common = np.zeros((len(sets), len(sets)), np.float32)
        step = 4096
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + step, step))
        for lo, hi in zip(edges, edges[1:]):
            x = np.zeros((len(sets), step), np.float32)
            x[owner[lo:hi], column[lo:hi] % step] = 1
            common += x @ x.T
        link = (common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6) & ~M.met_before(keys, band)
        np.fill_diagonal(link, False)
        if tile.column("lo")[0].as_py() != tile.column("hi")[0].as_py():
            link &= block[:, None] != block[None, :]
        root = np.arange(len(sets))
        for k in range(len(sets)):
            if root[k] == k:
                todo = [k]
                while todo:
                    i = todo.pop()
                    for j in np.flatnonzero(link[i] & (root > k)):
                        root[j] = k
                        todo.append(j)
        links = link.sum(1)
        some = np.flatnonzero(links)
        return pa.table({"cid": cid[some], "root": cid[root[some]], "links": links[some].astype(np.int64)})

    return run


def _classified(docs: DataFrame, threshold: float, recall: float, width: int) -> DataFrame:
    """(doc_id, h, cid, grp, class_id, n_links, copy_id), a row for each row of docs; h: xxhash64 of the text; cid: the
    number of the text, null without words; grp: the least cid of the class."""
    text = text_of(docs)
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    bands, rows = banding(threshold, recall)
    signed = written(_signatures(docs, width, bands, rows), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    copies = signed.where("n > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("copy_id"), least.alias("row"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    copies = copies.select("sig1", "sig2", "copy_id", F.xxhash64("row.doc_id", "row.h").alias("key"), "n", "bands", F.monotonically_increasing_id().alias("cid"))
    copies = written(copies, "copies")  # which makes the numbers last
    members = copies.select("cid", F.posexplode("bands").alias("band", "bh"))
    # written, so that a join on the buckets has a shuffle on either side, of which Spark splits the skewed parts
    shared = written(members.groupBy("band", "bh").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    met = members.join(shared, ["band", "bh"]).join(copies.select("cid", "bands"), "cid")
    homes = written(_homes(met), "homes")
    sizes = homes.join(copies.select("cid", "n"), "cid").groupBy("band", "bh").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    sizes = written(sizes, "sizes")
    placed = homes.join(sizes, ["band", "bh"]).groupBy("cid").agg(F.collect_list(F.struct("band", "bh", "n_blocks")).alias("at"))  # at most `bands` of a text
    placed = written(placed.join(copies.select("cid", "key", "bands"), "cid"), "placed")
    # of the texts only those with a partner go on, each once
    keyed = docs.select(F.xxhash64("doc_id", "h").alias("key"), "text")
    if fits(placed):
        keyed = keyed.join(F.broadcast(placed.select("key")), "key", "left_semi")
    active = keyed.join(placed, "key").groupBy("cid").agg(*(F.first(x).alias(x) for x in ("bands", "at", "text")))
    first, then = _blocks("cid", "n_blocks")
    tiles = _sets(active, width).select("cid", "bands", "set", F.explode("at").alias("x")).select("cid", "bands", "set", "x.*")
    tiles = tiles.select("band", "bh", "cid", "bands", "set", *first).select("band", "bh", *then, "cid", "bands", "set")
    found = written(tiles.groupBy("band", "bh", "lo", "hi").applyInArrow(_verified(threshold), "cid long, root long, links long"), "links")
    groups, rounds, converged = components(found, "cid", "root", lambda df: written(df, "groups"))
    if not converged:
        raise RuntimeError(f"the classes were not complete after {rounds} rounds")
    groups = groups.select(F.col("node").alias("cid"), F.col("component").alias("grp"))
    ids = groups.join(copies.select("cid", "copy_id"), "cid").groupBy("grp").agg(F.min("copy_id").alias("class_id"))
    linked = found.groupBy("cid").agg(F.sum("links").alias("n_links")).join(groups, "cid").join(ids, "grp")
    classes = copies.select("sig1", "sig2", "cid", "copy_id").join(linked, "cid", "left")
    classes = classes.select(
        "sig1", "sig2", F.lit(True).alias("has"), "cid", "copy_id", F.coalesce("grp", "cid").alias("grp"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("grp").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"),
    )
    out = signed.select("doc_id", "h", "sig1", "sig2", F.when(F.col("n") > 0, True).alias("has")).join(classes, ["sig1", "sig2", "has"], "left")
    own = lambda c: F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "h", "cid", "grp", own("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own("copy_id"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """(doc_id, class_id, n_links, copy_id), a row for each row of docs.

    class_id: the least doc_id that chains of similar texts lead to; n_links: how many different texts are similar to
    this one (copies of them count once); copy_id: the least doc_id with the same words."""
    return _classified(docs, threshold, recall, width).select("doc_id", "class_id", "n_links", "copy_id")


def dedup(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """One row of docs for each near-duplicate class, with all its columns, and all rows without words."""
    rows = written(_classified(docs, threshold, recall, width).where("cid IS NOT NULL").select("grp", "doc_id", F.xxhash64("doc_id", "h").alias("key"), "h"), "classes")
    best = rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "key")).alias("b"), F.count("*").alias("n"))
    stay = best.select("grp", F.col("b.key").alias("stays"), "n")
    others = rows.join(stay.where("n > 1"), "grp")
    gone = others.where("key <> stays").select("key").distinct()
    key = F.xxhash64(docs["doc_id"], F.xxhash64(text_of(docs)))
    out = docs.join(gone, key == gone["key"], "left_anti")
    twice = written(others.where("key = stays").groupBy("key").count().where("count > 1").select("key"), "repeated")
    if twice.isEmpty():
        return out
    twice = small(twice)
    once = docs.select(key.alias("key"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")).join(twice, "key", "left_semi")
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("n = 1").select("row.*")
    return out.join(twice, key == twice["key"], "left_anti").unionAll(once)
