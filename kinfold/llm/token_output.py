"""Token ids as compressed binary files (operator 9).

Documents are range-partitioned and sorted by doc_id and tokenised; their ids (with an end id) are coded block by block
by the adaptive context-mixing range coder of token_coder.java. Every block starts from the same empty model: counts of
ids by order 0, 1 and 2 give three distributions, which are mixed with weights that the block learns as it goes, and an
id's share of the mixture is its interval. A shard holds whole documents, about SHARD ids of them, and is a file
`part-<partition>-<number>.ktok` of its own in the folder that the caller names, in any store that Hadoop's file systems
reach. A file gets its name once it is whole, and a task that is run again replaces its files, so that lost executors
leave no half shards.

Layout, little-endian: b"KTOK", version u16, 0 u16, block size u32, vocabulary bound u32, part u32, number u32, ids of
the part before this shard u64, documents u32, ids u64, bytes of the names u32, blocks u32; names; documents x u32 ids;
blocks x (ids u32, crc32 of the ids as u32, bytes u32); the blocks' bytes; crc32 of all before u32. Names are the
doc_ids as text: documents x i32 bytes, -1 for null, then the texts.

Defined results: null text counts as empty, which is the end id alone; null doc_ids come first; rows of one doc_id are
in order of a hash of their text, and equal rows are written as often as they come; a document of any length stays
whole, in a shard that is longer by it (of less than 2^29 ids, so that it is one value of Spark); an empty table gives a
folder without files; a file that fails a check raises an error; further columns are ignored; writing to a folder that
holds shards raises an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from . import jvm
from ._shared import owned, scratch_root, ship_package, small, small_batches, text_of

END, SHARD, BLOCK = 2, 1 << 19, 1 << 14
#: Ids that a task reads, about.
TASK = 8 << 20
SOURCE, HEAD = "token_coder.java", struct.Struct("<IIQIQI")
LISTED = ArrayType(StructType().add("name", "binary").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long"))


def payload(part: int, seq: int, start: int, names: pa.Array, lens: np.ndarray, ids: np.ndarray) -> bytes:
    """What a shard holds, before it is coded. names: doc_ids as strings."""
    names = pa.concat_arrays([names.cast(pa.large_string())])
    offs = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    sizes = np.where(names.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), -1).astype("<i4")
    text = names.buffers()[2].to_pybytes()[offs[0] : offs[-1]] if offs[-1] else b""
    head = HEAD.pack(part, seq, start, len(lens), len(ids), 4 * len(sizes) + len(text))
    return b"".join([head, sizes.tobytes(), text, lens.astype("<u4").tobytes(), ids.astype("<u4").tobytes()])


def parsed(raw: bytes) -> tuple[int, int, pa.Array, np.ndarray, np.ndarray]:
    """(part, start, names, lengths, ids) of a payload."""
    raw = memoryview(raw)
    part, _, start, docs, n, names = HEAD.unpack_from(raw)
    sizes = np.frombuffer(raw, "<i4", docs, HEAD.size)
    ends = HEAD.size + 4 * docs + np.cumsum(np.maximum(sizes, 0))
    found = pa.array([None if n < 0 else str(raw[e - n : e], "utf-8") for e, n in zip(ends.tolist(), sizes.tolist())], pa.string())
    at = HEAD.size + names
    lens = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
    if lens.sum() != n:
        raise ValueError("a shard's parts don't add up")
    return part, start, found, lens, np.frombuffer(raw, "<u4", n, at + 4 * docs)


def functions(spark: SparkSession) -> None:
    """Registers kinfold_write_shard(folder, payload, block), kinfold_code_shard(payload, block), kinfold_read_shard(bytes) and
    kinfold_list_shard(bytes)."""
    for name, kind in (("WriteShard", LongType()), ("CodeShard", BinaryType()), ("ReadShard", BinaryType()), ("ListShard", LISTED)):
        jvm.register(spark, SOURCE, f"kinfold.llm.{name}", "kinfold_" + name.replace("Shard", "_shard").lower(), kind)


def write(docs: DataFrame, path: str, end: int = END, tokenizer: str | None = None, block: int = BLOCK, shard_ids: int = SHARD) -> DataFrame:
    """Writes the shards of docs into the folder `path`, and returns (part, seq, start, n_docs, n_ids, n_bytes) of them."""
    spark = docs.sparkSession
    ship_package(spark)
    functions(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(folder) and len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "*.ktok"))):
        raise ValueError(f"{path} holds shards already")
    fs.mkdirs(folder)
    text = text_of(docs)
    rows = docs.select(docs["doc_id"], text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from kinfold.llm import token_output as O
        from kinfold.llm.bpe import byte_bpe
        from kinfold.llm.bytewords import texts

        bpe, part = byte_bpe(tokenizer), TaskContext.get().partitionId()
        seq = start = held = 0
        names, parts, lens = [], [], []

        def shard() -> pa.RecordBatch:
            nonlocal seq, start, held
            ids, sizes = np.concatenate(parts), np.concatenate(lens)
            row = (part, seq, start, len(sizes), len(ids), O.payload(part, seq, start, pa.concat_arrays(names), sizes, ids))
            names.clear(), parts.clear(), lens.clear()
            seq, start, held = seq + 1, start + len(ids), 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["part", "seq", "start", "n_docs", "n_ids", "payload"])

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row, buf, offs in texts(batch.column(1), 1 << 20):
                ids, first = bpe.encode(buf, offs)
                n = len(offs) - 1
                parts.append(np.insert(ids, first[1:], np.uint32(end)))
                lens.append(np.diff(first) + 1)
                names.append(batch.column(0).slice(row, n))
                held += len(ids) + n
                if held >= shard_ids:
                    yield shard()
        if names:
            yield shard()

    made = rows.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "part int, seq int, start long, n_docs long, n_ids long, payload binary")
    stored = made.select("part", "seq", "start", "n_docs", "n_ids", F.call_function("kinfold_write_shard", F.lit(path), "payload", F.lit(block)).alias("n_bytes"))
    listing = path.rstrip("/") + "/_shards"
    with small_batches(spark):
        # a few files: for each, Hadoop starts processes, which count an executor's memory twice for a moment
        stored.hint("rebalance").write.mode("overwrite").parquet(listing)
    return spark.read.schema(stored.schema).parquet(listing)


def read(spark: SparkSession, path: str, kind: str = "long", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and the ids if with_ids: a row for each document of the files in `path`.

    kind: the type of doc_id. start counts the ids of all documents before, in order of the partitions and shards."""
    ship_package(spark)
    functions(spark)
    shards = spark.read.schema("part int, seq int, start long, n_docs long, n_ids long, n_bytes long").parquet(path.rstrip("/") + "/_shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ids = shards.agg(F.sum("n_ids")).first()[0] or 0
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ktok").load(path).coalesce(max(1, ids // TASK))  # files are small for Spark's scans
    rows = files.select(F.regexp_extract("path", r"part-(\d+)-\d+\.ktok$", 1).cast("int").alias("part"), "content").join(small(bases), "part")
    if not with_ids:  # the ids stay in the JVM
        rows = rows.select("base", F.explode(F.call_function("kinfold_list_shard", "content")).alias("d"))
        name = F.col("d.name").cast("string").cast(kind)
        return rows.select(name.alias("doc_id"), (F.col("base") + F.col("d.start")).alias("start"), "d.n_tokens", "d.ids_crc32")
    rows = rows.select("base", F.call_function("kinfold_read_shard", "content").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import token_output as O

        for batch in batches:
            for base, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, start, found, lens, ids = O.parsed(raw.as_buffer())
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lens.tolist())]
                ptr = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                each = pa.ListArray.from_arrays(ptr, pa.array(ids.astype(np.int32)))
                out = [found, pa.array(base + start + ends - lens), pa.array(lens), pa.array(crc, pa.int64()), each]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    got = rows.mapInArrow(run, "doc_id string, start long, n_tokens long, ids_crc32 long, ids array<int>")
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


def round_trip(docs: DataFrame) -> DataFrame:
    """read() of what write() put into a folder of the shared scratch space, which goes when the driver's interpreter ends."""
    spark = docs.sparkSession
    path = owned(spark, f"{scratch_root(spark)}/kinfold/tokens-{uuid.uuid4().hex}")
    write(docs, path)
    return read(spark, path, docs.schema["doc_id"].dataType.simpleString())
