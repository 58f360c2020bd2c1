"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt out by ranges of their id, sorted, encoded and written as
segments of whole documents.  A segment is one binary value:

    magic "PFOR1", numbers of documents, tokens and blocks
    document ids (64 bits) and token counts (64 bits)
    block index: where each block starts in what follows (64 bits)
    blocks of up to 256 ids

A block is its least id, the bit width, the number of exceptions, the packed low
bits of (id - least), and for each exception its place and its high bits.  The
width is the one that holds the given percentile of the block; what does not fit
is an exception.  Spark's Parquet writer commits the segments, so a task that is
run again leaves no half file; shard and start number the tokens of a shard.

Null texts count as empty and hold the end id only.  A null id sorts first and
reads back as null; repeated ids keep one row each, ordered by their text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnline.llm.common import arrow_map, as_bytes, per_worker, slices
from turnline.llm.tokencount import PieceCoder, read_text

MAGIC = b"PFOR1"
HEAD = struct.Struct("<5sqqq")
BLOCK_HEAD = struct.Struct("<IBH")
HEAD_FIELDS = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])  # the same for many blocks at once
BLOCK, LANES = 256, 32
NULL_ID = -(1 << 63)

#: A segment is closed when it has so many tokens; a longer document is a segment of its own.
SEGMENT_TOKENS = 1 << 18

#: Share of a block's ids, in percent, that the packed width must hold.
PERCENTILE = 95


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 32 numbers below 2**width as rows of ``width`` 32-bit words."""
    out = np.zeros((len(values), width + 1), np.uint64)
    for i in range(LANES):
        word, shift = divmod(i * width, 32)
        moved = values[:, i] << np.uint64(shift)
        out[:, word] |= moved & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= moved >> np.uint64(32)
    return out[:, :width].astype("<u4")


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(words), width + 2), np.uint64)
    wide[:, :width] = words
    out = np.empty((len(words), LANES), np.uint64)
    for i in range(LANES):
        word, shift = divmod(i * width, 32)
        both = wide[:, word] | wide[:, word + 1] << np.uint64(32)
        out[:, i] = both >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return out


def bit_width(numbers: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(numbers.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block starts and the blocks' bytes; the last block is filled up with its least id."""
    if not len(ids):
        return np.zeros(0, "<i8"), b""
    n_blocks = -(-len(ids) // BLOCK)
    rows = np.full(n_blocks * BLOCK, ids[-1], np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(n_blocks, BLOCK)
    least = rows.min(axis=1)
    delta = rows - least[:, None]
    width = bit_width(np.partition(delta, BLOCK * percentile // 100 - 1, axis=1)[:, BLOCK * percentile // 100 - 1])
    high = delta >> width[:, None].astype(np.uint64)
    low = delta - (high << width[:, None].astype(np.uint64))
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            words = pack(low[at].reshape(-1, LANES), int(w)).reshape(len(at), -1)
            data, size = words.tobytes(), words.shape[1] * 4
            for k, i in enumerate(at.tolist()):
                packed[i] = data[k * size : (k + 1) * size]
    block_of, place = np.nonzero(high)
    bounds = np.searchsorted(block_of, np.arange(n_blocks + 1))
    places, tops = place.astype("u1").tobytes(), high[block_of, place].astype("<u4").tobytes()
    blocks = [
        BLOCK_HEAD.pack(m, w, b - a) + body + places[a:b] + tops[4 * a : 4 * b]
        for m, w, a, b, body in zip(least.tolist(), width.tolist(), bounds.tolist(), bounds[1:].tolist(), packed)
    ]
    sizes = np.fromiter(map(len, blocks), np.int64, n_blocks)
    return (np.cumsum(sizes) - sizes).astype("<i8"), b"".join(blocks)


def decode_blocks(starts: np.ndarray, blocks: bytes) -> np.ndarray:
    """The ids of the blocks that start at the given places, 256 each."""
    rows, data, starts = np.zeros((len(starts), BLOCK), np.uint64), np.frombuffer(blocks, "u1"), np.asarray(starts, np.int64)
    heads = data[starts[:, None] + np.arange(BLOCK_HEAD.size)].copy().view(HEAD_FIELDS).reshape(-1)
    least, width, exceptions = heads["least"].astype(np.uint64), heads["width"].astype(np.int64), heads["exceptions"].astype(np.int64)
    packed = starts + BLOCK_HEAD.size
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            words = b"".join([blocks[a : a + BLOCK // 8 * w] for a in packed[at].tolist()])
            rows[at] = unpack(np.frombuffer(words, "<u4").reshape(-1, w), w).reshape(-1, BLOCK)
    row = np.repeat(np.arange(len(starts)), exceptions)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    begin = packed + BLOCK // 8 * width
    places = data[begin[row] + nth]
    tops = data[((begin + exceptions)[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    rows[row, places] |= tops.astype(np.uint64) << width[row].astype(np.uint64)
    return (rows + least[:, None]).astype("<u4")


def encode_segment(doc_ids: list, counts: list[int], ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    starts, blocks = encode_blocks(ids, percentile)
    names = np.array([NULL_ID if i is None else i for i in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, len(names), len(ids), len(starts)), names.tobytes(),
                     np.array(counts, "<i8").tobytes(), starts.tobytes(), blocks])


def segment_parts(segment: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, bytes]:
    magic, n_docs, n_tokens, n_blocks = HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size
    doc_ids, counts = np.frombuffer(segment, "<i8", 2 * n_docs, at).reshape(2, n_docs)
    starts = np.frombuffer(segment, "<i8", n_blocks, at + 16 * n_docs)
    return doc_ids, counts, n_tokens, starts, segment[at + 16 * n_docs + 8 * n_blocks :]


def decode_segment(segment: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all ids in a row."""
    doc_ids, counts, n_tokens, starts, blocks = segment_parts(segment)
    return doc_ids, counts, decode_blocks(starts, blocks).reshape(-1)[:n_tokens]


def read_range(segment: bytes, first: int, count: int) -> np.ndarray:
    """Some ids of a segment; only the blocks that hold them are decoded, found by the index."""
    _, _, n_tokens, starts, blocks = segment_parts(segment)
    last = min(n_tokens, first + count)
    a, b = first // BLOCK, -(-last // BLOCK)
    return decode_blocks(starts[a:b], blocks).reshape(-1)[first - a * BLOCK : last - a * BLOCK]


SEGMENT_SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("shard_start", T.LongType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("segment", T.BinaryType()),
])


def write_token_files(
    docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1, shards: int | None = None,
    segment_tokens: int = SEGMENT_TOKENS, percentile: int = PERCENTILE, id_column: str = "doc_id", text_column: str = "text",
) -> None:
    """Encode all documents, append ``end_id`` to each and write segments below ``path`` in ascending id order."""
    spark = docs.sparkSession
    content = read_text(tokenizer_file)
    shared = spark.sparkContext.broadcast(content)  # one tokenizer file, of fixed size
    key = ("pieces", hashlib.sha256(content.encode()).hexdigest())
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(key, lambda: PieceCoder(shared.value))
        shard, before = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal before, tokens
            names, coded = zip(*held)
            ids = np.frombuffer(b"".join(coded), "<u2")
            segment = encode_segment(list(names), [len(c) // 2 for c in coded], ids, percentile)
            row = pa.RecordBatch.from_pylist(
                [{"shard": shard, "shard_start": before, "n_docs": len(held), "n_tokens": len(ids), "segment": segment}],
                schema=pa.schema([("shard", pa.int32()), ("shard_start", pa.int64()), ("n_docs", pa.int64()),
                                  ("n_tokens", pa.int64()), ("segment", pa.binary())]),
            )
            before += len(ids)
            held.clear()
            tokens = 0
            return row

        for part in slices(batches, "text_", 14 << 20):
            coded = coder.encode(part.column("text_"))
            for name, ids in zip(part.column(0).to_pylist(), coded):
                size = len(ids) // 2 + 1
                if held and tokens + size > segment_tokens:
                    yield close()
                held.append((name, ids + end))
                tokens += size
        if held:
            yield close()

    named = docs.select(F.col(id_column).cast("long").alias("id_"), as_bytes(text_column).alias("text_"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # The sampling of ranges needs the ids only to be balanced; equal ids meet in one shard.
    dealt = named.repartitionByRange(shards, "id_").sortWithinPartitions("id_", "text_")
    arrow_map(dealt, run, SEGMENT_SCHEMA, remembers=True).write.option("compression", "none").parquet(path)


def shard_starts(segments: DataFrame) -> DataFrame:
    """Tokens before each shard: one row per shard, of which there are as many as there were write tasks."""
    sizes = segments.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))


#: What a reader can return of a document: a column, its type, and how it follows from the ids (little-endian, 32 bits).
Output = tuple[str, T.DataType, Callable[[bytes], object]]

IDS: Output = ("ids", T.BinaryType(), bytes)
CHECKSUM: Output = ("ids_crc32", T.LongType(), zlib.crc32)


def read_token_files(spark: SparkSession, path: str, output: Output = IDS) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and the output, worked
    out where the segment was decoded."""
    name, kind, function = output
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "segment"):
            for before, segment in zip(part.column("before").to_pylist(), part.column("segment").to_pylist()):
                names, counts, ids = decode_segment(segment)
                data, ends = ids.tobytes(), np.cumsum(counts)
                bounds = [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64(), mask=names == NULL_ID), pa.array(before + ends - counts, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array([function(data[a:b]) for a, b in zip(bounds, bounds[1:])], to_arrow_type(kind))],
                    names=["doc_id", "start", "n_tokens", name],
                )

    placed = segments.join(F.broadcast(shard_starts(segments)), "shard").select(
        (F.col("before") + F.col("shard_start")).alias("before"), "segment"
    )
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])
    return arrow_map(placed, run, schema)
