"""Token ids in patched frame-of-reference blocks.

Ids of documents in ascending doc_id order go to pages.  A page holds whole
documents and is cut into blocks of ``BLOCK`` ids; a block stores its minimum,
the differences to it packed at the width of one of ``PERCENTILES`` of their bit
lengths (the one with the smallest block), and the others whole in a list of
exceptions.  A page's header lists where its blocks start, so one block can be
read alone.  Pages are rows of a Parquet table, which commits atomically and
lives in any store that Spark can write:

    shard int, page int     place of the page; shards and pages ascend with doc_id
    first, n long           ids of the shard before the page, ids in it
    block_at array<int>     where each block starts in the payload
    payload binary          the blocks
    doc_id, doc_n array     its documents and how many ids each has

A block: uint16 n, uint8 width, uint32 minimum, uint16 exceptions, the packed
bits (little end first), then per exception uint16 place and uint32 difference.

Defined cases: null or empty text is the end id alone; rows that share a doc_id
follow in the order of their texts' hashes; a null doc_id comes first.  Other
columns are ignored, an empty table gives no page.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokenizer_files

BLOCK, PAGE, END = 2048, 1 << 16, 2
#: So many rows of two numbers, 16 MB, are broadcast at the most; beyond that they are joined.
SHARDS = 1_000_000
PERCENTILES = (75, 90, 95, 99, 100)
PAGES = "shard int, page int, first long, n long, block_at array<int>, payload binary, doc_id array<long>, doc_n array<long>"
HEAD, HEAD_SIZE = "<HBIH", 9


def pack_block(values: np.ndarray) -> bytes:
    """One block of 1 to 65,535 unsigned values below 2**32."""
    low = int(values.min())
    delta = (values - low).astype(np.uint32)
    bits = np.frexp(delta.astype(np.float64))[1]
    count = np.cumsum(np.bincount(bits, minlength=33))  # values that fit each width
    widths = {int(np.searchsorted(count, p * len(delta) / 100)) for p in PERCENTILES}
    width = min(widths, key=lambda w: (len(delta) * w / 8 + 6 * (len(delta) - count[w]), w))
    late = np.flatnonzero(bits > width) if count[width] < len(delta) else bits[:0]
    lane = 16 if width <= 16 else 32
    raw = delta.astype(f"<u{lane // 8}").view(np.uint8)
    packed = np.packbits(np.unpackbits(raw, bitorder="little").reshape(-1, lane)[:, :width].reshape(-1), bitorder="little").tobytes() if width else b""
    return struct.pack(HEAD, len(delta), width, low, len(late)) + packed + late.astype("<u2").tobytes() + delta[late].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    n, width, low, late = struct.unpack_from(HEAD, data, at)
    at += HEAD_SIZE
    size, lane = (n * width + 7) // 8, 16 if width <= 16 else 32
    bits = np.zeros((n, lane), dtype=np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
    out = np.packbits(bits.reshape(-1), bitorder="little").view(f"<u{lane // 8}").astype("<u4")
    at += size
    if late:
        out[np.frombuffer(data, "<u2", late, at)] = np.frombuffer(data, "<u4", late, at + 2 * late)
    return out + np.uint32(low)


def pages(batches: Iterator[pa.RecordBatch], file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    cache = tokenizer_files.id_cache(file, pattern)
    end = np.array([END], dtype="<u4")
    context = TaskContext.get()
    shard = context.partitionId() if context else 0
    page, first, held, names, sizes, total = 0, 0, [], [], [], 0

    def closed() -> pa.RecordBatch:
        ids = np.concatenate(held)
        blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
        starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]).astype(np.int32)
        one = lambda x, kind: pa.array([x], kind)
        return pa.RecordBatch.from_arrays(
            [one(shard, pa.int32()), one(page, pa.int32()), one(first, pa.int64()), one(len(ids), pa.int64()), one(starts.tolist(), pa.list_(pa.int32())), one(b"".join(blocks), pa.binary()), one(names, pa.list_(pa.int64())), one(sizes, pa.list_(pa.int64()))],
            names=["shard", "page", "first", "n", "block_at", "payload", "doc_id", "doc_n"],
        )

    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), cache.encode_all(batch.column(1))):
            held += ids, end
            names.append(name)
            sizes.append(len(ids) + 1)
            total += sizes[-1]
            if total >= PAGE:
                yield closed()
                page, first, held, names, sizes, total = page + 1, first + total, [], [], [], 0
    if held:
        yield closed()


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of pages: shard, place in the shard, doc_id, ids."""
    for batch in batches:
        for row in range(batch.num_rows):
            shard, first, n, starts, payload, names, sizes = (batch.column(c)[row].as_py() for c in range(7))
            ids = np.concatenate([unpack_block(payload, at) for at in starts])
            assert len(ids) == n
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(names), shard, np.int32)), pa.array(first + cuts[:-1]), pa.array(names, pa.int64()), pa.array(np.array(sizes, dtype=np.int64)), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                names=["shard", "place", "doc_id", "n_tokens", "ids"],
            )


def write(docs: DataFrame, path: str, folder: str | None = None) -> None:
    """Writes the whole texts' ids, each document ended by ``END``, in ascending doc_id order."""
    file, pattern = tokenizer_files.library_file(docs.sparkSession, folder), tokenizer_files.pattern()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    # The hash after the id parts rows of one id, however many there are.
    ranged = texts.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie.asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie.asc())
    ranged.mapInArrow(lambda b: pages(b, file.value, pattern), PAGES).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    table = spark.read.schema(PAGES).parquet(path)
    # One row a shard: as many as the writer's partitions, whatever they hold.
    sizes = table.groupBy("shard").agg(F.sum("n").alias("n"))
    few = sizes.count() <= SHARDS
    before = sizes.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = table.select("shard", "first", "n", "block_at", "payload", "doc_id", "doc_n").mapInArrow(documents, "shard int, place long, doc_id long, n_tokens long, ids binary")
    return rows.select("shard", "place", "doc_id", "n_tokens", "ids").join(F.broadcast(before) if few else before, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")
