"""Files of token ids: documents in ascending doc_id order, in blocks of the range coder.

A file is a table of blocks written by Spark, so it lies wherever Spark can write: part (in order of
doc_id), block (in order within its part), the number of documents and ids, and the body. The body
holds the doc_id and number of ids of each document beside the coded ids, so a block can be read
alone, and ids before it follow from the counts of the other blocks.

Null and empty texts are their end id alone. Rows without doc_id come first; rows of one doc_id are
ordered by the checksum of their text. A long text is a block of its own; an empty table gives files
without blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxstats.llm.idcoder import decode, encode
from boxstats.llm.text import runs
from boxstats.llm.tokens import WORD_TOKENIZER, tokenizer_path, word_ids
from boxstats.storage import scratch_dir

END_ID, SIZE = 2, 49_408
#: Ids of a block, but for a longer single document.
BLOCK_IDS = 4_000_000
BROADCAST_BLOCKS = 250_000
_HEAD = "<III"


def pack_block(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, size: int = SIZE) -> bytes:
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    index = zlib.compress(known.tobytes() + np.diff(numbers, prepend=np.int64(0)).astype("<i8").tobytes() + sizes.astype("<u4").tobytes())
    return struct.pack(_HEAD, len(doc_ids), len(index), zlib.crc32(index)) + index + encode(ids, size)


def unpack_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids and ids."""
    n, length, crc = struct.unpack_from(_HEAD, block)
    index = block[struct.calcsize(_HEAD) : struct.calcsize(_HEAD) + length]
    if zlib.crc32(index) != crc:
        raise ValueError("the index of a block is damaged")
    index = zlib.decompress(index)
    known = np.frombuffer(index, np.uint8, n)
    numbers = np.cumsum(np.frombuffer(index, "<i8", n, n))
    sizes = np.frombuffer(index, "<u4", n, 9 * n).astype(np.int64)
    return [int(x) if k else None for x, k in zip(numbers, known)], sizes, decode(block[struct.calcsize(_HEAD) + length :])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes doc_id and text into files below ``path``."""
    tokenizer = tokenizer or tokenizer_path(WORD_TOKENIZER)

    def work(batches):
        from pyspark import TaskContext

        encoder, part, block = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        names: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def close(count, ids):
            """A block of the first ``count`` documents, whose ids are given."""
            nonlocal block
            block += 1
            size = np.concatenate(sizes)[:count]
            body = pack_block(names[:count], size, ids)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "block": pa.array([block - 1], pa.int32()), "n_docs": pa.array([count], pa.int64()),
                 "n_ids": pa.array([len(ids)], pa.int64()), "body": pa.array([body], pa.binary())}
            )

        for whole in batches:
            for batch in runs(whole):
                ids, offsets = encoder.encode(batch.column("text"), end)
                names.extend(batch.column("doc_id").to_pylist())
                parts.append(ids)
                sizes.append(np.diff(offsets))
                held += len(ids)
                while held >= block_ids:
                    everything, size = np.concatenate(parts), np.concatenate(sizes)
                    ends = np.cumsum(size)
                    count = int(np.searchsorted(ends, block_ids)) + 1
                    used = int(ends[count - 1])
                    yield close(count, everything[:used])
                    names, parts, sizes = names[count:], [everything[used:]], [size[count:]]
                    held -= used
        if names:
            yield close(len(names), np.concatenate(parts))

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
    blocks = ordered.mapInArrow(work, "part int, block int, n_docs long, n_ids long, body binary")
    # Bodies are as dense as they get.
    blocks.write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document."""
    blocks = spark.read.schema("part int, block int, n_docs long, n_ids long, body binary").parquet(path)
    sizes = blocks.select("part", "block", "n_ids")
    # Two prefix sums, over parts and over the blocks of a part, so neither grows with the corpus alone.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_block"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("_part") + F.col("_block")).alias("start"))

    def work(batches):
        for batch in batches:
            for start, body in zip(batch.column("start").to_pylist(), batch.column("body")):
                names, sizes, ids = unpack_block(body.as_py())
                ends = np.cumsum(sizes)
                begins = ends - sizes
                view = memoryview(ids.astype("<u4"))
                crc = [zlib.crc32(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(names, pa.int64()), "start": pa.array(start + begins), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())}
                )

    # Bodies stay where they are as long as the places of blocks are few (24 bytes each).
    starts = F.broadcast(starts) if sizes.count() <= BROADCAST_BLOCKS else starts
    met = blocks.select("part", "block", "body").join(starts, ["part", "block"]).select("start", "body")
    return met.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the files to a new folder that all executors share and reads them back."""
    import uuid

    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, block_ids=block_ids)
    return read(spark, path)
