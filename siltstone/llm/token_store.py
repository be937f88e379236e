"""Token-id files with Elias-Fano document boundaries.

A file is a run of blocks. A block holds the ids of consecutive documents as one array
of the narrowest width that fits, and the documents' ends as an Elias-Fano sequence:
low bits packed, high parts in unary as one bit string, and the position of every 64th
set bit, so that the end of document i is found without a table of 64-bit offsets.
Blocks are written by Spark's own committed writer and read by its binary reader, so any
store Spark knows will do and lost tasks are written again.

Block layout, little-endian: the header ``HEADER`` (magic, number of the range, number
of the block in it, documents, null doc_ids, ids, bytes of an id, low bits, and the
bytes of the sections), then the sections doc_ids (int64), low bits, high bits, select
samples (uint32), ids; then one line feed, which the writer puts after each block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm import bpe, spans
from siltstone.session import cut, scratch

MAGIC = b"SILTEF01"
HEADER = struct.Struct("<8sIIQQQBB5Q")
#: A block is closed at so many ids (a longer document still is one block).
BLOCK_IDS = 2 << 20
#: Blocks of a file, so that a reader can hold it: about 32 MB.
FILE_BLOCKS = 8
#: Input bytes that one writing task is given, about.
TASK_BYTES = 128 << 20
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence in about ``2 + log2(top / n)`` bits a value, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype(np.uint32))

    def _low_of(self, i: int) -> int:
        at = i * self.low_bits
        return int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little") >> (at & 7) & (1 << self.low_bits) - 1

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return ((self.low[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """Value i, from the nearest sample and a scan of the high bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        first, skip = at >> 3, at & 7
        while True:
            bits = np.unpackbits(self.high[first : first + 64], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if len(ones) > left:
                place = first * 8 + int(ones[left])
                return ((place - i) << self.low_bits) + self._low_of(i)
            left, first, skip = left - len(ones), first + 64, 0

    def values(self) -> np.ndarray:
        """All values in order."""
        i = np.arange(self.n)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((places - i) << self.low_bits) + self._low(i)


class Block:
    """Documents of a block: their ids by two selects, without decoding the other boundaries."""

    def __init__(self, number: int, sequence: int, doc_ids: np.ndarray, nulls: int, ends: EliasFano, ids: np.ndarray) -> None:
        self.number, self.sequence, self.doc_ids, self.nulls, self.ends, self.ids = number, sequence, doc_ids, nulls, ends, ids

    def __len__(self) -> int:
        return len(self.doc_ids)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i's ids begin and end in the block."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def get(self, i: int) -> np.ndarray:
        """The ids of document i."""
        a, b = self.bounds(i)
        return self.ids[a:b]


def block(number: int, sequence: int, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    fano = EliasFano.of(ends)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    nulls = sum(x is None for x in doc_ids)
    sections = (
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        fano.low.tobytes(),
        fano.high.tobytes(),
        fano.samples.astype("<u4").tobytes(),
        ids.astype(f"<u{width}").tobytes(),
    )
    return HEADER.pack(MAGIC, number, sequence, len(doc_ids), nulls, len(ids), width, fano.low_bits, *map(len, sections)) + b"".join(sections)


def blocks(content: memoryview) -> Iterator[Block]:
    """The blocks of a file."""
    at = 0
    while at < len(content):
        magic, number, sequence, n, nulls, n_ids, width, low_bits, *sizes = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        part = []
        for size in sizes:
            part.append(content[at : at + size])
            at += size
        at += 1
        samples = np.frombuffer(part[3], "<u4")
        ends = EliasFano(n, low_bits, bytes(part[1]), bytes(part[2]), samples)
        yield Block(number, sequence, np.frombuffer(part[0], "<i8"), nulls, ends, np.frombuffer(part[4], f"<u{width}", n_ids))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty) and write their ids in ascending doc_id order (null first, equal ones by a
    hash of their texts, so that rows of one doc_id spread over tasks as well)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.tokenizer(tokenizer_path, end_id)
        number, sequence = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            made = block(number, sequence, doc_ids, np.concatenate(ids), np.concatenate(ends))
            return pa.record_batch({"block": pa.array([made], pa.binary())})

        for batch in batches:
            for part in spans.chunks(batch, "text"):
                got, at = encoder.encode(*spans.text_buffer(part.column("text")))
                doc_ids += part.column("doc_id").to_pylist()
                ids.append(got.astype("<u4"))
                ends.append(at[1:] + size)
                size += len(got)
                if size >= BLOCK_IDS:
                    yield close()
                    sequence, doc_ids, ids, ends, size = sequence + 1, [], [], [], 0
        if doc_ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie_", F.xxhash64("text"))
    spark, order = docs.sparkSession, ["doc_id", "tie_"]
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = size // TASK_BYTES if size < 1 << 60 else 0  # an unknown size is told as the largest long
    more = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (rows.repartitionByRange(tasks, *order) if more else rows.repartitionByRange(*order)).sortWithinPartitions(*order).select("doc_id", "text")
    made = ordered.mapInArrow(spans.tidy(run), "block binary").select(F.col("block").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``; start counts the ids of all
    documents before it. Equal doc_ids keep the order in which they were written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for block in blocks(memoryview(content.as_buffer())):
                    n = len(block)
                    bounds = np.array([block.bounds(i) for i in range(n)], np.int64).reshape(n, 2)
                    crc = [zlib.crc32(block.ids[a:b].astype("<u4").tobytes()) for a, b in bounds.tolist()]
                    yield pa.record_batch(
                        {
                            "number": pa.array(np.full(n, block.number), pa.int32()),
                            "sequence": pa.array(np.full(n, block.sequence), pa.int32()),
                            "doc_id": pa.array(block.doc_ids, pa.int64(), mask=np.arange(n) < block.nulls),
                            "begin": pa.array(bounds[:, 0]),
                            "n_tokens": pa.array(bounds[:, 1] - bounds[:, 0]),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = cut(files.mapInArrow(spans.tidy(run), "number int, sequence int, doc_id long, begin long, n_tokens long, ids_crc32 long"))
    sizes = found.groupBy("number", "sequence").agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.partitionBy("number").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.select("number", "sequence", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("inner"))
    # one row a range: as few as the writer had tasks
    ranges = sizes.groupBy("number").agg(F.sum("ids").alias("ids"))
    outer = ranges.select("number", F.coalesce(F.sum("ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    base = inner.join(outer, "number").select("number", "sequence", (F.col("inner") + F.col("outer")).alias("base"))
    return found.join(base, ["number", "sequence"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read them back.

    Null texts are one end id; no documents make no block and give no rows; a null
    doc_id comes first. Other columns of ``docs`` play no part.
    """
    path = scratch(docs.sparkSession, "token-store")
    write(docs, path, tokenizer_path, end_id)
    return read(docs.sparkSession, path)
