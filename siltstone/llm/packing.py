"""Best-fit packing planned over a histogram of lengths.

The plan sees counts, not documents: at most one count per length up to the sequence
size. It hands out slots as runs ``(length, ranks, sequences, offset)``; documents get
a rank within their length and take the slot of that rank by a join.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm import bpe, spans
from siltstone.session import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that are ranked in one window group, about.
RANK_GROUP = 100_000


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of each text (null: empty) with its end id. Texts longer than ``size`` are cut into
    pieces of that size, of which the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.tokenizer(tokenizer_path, end_id)
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                ids, at = encoder.encode(*spans.text_buffer(part.column("text")))
                raw = ids.astype("<u4").tobytes()
                total = np.diff(at)
                pieces = (total + size - 1) // size
                row = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = total - (pieces - 1) * size
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
                length = np.where(piece == 0, head[row], size)
                low = 4 * (at[:-1][row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(row)),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(spans.tidy(run), PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs ``(length, first rank, ranks, first sequence, offset)``.

    Equal to placing pieces one by one, longest first, each where it leaves least room.
    Rank r of a run goes to sequence ``first sequence + r - first rank``.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    levels: list[int] = []
    runs, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                insort(levels, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            i = bisect_left(levels, length)
            if i < len(levels):
                left = levels[i]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], levels[i]
            else:
                left, first = size, opened
                n = -(-todo // (size // length))
                opened += n
            each = left // length
            filled = min(n, todo // each)
            for j in range(each if filled else 0):
                runs.append((length, rank, filled, first, size - left + j * length))
                rank += filled
            todo -= filled * each
            put(left - each * length, first, filled)
            first, n = first + filled, n - filled
            if n and todo:  # the rest is less than one sequence takes
                for j in range(todo):
                    runs.append((length, rank + j, 1, first, size - left + j * length))
                put(left - todo * length, first, 1)
                first, n, todo = first + 1, n - 1, 0
            put(left, first, n)
    return runs


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length``; 1 to ``size``) with ``sequence_id`` and gapless ``offset``.

    Ties and repeated rows are ranked in any order, each to a slot of its own. The
    ranks of a frequent length are counted in salted groups and shifted by prefix sums.
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    salts = max(16, -(-sum(counts.values()) // RANK_GROUP))
    salted = pieces.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    group = salted.groupBy("length", "salt_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    base = group.select("length", "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    ranked = salted.withColumn("rank_", F.row_number().over(Window.partitionBy("length", "salt_").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(base, ["length", "salt_"]).withColumn("rank_", F.col("rank_") + F.col("base_"))
    slots = spark.createDataFrame(plan(counts, size), "length long, from_ long, many_ long, first_ long, offset long")
    fits = (ranked["length"] == slots["length"]) & (ranked["rank_"] >= slots["from_"]) & (ranked["rank_"] < slots["from_"] + slots["many_"])
    placed = ranked.join(F.broadcast(slots), fits)  # bounded by lengths and rooms, both at most `size`
    return placed.select(*[ranked[c] for c in pieces.columns], (slots["first_"] + ranked["rank_"] - slots["from_"]).alias("sequence_id"), slots["offset"])


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Cut, plan and place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts are empty (one end id); no documents give no rows; other columns of
    ``docs`` play no part. Pieces are checkpointed, so texts are encoded once.
    """
    return pack(cut(cut_pieces(docs, tokenizer_path, size, end_id)), size)
