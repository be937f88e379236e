"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification.

Fingerprints are cut into seven blocks; two that differ in at most four bits agree on
three blocks at least, so they meet under one of the 35 masks of three blocks (27 bits or
more). Texts with equal fingerprints are collapsed first. Inside a block group members
are linked by breadth-first search over the unvisited rest, which emits a spanning
star, never all pairs; groups beyond ``CELL`` members are dealt as a grid of cells, each
of which sees two slices, so every pair still meets in one task of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import spans
from siltstone.llm.components import components
from siltstone.session import cut

#: Members of a block group that one task compares at once.
CELL = 8192
#: Groups of up to so many members are compared by shifted vectors.
SMALL = 32


def fingerprint(text: bytes, words_per_shingle: int = 4) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of word shingles, repeats included; no word: 0."""
    words = text.split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    n = len(words) - words_per_shingle + 1
    ends = (starts + sizes)[words_per_shingle - 1 :]
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, row_col: str | None = None) -> DataFrame:
    """``(row_, doc_id, fp)``: A-Z lower-cased, fp as a signed long. Null and blank texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                data, offsets = spans.text_buffer(part.column("text"))
                raw = data.tobytes().lower()
                at = offsets.tolist()
                fps = [fingerprint(raw[a:b], words_per_shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch({"row_": part.column("row_"), "doc_id": part.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    row = F.col(row_col) if row_col else F.lit(0)
    rows = docs.select(row.cast("long").alias("row_"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(spans.tidy(run), "row_ long, doc_id long, fp long")


def block_masks(distance: int = 4, blocks: int = 7) -> list[int]:
    """Masks that keep ``blocks - distance`` of the blocks; signed, for Spark's long."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = (sum(part[i] for i in kept) for kept in combinations(range(blocks), blocks - distance))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _star(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest member, member) of each linked set among distinct values, by search over the rest."""
    roots, nodes = [], []
    rest = np.sort(values)
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[:1]], rest[1:]
        while queue and len(rest):
            front = queue.pop()
            for value in front:
                near = np.bitwise_count(rest ^ value) <= distance
                if near.any():
                    queue.append(rest[near])
                    nodes.append(rest[near])
                    roots.append(np.full(int(near.sum()), root, np.uint64))
                    rest = rest[~near]
                if not len(rest):
                    break
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *roots]), np.concatenate([empty, *nodes])


def _linked(keys: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows of equal (adjacent) keys."""
    n = len(values)
    begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    group = np.repeat(np.arange(len(begins)), sizes)
    one, two = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    small = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= SMALL))
    v, g = values[small], group[small]
    for shift in range(1, SMALL):
        if len(v) <= shift:
            break
        same = (g[shift:] == g[:-shift]) & (np.bitwise_count(v[shift:] ^ v[:-shift]) <= distance)
        if not (g[shift:] == g[:-shift]).any():
            break
        one.append(v[:-shift][same])
        two.append(v[shift:][same])
    for i in np.flatnonzero(sizes > SMALL):
        a, b = _star(np.unique(values[begins[i] : begins[i] + sizes[i]]), distance)
        one.append(a)
        two.append(b)
    return np.concatenate(one), np.concatenate(two)


def _edges(keyed: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Edges of rows that are partitioned and sorted by ``keys``; a task holds one group and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = np.empty((0, len(keys)), np.int64), np.empty(0, np.uint64)

        def emit(k: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _linked(k, v, distance)
            if len(a):
                yield pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
            k = np.concatenate([held_k, k])
            v = np.concatenate([held_v, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            differ = np.flatnonzero((k != k[-1]).any(axis=1)) if len(k) else np.empty(0, np.int64)
            last = int(differ[-1]) + 1 if len(differ) else 0
            yield from emit(k[:last], v[:last])
            held_k, held_v = k[last:], v[last:]
        yield from emit(held_k, held_v)

    return keyed.select(*keys, "fp").mapInArrow(spans.tidy(run), "a long, b long")


def links(nodes: DataFrame, distance: int = 4, blocks: int = 7, cell: int = CELL) -> DataFrame:
    """Spanning edges ``(a, b)`` among distinct fingerprints ``(fp)``: joins on blocks, then Hamming distance."""
    masks = block_masks(distance, blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    keyed = nodes.select("fp", F.explode(keys).alias("x")).select("x.t", "x.k", "fp").repartition("t", "k")
    hot = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > cell).select("t", "k", F.ceil(F.col("n") / (cell // 2)).cast("int").alias("slices"))
    cold = keyed.join(hot, ["t", "k"], "left_anti").repartition("t", "k").sortWithinPartitions("t", "k")
    sliced = keyed.join(hot, ["t", "k"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    dealt = sliced.select("t", "k", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("j"))
    grid = dealt.select("t", "k", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp").repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return _edges(cold, ["t", "k"], distance).unionByName(_edges(grid, ["t", "k", "i", "j"], distance))


def near_duplicates(docs: DataFrame, distance: int = 4, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    component_id is the smallest doc_id reachable over links of at most ``distance``
    differing bits. Blank and null texts share fingerprint zero and are linked like any
    other. Repeated rows each get a row; a null doc_id takes part but never is a
    component's id unless no other is there. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words_per_shingle))
    labelled = _labelled(fps, distance)
    smallest = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(fps: DataFrame, distance: int) -> DataFrame:
    """``fp, least_id, least_row, root`` of each distinct fingerprint, cut, as it is read again."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_")).alias("least_row"))
    roots = components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    return cut(nodes.join(roots, "fp", "left").select("fp", "least_id", "least_row", F.coalesce("root", "fp").alias("root")))


def keep_one(docs: DataFrame, distance: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """The row of smallest doc_id of each near-duplicate group, with all its columns (null doc_ids last, of
    equal ones the first row). ``docs`` must be a deterministic read, as rows are numbered by place."""
    rows = docs.withColumn("row_", F.monotonically_increasing_id())
    fps = cut(fingerprints(rows, words_per_shingle=words_per_shingle, row_col="row_"))
    kept = _labelled(fps, distance).groupBy("root").agg(F.min("least_row").alias("x")).select("x.row_")
    return rows.join(kept, "row_", "left_semi").drop("row_")
