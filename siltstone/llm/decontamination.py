"""Benchmark decontamination by winnowing.

Items and documents are cut into words; of every ``window - gram + 1`` consecutive word
grams the least hash is kept, so any shared span of ``window`` words shares a kept hash.
Kept hashes join documents with items; each window of a document whose kept hash an item
has is then joined with the items' windows by its words, which is exact. A task hands on
each different window once, with the places it was found at, so a passage that very many
documents hold is no hot key. Items shorter than a window are one window of their own
length, whose hash is kept at every position.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import spans
from siltstone.llm.skew import lookup
from siltstone.session import cut

#: Item hashes that are sent to tasks as a filter (8 bytes each); with more, all kept hashes go to the join.
FILTER_MOST = 1 << 20
#: Bytes of windows and places that a task gathers before it hands them on.
GATHER_BYTES = 16 << 20
_CLASS, _LOWER = spans.alnum_class(), spans.ascii_lower_table()


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, starts, ends and ``first`` of a chunk's words."""
    data, offsets = spans.text_buffer(part.column("text"))
    data = _LOWER[data]
    return data, *spans.word_spans(data, offsets, _CLASS)


def _windows(words: tuple, window: int, gram: int, short: list[int], all_short: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words of a window, document, first word, kept hash) of all windows of a chunk, size by size. With
    ``all_short`` a text of fewer than ``window`` words has its whole length's window only."""
    data, starts, ends, first = words
    hashes, count = spans.hash_spans(data, starts, ends), np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)

    def of(size: int, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        own = owner[: len(values)]
        at = np.flatnonzero(np.arange(len(values)) + size <= first[own + 1]) if len(values) else np.empty(0, np.int64)
        if all_short and size < window:
            at = at[count[own[at]] == size]
        return size, own[at], at, values[at]

    yield of(window, spans.sliding_min(spans.rolling(hashes, gram), window - gram + 1))
    for size in short:
        yield of(size, spans.rolling(hashes, size) ^ np.uint64(0xA24BAED4963EE407 * size & (1 << 64) - 1))


def _kept(words: tuple, window: int, gram: int, short: list[int], all_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of kept hashes."""
    docs, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for _, owner, _, values in _windows(words, window, gram, short, all_short):
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        docs.append(owner[fresh])
        found.append(values[fresh])
    return np.concatenate(docs), np.concatenate(found)


def _texts(words: tuple, size: int, at: np.ndarray) -> list[bytes]:
    """Windows of ``size`` words that begin at given words, the words joined by spaces."""
    data, starts, ends, _ = words
    raw = data.tobytes()
    return [b" ".join([raw[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True)]) for i in at.tolist()]


def _per_row(docs: np.ndarray, found: np.ndarray, n: int) -> pa.ListArray:
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])
    docs, found = docs[fresh], found[fresh]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)), pa.int32()), pa.array(found.view(np.int64)))


def hits(docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 5, filter_most: int = FILTER_MOST) -> DataFrame:
    """One row per document: ``row_, doc_id, n_words, n_hit, item_ids`` (sorted strings).

    ``row_`` numbers the rows, so equal doc_ids stay apart. Null texts have no words;
    items without words or with a null item_id match nothing; equal item_ids are one item.
    """
    spark = docs.sparkSession
    bench = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    lengths = list(range(1, window))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                words = _words(part)
                for size, owner, at, values in _windows(words, window, gram, lengths, True):
                    yield pa.record_batch(
                        {
                            "item_id": part.column("item_id").take(pa.array(owner)),
                            "size": pa.array(np.full(len(at), size, np.int32)),
                            "fp": pa.array(values.view(np.int64)),
                            "words": pa.array(_texts(words, size, at), pa.binary()),
                        }
                    )

    item_windows = cut(bench.mapInArrow(spans.tidy(of_items), "item_id string, size int, fp long, words binary"))
    short = [r.size for r in item_windows.filter(F.col("size") < window).select("size").distinct().collect()]  # fewer than `window` rows
    distinct = item_windows.select("fp").distinct()
    allowed = None
    if distinct.count() <= filter_most:
        allowed = np.sort(np.array([r.fp for r in distinct.collect()], np.int64).view(np.uint64))
    # windows that the same items hold share the number of their set of items
    of_window = item_windows.groupBy("size", "words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    of_window = cut(of_window.withColumn("set_", F.sha2(F.concat_ws(",", F.transform("item_ids", lambda x: F.hex(x.cast("binary")))), 256)))
    sets = of_window.groupBy("set_").agg(F.first("item_ids").alias("item_ids"))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                words = _words(part)
                docs_, found = _kept(words, window, gram, short, False)
                if allowed is not None:
                    at = np.searchsorted(allowed, found)
                    in_items = allowed[np.minimum(at, len(allowed) - 1)] == found if len(allowed) else np.zeros(len(found), bool)
                    docs_, found = docs_[in_items], found[in_items]
                any_ = np.bincount(docs_, minlength=part.num_rows) > 0
                yield pa.record_batch(
                    {
                        "row_": pa.array(np.arange(row, row + part.num_rows), pa.int64()),
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array(np.diff(words[-1]), pa.int64()),
                        "fps": _per_row(docs_, found, part.num_rows),
                        "text": part.column("text").take(pa.array(np.arange(part.num_rows), mask=~any_)),
                    }
                )
                row += part.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = cut(rows.mapInArrow(spans.tidy(of_docs), "row_ long, doc_id long, n_words long, fps array<long>, text string"))
    asking = seen.filter("text IS NOT NULL").select("row_", "fps", "text")
    if allowed is None:
        met = lookup(asking.select("row_", F.explode("fps").alias("fp")), distinct.withColumn("there", F.lit(True)), ["fp"]).filter("there")
        asking = asking.drop("fps").join(met.groupBy("row_").agg(F.collect_list("fp").alias("fps")), "row_").select("row_", "fps", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows with a hash that an item has, each once, with its places."""
        held: dict[tuple[int, bytes], array] = {}
        bytes_ = 0

        def flush() -> pa.RecordBatch:
            places = [x.tobytes() for x in held.values()]
            return pa.record_batch({"size": pa.array([n for n, _ in held], pa.int32()), "words": pa.array([w for _, w in held], pa.binary()), "places": pa.array(places, pa.binary())})

        for batch in batches:
            for part in spans.chunks(batch, "text"):
                words = _words(part)
                lists, row, first = part.column("fps"), part.column("row_").to_pylist(), words[-1].tolist()
                salt = spans.mix(np.arange(1, part.num_rows + 1).astype(np.uint64))
                asked = np.sort(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ np.repeat(salt, np.diff(lists.offsets.to_numpy())))
                for size, owner, at, values in _windows(words, window, gram, short, False):
                    hit = np.isin(values ^ salt[owner], asked)
                    owner, at = owner[hit].tolist(), at[hit]
                    for text, o, i in zip(_texts(words, size, at), owner, at.tolist(), strict=True):
                        to = held.get((size, text))
                        if to is None:
                            held[size, text] = array("q", (row[o], i - first[o]))
                            bytes_ += 280 + len(text)
                        else:
                            to.extend((row[o], i - first[o]))
                            bytes_ += 18
                    if bytes_ >= GATHER_BYTES:
                        yield flush()
                        held.clear()
                        bytes_ = 0
        if held:
            yield flush()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in batch.column("places").to_pylist()]
            many = np.array([len(x) for x in places], np.int64)
            all_ = np.concatenate([np.empty((0, 2), np.int64), *places])
            take = pa.array(np.repeat(np.arange(len(many)), many))
            yield pa.record_batch({"row_": pa.array(all_[:, 0]), "begin": pa.array(all_[:, 1]), "size": batch.column("size").take(take), "set_": batch.column("set_").take(take)})

    met = asking.mapInArrow(spans.tidy(gather), "size int, words binary, places binary").join(of_window.select("size", "words", "set_"), ["size", "words"])
    places = met.select("size", "set_", "places").mapInArrow(spans.tidy(spread), "row_ long, begin long, size int, set_ string")
    by_row = cut(places.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("begin", "size"))).alias("found"), F.collect_set("set_").alias("sets")))
    named = lookup(by_row.select("row_", F.explode("sets").alias("set_")), sets, ["set_"]).select("row_", F.explode("item_ids").alias("item_id"))
    named = named.groupBy("row_").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["begin"] + x["size"]
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + F.greatest(end - F.greatest(acc["upto"], x["begin"]), F.lit(0))).alias("n"))

    n_hit = F.aggregate("found", start, add, lambda acc: acc["n"])
    found = by_row.select("row_", n_hit.alias("n_hit")).join(named, "row_")
    none = F.array().cast("array<string>")
    return seen.select("row_", "doc_id", "n_words").join(found, "row_", "left").select("row_", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 5, part: int = 20) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` (a 1/``part`` of the
    words or more is hit). Empty tables, null and blank texts give no hits."""
    found = hits(docs, items, window, gram)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * part >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 5, part: int = 20) -> DataFrame:
    """Documents that are not contaminated, with all their columns. Rows of equal doc_id go together."""
    bad = contamination(docs, items, window, gram, part).filter("contaminated").select(F.col("doc_id").alias("bad_")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_"]), "left_anti")
