"""Exact removal of repeated word windows by super-k-mer partitioning.

A window's minimiser is the least hash of its word grams, a function of its words
alone, so equal windows meet in the minimiser's bucket. Consecutive windows of equal
minimiser are a super-k-mer and travel as one packed string of their words. Only
minimisers seen in two documents or more travel. In a bucket, windows are sorted as
bytes and each gets the smallest doc_id that an equal one starts in.
Buckets of very frequent minimisers are dealt window by window instead, so that a
common line's contexts spread over tasks. A task packs equal strings once, with
the list of places they come from.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import spans
from siltstone.session import scratch

#: Super-k-mers of one minimiser from which its windows are dealt one by one.
HOT = 2000
#: Windows of a packed string, at most: a longer super-k-mer is cut, and what it loses is joined again in its bucket.
RUN = 64
#: Packed bytes that a task gathers before it hands them on.
GATHER_BYTES = 8 << 20
#: Packed strings that a bucket's task turns into Python objects at once.
READ_ROWS = 1024
#: Words of the grams whose least hash is the minimiser.
GRAM = 8
_CLASS = spans.space_class()
_LAST = (1 << 63) - 1  # where a null doc_id sorts


def _runs(part: pa.RecordBatch, window: int, most: int | None = None) -> tuple[np.ndarray, ...]:
    """Super-k-mers of a chunk, cut at ``most`` windows: (row, first word, windows, minimiser), and the words' spans."""
    data, offsets = spans.text_buffer(part.column("text"))
    starts, ends, first = spans.word_spans(data, offsets, _CLASS)
    gram = min(GRAM, window)
    least = spans.sliding_min(spans.rolling(spans.hash_spans(data, starts, ends), gram), window - gram + 1)
    owner = np.repeat(np.arange(part.num_rows), np.diff(first))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= first[owner + 1])
    least, owner = least[at], owner[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(begins)
    sizes = np.diff(np.append(begins, len(at)))
    if most:
        pieces = -(-sizes // most)
        begins = np.repeat(begins, pieces) + most * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        sizes = np.diff(np.append(begins, len(at)))
    return owner[begins], at[begins], sizes, least[begins], data, starts, ends, first


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_, doc_id, text``. ``docs`` must be a deterministic read (a table), as rows are numbered by place."""
    return docs.select(F.monotonically_increasing_id().alias("row_"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _joined(ranges: np.ndarray) -> np.ndarray:
    """Ranges (row, begin, end) of a bucket, those that touch as one."""
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    row, begin, end = ranges.T
    fresh = np.ones(len(row), bool)
    # a run of one minimiser has its ranges in order and of like length, so the one before decides
    fresh[1:] = (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(fresh)
    return np.stack([row[first], begin[first], np.maximum.reduceat(end, first)], axis=1)


def _ids(part: pa.RecordBatch) -> pa.Array:
    return part.column("doc_id").fill_null(_LAST)


def removals(rows: DataFrame, window: int = 50, hot: int = HOT) -> DataFrame:
    """``row_, begin, end``: word ranges of ``rows`` (row_, doc_id, text) covered by windows that also start in a
    row of smaller doc_id. Ranges may overlap."""
    spark = rows.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                row, _, _, least, *_ = _runs(part, window)
                take = pa.array(row)
                yield pa.record_batch({"row_": part.column("row_").take(take), "id_": _ids(part).take(take), "key": pa.array(least.view(np.int64))})

    path = scratch(spark, "minimisers")  # a table: three times smaller than a checkpoint of the same rows
    rows.mapInArrow(spans.tidy(keys), "row_ long, id_ long, key long").write.parquet(path)
    placed = spark.read.parquet(path)
    shared = placed.groupBy("key").agg(F.min("id_").alias("low"), F.max("id_").alias("high"), F.count("*").alias("n"))
    shared = shared.filter("low < high").select("key", (F.col("n") > hot).alias("hot"))
    wanted = placed.select("row_", "key").join(shared, "key").groupBy("row_")
    wanted = wanted.agg(F.collect_set(F.when(~F.col("hot"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys"))
    again = rows.join(wanted, "row_")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool, bytes], array] = {}
        size = 0

        def put(key: tuple[int, bool, bytes], row: int, id_: int, at: int) -> int:
            """Bytes that it takes, about."""
            to = held.get(key)
            if to is None:
                held[key] = array("q", (row, id_, at))
                return 300 + len(key[2])
            to.extend((row, id_, at))
            return 28

        def flush() -> pa.RecordBatch:
            places = [np.frombuffer(x, "<i8").reshape(-1, 3) for x in held.values()]
            return pa.record_batch(
                {
                    "key": pa.array([k for k, _, _ in held], pa.int64()),
                    "hot": pa.array([h for _, h, _ in held], pa.bool_()),
                    "packed": pa.array([w for _, _, w in held], pa.binary()),
                    "low": pa.array([int(p[:, 1].min()) for p in places], pa.int64()),
                    "places": pa.array([p.tobytes() for p in places], pa.binary()),
                }
            )

        for batch in batches:
            for part in spans.chunks(batch, "text"):
                row, word, sizes, least, data, starts, ends, first = _runs(part, window, RUN)
                ask = []
                for name in ("keys", "hot_keys"):
                    lists = part.column(name)
                    ask.append((np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
                salt = spans.mix(row.astype(np.uint64) + np.uint64(1))
                is_, is_hot = (np.isin(least ^ salt, k ^ spans.mix(r.astype(np.uint64) + np.uint64(1))) for r, k in ask)
                raw, row_, id_ = data.tobytes(), part.column("row_").to_pylist(), _ids(part).to_pylist()
                origin = first[:-1].tolist()
                signed = least.view(np.int64)
                for j in np.flatnonzero(is_ | is_hot).tolist():
                    r, at, n = int(row[j]), int(word[j]), int(sizes[j])
                    words = [raw[a:b] for a, b in zip(starts[at : at + n + window - 1].tolist(), ends[at : at + n + window - 1].tolist(), strict=True)]
                    if is_hot[j]:
                        for i in range(n):
                            w = b" ".join(words[i : i + window])
                            size += put((xxhash.xxh3_64_intdigest(w) - (1 << 63), True, w), row_[r], id_[r], at + i - origin[r])
                    else:
                        size += put((int(signed[j]), False, b" ".join(words)), row_[r], id_[r], at - origin[r])
                    if size >= GATHER_BYTES:
                        yield flush()
                        held.clear()
                        size = 0
        if held:
            yield flush()

    packed = again.mapInArrow(spans.tidy(pack), "key long, hot boolean, packed binary, low long, places binary")
    buckets = packed.repartition("key").sortWithinPartitions("key", "hot", "packed", "low")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[bytes, np.ndarray]] = []
        now: tuple[int, bool] | None = None
        last, least = None, 0
        out: list[np.ndarray] = []

        def close() -> None:
            """Windows of a bucket, sorted, so that equal ones are neighbours. A bucket that isn't hot has at most ``hot``
            super-k-mers, and equal strings of a long one once a task."""
            windows, low, sizes = [], [], []
            for text, places in group:
                words = text.split(b" ")
                sizes.append(len(words) - window + 1)
                windows += [b" ".join(words[i : i + window]) for i in range(sizes[-1])]
                low += [int(places[:, 1].min())] * sizes[-1]
            order = sorted(range(len(windows)), key=windows.__getitem__)
            least_of = np.empty(len(windows), np.int64)
            at = 0
            while at < len(order):
                to, w = at + 1, windows[order[at]]
                while to < len(order) and windows[order[to]] == w:
                    to += 1
                equal = order[at:to]
                least_of[equal] = min(low[i] for i in equal)
                at = to
            at, found = 0, []
            for (_, places), n in zip(group, sizes, strict=True):
                start = least_of[at : at + n]
                at += n
                for row, id_, first in places.tolist():
                    bad = np.flatnonzero(start < id_)
                    if len(bad):
                        gap = np.flatnonzero(np.diff(bad) > 1)
                        begin, end = bad[np.concatenate([[0], gap + 1])], bad[np.append(gap, len(bad) - 1)]
                        found.append(np.stack([np.full(len(begin), row), begin + first, end + first + window], axis=1))
            if found:
                out.append(_joined(np.concatenate(found)))
            group.clear()

        def ready() -> pa.RecordBatch:
            all_ = np.concatenate([np.empty((0, 3), np.int64), *out])
            out.clear()
            return pa.record_batch({"row_": pa.array(all_[:, 0]), "begin": pa.array(all_[:, 1]), "end": pa.array(all_[:, 2])})

        for part in (batch.slice(i, READ_ROWS) for batch in batches for i in range(0, batch.num_rows, READ_ROWS)):
            for key, is_hot, text, low, places in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                places = np.frombuffer(places, "<i8").reshape(-1, 3)
                if is_hot:  # sorted by window, then by smallest id: the first row has the least
                    if (key, text) != last:
                        last, least = (key, text), low
                    late = places[places[:, 1] > least]
                    if len(late):
                        out.append(np.stack([late[:, 0], late[:, 2], late[:, 2] + window], axis=1))
                else:
                    if (key, is_hot) != now:
                        close()
                        now = (key, is_hot)
                    group.append((text, places))
            yield ready()
        close()
        yield ready()

    return buckets.mapInArrow(spans.tidy(count), "row_ long, begin long, end long")


def _ranges(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Begins and ends of the removed words of each row; there may be as many as words."""
    lists = part.column("ranges")
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    at, flat = np.concatenate([[0], np.cumsum(sizes)]), lists.flatten()  # without what lies below a null
    begin, end = (flat.field(i).to_numpy() for i in (0, 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield begin[a:b], end[a:b]


def _finish(docs: DataFrame, window: int, hot: int, each: Callable[[bytes, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    rows = numbered(docs)
    ranges = removals(rows, window, hot).groupBy("row_").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                data, offsets = spans.text_buffer(part.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                made = [each(raw[a:b], *x) for a, b, x in zip(at[:-1], at[1:], _ranges(part), strict=True)]
                ids = zip(part.column("row_").to_pylist(), part.column("doc_id").to_pylist(), strict=True)
                yield pa.RecordBatch.from_pylist([{"row_": r, "doc_id": i} | x for (r, i), x in zip(ids, made, strict=True)], schema=_arrow(schema))

    joined = rows.join(ranges, "row_", "left").select("row_", "doc_id", "text", "ranges")
    return joined.mapInArrow(spans.tidy(run), schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _kept(text: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    words = text.split()
    if not len(begin):
        return words, words
    delta = np.bincount(begin, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
    keep = np.cumsum(delta[:-1]) == 0
    return words, [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def repeated_windows(docs: DataFrame, window: int = 50, hot: int = HOT) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256``.

    Null and blank texts have no words; texts of fewer than ``window`` words lose none.
    Rows of equal doc_id are judged each on its own and are not smaller than one
    another; a null doc_id is larger than any other. Empty tables give no rows.
    """

    def each(text: bytes, begin: np.ndarray, end: np.ndarray) -> dict:
        words, kept = _kept(text, begin, end)
        return {"n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}

    done = _finish(docs, window, hot, each, "row_ long, doc_id long, n_words long, n_removed long, kept_sha256 string")
    return done.drop("row_")


def without_repeats(docs: DataFrame, window: int = 50, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated words removed from ``text``: what is left is joined by spaces, a text that loses
    nothing stays as it is, a document that loses all its words goes. ``n_chars`` follows, where there is one."""
    others = [c for c in docs.columns if c not in ("row_", "ranges")]
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), *others)
    ranges = removals(rows, window, hot).groupBy("row_").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    joined = rows.join(ranges, "row_", "left").select(*others, "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                texts, ranges = part.column("text").to_pylist(), list(_ranges(part))
                less = [len(begin) > 0 for begin, _ in ranges]
                left = [b" ".join(_kept(t.encode(), *r)[1]).decode() if x else t for t, r, x in zip(texts, ranges, less, strict=True)]
                new = pa.array(left, part.schema.field("text").type)
                stays = pa.array([not x or t != "" for t, x in zip(left, less, strict=True)])
                columns = {c: new if c == "text" else part.column(c) for c in others}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t) if x else n for n, t, x in zip(part.column("n_chars").to_pylist(), left, less, strict=True)], part.schema.field("n_chars").type)
                yield pa.record_batch(columns).filter(stays)

    return joined.mapInArrow(spans.tidy(run), docs.select(*others).schema)
