"""Approximate nearest neighbours by a permutation index.

A vector is represented by all pivots in order of nearness and posted in the inverted
files of its first few. A query visits the files of its own first pivots, ranks what it
finds there by the footrule distance of the pivot orders, and reranks the best share by
exact inner product in double precision. Equal vectors are one posting: of a class no
more members than a result can hold are listed, smallest ids first, which is exact.

Files are dealt in slices of bounded size and queries of a file in blocks. A cell is one
slice and one block: a task holds the slice, and the block's queries stream by. So a
posting travels once a block and a query once a slice, which is the part of the shuffle
that grows with queries times vectors; both are large. A posting that a query could
meet in several files is ranked in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import cut


@dataclass(frozen=True)
class Settings:
    pivots: int = 64  # 255 at most
    posted: int = 8  # files a vector is posted in
    visited: int = 14  # files a query visits
    reranked: float = 0.4  # share of what a query finds in a file that is reranked, and 4k at least
    piece: int = 1 << 15  # postings in a slice, about
    block: int = 1 << 15  # queries in a block, about


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivots of each vector, nearest (largest inner product) first; ties to the first pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable").astype(np.uint8)


def _places(orders: np.ndarray) -> np.ndarray:
    places = np.empty(orders.shape, np.int16)
    np.put_along_axis(places, orders.astype(np.int64), np.arange(orders.shape[1], dtype=np.int16)[None, :], axis=1)
    return places


def search(vectors: DataFrame, is_query: Column, k: int = 20, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the k nearest found of all other rows.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do
    those whose dimension isn't the most frequent one (ties: the larger) or whose id is
    null. Of rows with equal id the one with the smallest vector holds. No usable row gives
    no rows; fewer candidates than k give all that were found.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("size", F.size("v"))
    common = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1)
    rows = rows.join(F.broadcast(common.select("size")), "size").drop("size")  # one row
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("v", "asks")).alias("x")).select("vec_id", "x.v", F.coalesce("x.asks", F.lit(False)).alias("asks"))
    rows = cut(rows.withColumn("key", F.md5(F.concat_ws(",", F.col("v").cast("array<string>")))))

    # pivots: distinct vectors in the order of a hash of their text
    chosen = rows.select("key", "v").distinct().orderBy(F.xxhash64("key"), "key").limit(settings.pivots).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not chosen:
        return rows.sparkSession.createDataFrame([], schema)
    pivots = np.array([r.v for r in chosen])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)

    nth = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    classes = rows.select("key", "vec_id", "v").withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    classes = classes.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("v").alias("v"))
    asked = rows.filter("asks").groupBy("key").agg(F.min("v").alias("v"), F.min("vec_id").alias("least"))

    def posted(first: int) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.schema.get_field_index("v")
                v = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
                orders = _orders(v, pivots)
                n = min(first, orders.shape[1])
                row = np.repeat(np.arange(batch.num_rows), n)
                extra = [pa.array(orders[:, :n].ravel().astype(np.int32)), pa.array(np.tile(np.arange(n), batch.num_rows), pa.int32()), pa.array([o.tobytes() for o in orders], pa.binary()).take(pa.array(row))]
                raw = pa.array([x.tobytes() for x in v], pa.binary()).take(pa.array(row))
                kept = [raw if i == at else c.take(pa.array(row)) for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*kept, *extra], [*batch.schema.names, "file", "nth", "pivots"])

        return run

    tail = "v binary, file int, nth int, pivots binary"
    postings = classes.select("key", "ids", "v").mapInArrow(posted(settings.posted), f"key string, ids array<long>, {tail}")
    questions = asked.select(F.col("key").alias("q"), "v").mapInArrow(posted(settings.visited), f"q string, {tail}")

    def parts(df: DataFrame, most: int) -> dict[int, int]:
        """Parts of each file: as many rows as there are pivots."""
        return {r.file: -(-r["count"] // most) for r in df.groupBy("file").count().collect()}

    slices, blocks = parts(postings.select("file"), settings.piece), parts(questions.select("file"), settings.block)

    def many(by_file: dict[int, int]) -> Column:
        return F.array(*[F.lit(by_file.get(i, 0)) for i in range(len(pivots))])[F.col("file")]

    def upto(n: Column) -> Column:
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))

    # one form for both, so that a cell's postings come before its queries
    dealt = postings.select("key", "v", "file", "nth", "pivots", "ids", F.lit(0).alias("kind"), F.pmod(F.xxhash64("key"), many(slices)).cast("int").alias("i"), upto(many(blocks)).alias("j"))
    asking = questions.select(F.col("q").alias("key"), "v", "file", "nth", "pivots", F.lit(None).cast("array<long>").alias("ids"), F.lit(1).alias("kind"), upto(many(slices)).alias("i"), F.pmod(F.xxhash64("q"), many(blocks)).cast("int").alias("j"))
    cell = ["file", "i", "j"]
    cells = dealt.unionByName(asking).repartition(*cell).sortWithinPartitions(*cell, "kind").select(*cell, "kind", "key", "v", "nth", "pivots", "ids")

    def best_of(v: np.ndarray, places: np.ndarray, nth: int, order: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of a slice that a query keeps, and their scores."""
        mine = np.arange(len(v))
        if nth:
            mine = np.flatnonzero((places[:, order[:nth]] >= settings.posted).all(axis=1))
        own = np.empty(len(order), np.int16)
        own[order] = np.arange(len(order))
        most = max(4 * k, int(len(mine) * settings.reranked))
        if len(mine) > most:
            rule = np.abs(places[mine] - own).sum(axis=1, dtype=np.int32)
            mine = mine[np.argpartition(rule, most)[:most]]
        s = v[mine] @ asked
        if len(s) > k + 1:
            limit = np.partition(s, -(k + 1))[-(k + 1)]
            mine, s = mine[s >= limit], s[s >= limit]
        return mine, s

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, slice_ = None, [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*cell, "kind")], axis=1)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1 if len(at) else np.empty(0, np.int64)
            q, ids, score = [], [], []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if a == b:
                    continue
                if tuple(at[a, :3]) != now:
                    now, held, slice_ = tuple(at[a, :3]), [], None
                part = batch.slice(a, b - a)
                if at[a, 3] == 0:
                    held.append(part.select(["v", "pivots", "ids"]))
                    continue
                if not held:
                    continue
                if slice_ is None:
                    rows = pa.Table.from_batches(held)
                    v = np.stack([np.frombuffer(x) for x in rows.column("v").to_pylist()])
                    slice_ = v, _places(np.stack([np.frombuffer(x, np.uint8) for x in rows.column("pivots").to_pylist()])), rows.column("ids").to_pylist()
                v, places, members = slice_
                for key, raw, nth, order in zip(*(part.column(c).to_pylist() for c in ("key", "v", "nth", "pivots")), strict=True):
                    for m, x in zip(*(y.tolist() for y in best_of(v, places, nth, np.frombuffer(order, np.uint8).astype(np.int64), np.frombuffer(raw))), strict=True):
                        q += [key] * len(members[m])
                        ids += members[m]
                        score += [x] * len(members[m])
            yield pa.record_batch({"q": pa.array(q, pa.string()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    met = cells.mapInArrow(meet, "q string, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth")
    mine = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("key").alias("q")).join(best, "q").filter("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
