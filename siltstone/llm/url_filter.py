"""URL verdicts: longest-suffix/prefix rules, then a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are counted
over every URL that a rule decides. A URL without a rule is judged by the difference
of its log likelihoods a character, against a threshold calibrated on the URLs that
the rules decide. The counts are a distributed table, kept whole; URLs travel in packs
that ask it for the contexts they hold, each once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session
from siltstone.llm import spans

#: Longest context in characters.
ORDER = 5
#: Bytes of the URLs that ask for their contexts together.
PACK_BYTES = 1 << 19
#: Bins of the calibration's histogram of differences, over [-8, 8).
BINS = 4096


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; path: then up to ``?`` or ``#``."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits (host itself or a subdomain, path beginning), or null; ties to the first given."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow"))) for r in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,allow:boolean>")


def _contexts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (order, text number, context hash, hash with the next character) at every character.

    A text is its bytes between a start and an end mark; contexts don't reach over it.
    """
    texts = [b"\x02" + (x or "").encode() + b"\x03" for x in column.to_pylist()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(texts)), size)
    within = np.arange(len(data)) - first[owner]
    at = np.flatnonzero(within >= 1)  # every character but the start mark is predicted
    for order in range(ORDER + 1):
        # a context is cut at the start mark
        used = np.minimum(order, within[at])
        code = np.full(len(at), 1, np.uint64)
        for back in range(order, 0, -1):
            code = np.where(used >= back, code << np.uint64(8) | data[np.maximum(at - back, 0)], code)
        context = spans.mix(code * np.uint64(8) + np.uint64(order))
        yield order, owner[at], context, spans.mix(context + data[at] + np.uint64(1))


@dataclass
class Counts:
    """Counts by hash: of (context, next) and of contexts, with the number of different next characters."""

    pair: np.ndarray  # ascending
    pair_n: np.ndarray  # n x 2: rejected, accepted
    context: np.ndarray  # ascending
    context_n: np.ndarray
    context_kinds: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Counts:
        """From rows of the counts' table, each with all next characters of its context."""
        context, size = rows.column("context").to_numpy().view(np.uint64), rows.column("pair").combine_chunks().value_lengths().to_numpy()
        pair, bad, good = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("pair", "bad", "good"))
        pair, n = pair.view(np.uint64), np.column_stack([bad, good]).astype(np.float64)
        owner = np.repeat(np.arange(len(size)), size)
        total = np.column_stack([np.bincount(owner, n[:, i], len(size)) for i in (0, 1)])
        kinds = np.column_stack([np.bincount(owner, n[:, i] > 0, len(size)) for i in (0, 1)])
        order, by = np.argsort(pair), np.argsort(context)
        return cls(pair[order], n[order], context[by], total[by], kinds[by])

    @staticmethod
    def _look(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros((len(keys), 2))
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where((table[at] == keys)[:, None], values[at], 0)

    def difference(self, column: pa.Array) -> np.ndarray:
        """Length-normalised log likelihood of the accepted model less that of the rejected one."""
        p, number = None, None
        for _, owner, context, pair in _contexts(column):
            n, total, kinds = self._look(pair, self.pair, self.pair_n), self._look(context, self.context, self.context_n), self._look(context, self.context, self.context_kinds)
            if p is None:
                p, number = np.full(n.shape, 1 / 256), owner
            p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1e-9), p)  # Witten-Bell
        count = len(column)
        gain = np.log(p[:, 1]) - np.log(p[:, 0])
        return np.bincount(number, gain, count) / np.maximum(np.bincount(number, minlength=count), 1)


def _unpacked(rows: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


def _packed(rows: DataFrame) -> DataFrame:
    """``rows (url, ...)`` in packs: ``pack, rows, contexts``, the contexts each once.

    Packs are numbered by the task that makes them; the checkpoint fixes what is in each.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in spans.chunks(batch, "url", PACK_BYTES):
                contexts = np.unique(np.concatenate([np.unique(context) for _, _, context, _ in _contexts(part.column("url"))]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                lists = pa.ListArray.from_arrays(pa.array([0, len(contexts)], pa.int32()), pa.array(contexts.view(np.int64)))
                yield pa.record_batch({"pack": pa.array([number]), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "contexts": lists})
                number += 1

    return session.cut(rows.mapInArrow(spans.tidy(pack), "pack long, rows binary, contexts array<long>"))


def _counted(packed: DataFrame) -> DataFrame:
    """Counts of all rows with ``allow``: ``context, pair, bad, good``, a row a context, with at most 257 next characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                part = _unpacked(rows)
                part = part.filter(part.column("allow").is_valid()).combine_chunks()
                allow = part.column("allow").to_numpy().astype(np.int64)
                for _, owner, context, pair in _contexts(part.column("url")):
                    key, at, back = np.unique(pair, return_index=True, return_inverse=True)
                    n = np.bincount(back * 2 + allow[owner], minlength=2 * len(key)).reshape(-1, 2)
                    yield pa.record_batch({"context": pa.array(context[at].view(np.int64)), "pair": pa.array(key.view(np.int64)), "bad": pa.array(n[:, 0]), "good": pa.array(n[:, 1])})

    pairs = packed.select("rows").mapInArrow(spans.tidy(count), "context long, pair long, bad long, good long").groupBy("context", "pair").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    nexts = pairs.groupBy("context").agg(F.collect_list(F.struct("pair", "bad", "good")).alias("next"))
    return nexts.select("context", "next.pair", "next.bad", "next.good")


def _scored(packed: DataFrame, counts: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of packs, of ``schema``, with ``difference``.

    A context is asked for once a pack, so a hot one has as many rows in the join as there are packs.
    """
    found = packed.select(F.col("pack").alias("asker"), F.explode("contexts").alias("context")).join(counts, "context")

    def run(pack: pa.Table, model: pa.Table) -> pa.Table:
        known = Counts.of(model)
        parts = []
        for rows in pack.column("rows"):
            part = _unpacked(rows)
            parts.append(part.append_column("difference", pa.array(known.difference(part.column("url")))))
        return pa.concat_tables(parts)

    out = T.StructType([*schema.fields, T.StructField("difference", T.DoubleType())])
    return packed.select("pack", "rows").groupBy("pack").cogroup(found.groupBy("asker")).applyInArrow(run, out)


def _threshold(scored: DataFrame) -> float:
    """Where the error over rows with ``allow`` is least, both kinds weighing the same."""
    slot = F.least(F.greatest(F.floor((F.col("difference") + 8) / 16 * BINS), F.lit(0)), F.lit(BINS - 1))
    n = np.zeros((BINS, 2))
    for r in scored.filter("allow IS NOT NULL").groupBy(slot.alias("slot"), "allow").count().collect():  # 2 * BINS rows at most
        n[r.slot, int(r.allow)] = r["count"]
    if n.sum(axis=0).min() == 0:
        return 0.0
    share = n / n.sum(axis=0)
    # balanced error when everything below a bin's edge is rejected; the middle of the best edges
    wrong = np.concatenate([[0], np.cumsum(share[:, 1])]) + 1 - np.concatenate([[0], np.cumsum(share[:, 0])])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 16 - 8)


@dataclass
class Model:
    counts: DataFrame
    threshold: float

    def difference(self, column: pa.Array) -> np.ndarray:
        """Of some URLs on the driver."""
        rows = self.counts.sparkSession.createDataFrame(list(enumerate(column.to_pylist())), "at long, url string")
        got = _scored(_packed(rows), self.counts, rows.schema).select("at", "difference").toArrow()
        return got.column("difference").to_numpy()[np.argsort(got.column("at").to_numpy())]


def _learned(rows: DataFrame) -> tuple[Model, DataFrame]:
    """Count over ``rows (url, allow, ...)`` with ``allow``, all of them; then score all rows and calibrate."""
    packed = _packed(rows)
    counts = session.cut(_counted(packed))
    scored = session.cut(_scored(packed, counts, rows.schema))
    return Model(counts, _threshold(scored)), scored


def fit(rows: DataFrame) -> Model:
    """Learn from ``rows (url, allow)``, all of them."""
    return _learned(rows)[0]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict, difference``.

    Null URLs and those without ``://`` have empty host and path and no rule; they are
    judged as the empty text. If the rules decide nothing one way, the threshold is 0
    and a tie is an acceptance. Repeated rows are judged each.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    model, scored = _learned(rows.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.allow").alias("allow")))
    allow = F.coalesce("allow", F.col("difference") >= model.threshold)
    return scored.select("page_id", "host", "path", "rule", F.when(allow, "allow").otherwise("block").alias("verdict"), "difference")
