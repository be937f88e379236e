"""Full-text lanes: postings, corpus statistics, BM25, filtered and substring search."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """``id, dl, term, tf``. With ``terms`` only those are exploded; lengths stay those of whole texts."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words")).withColumn("dl", F.size("words"))
    kept = F.filter("words", lambda w: w.isin(*terms)) if terms else F.col("words")
    return words.select("id", "dl", F.explode(kept).alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ``n`` documents and their average length ``avgdl``."""
    return docs.select(F.size(tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, terms: list[str], allowed: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of documents with any of the distinct ``terms``.

    Statistics are those of all of ``docs``; ``allowed`` (ids) is semi-joined before
    scoring, so a filter changes which documents are ranked but not their scores. For
    texts that are searched once; others are better written as ``Postings``.
    """
    stats = corpus_stats(docs, id_col, text_col).first()
    once = Postings(postings(docs, id_col, text_col, sorted(set(terms))), stats.n, stats.avgdl or 0.0)
    return once.search({0: terms}, allowed).select("id", "score")


@dataclass(frozen=True)
class Postings:
    """A written full-text index of one field: ``rows (id, dl, term, tf)`` sorted by term, so that a scan for a few
    terms reads a few row groups, and the corpus's document count and mean length."""

    rows: DataFrame
    n: int
    avgdl: float

    @staticmethod
    def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Postings:
        """Tokenize once, count within documents, sort by term."""
        spark = docs.sparkSession
        made = postings(docs, id_col, text_col)
        made.repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
        # a document without words has no postings, but counts; all term counts together are all lengths together
        words = spark.read.parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
        n = docs.count()
        words.select(F.lit(n).cast("long").alias("n"), (F.col("words") / F.lit(max(n, 1))).alias("avgdl")).write.parquet(f"{path}/stats")
        return Postings.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Postings:
        stats = spark.read.parquet(f"{path}/stats").first()
        return Postings(spark.read.parquet(f"{path}/postings"), stats.n, stats.avgdl or 0.0)

    def search(self, terms: dict[int, list[str]], allowed: DataFrame | None = None) -> DataFrame:
        """``q, id, score``: BM25 of all queries (their number and words) in one scan and one aggregate. ``allowed``
        ids are semi-joined before anything is scored; statistics are those of the whole corpus."""
        askers: dict[str, list[int]] = {}
        for q, words in terms.items():
            for w in dict.fromkeys(words):
                askers.setdefault(w, []).append(q)
        found = self.rows.filter(F.col("term").isin(*askers)) if askers else self.rows.limit(0)
        counts = {r.term: r["count"] for r in found.groupBy("term").count().collect()}  # a row a query's word
        if not counts:
            return self.rows.sparkSession.createDataFrame([], self.schema())
        weights = {t: math.log(1 + (self.n - df + 0.5) / (df + 0.5)) for t, df in counts.items()}
        idf = F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w)])
        who = F.create_map(*[x for t in weights for x in (F.lit(t), F.array(*[F.lit(q) for q in askers[t]]))])
        if allowed is not None:
            found = found.join(allowed.select(F.col(allowed.columns[0]).alias("id")), "id", "left_semi")
        part = idf[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(self.avgdl) or 1.0)))
        scored = found.select("id", part.alias("part"), F.explode(who[F.col("term")]).alias("q"))
        return scored.groupBy("q", "id").agg(F.sum("part").alias("score"))

    def schema(self) -> str:
        return f"q int, id {self.rows.schema['id'].dataType.simpleString()}, score double"


#: Parts in which the hits of one query are ranked before the best of all parts are.
SALTS = 256


def best_of_each(scored: DataFrame, k: int) -> DataFrame:
    """``q, id, score_milli, rank``: the first k of each query of ``scored (q, id, score)``.

    A query may match most of the corpus, so its hits are ranked in salted parts first: one
    task then sees no more than ``SALTS * k`` of them.
    """
    rows = scored.select("q", "id", F.round(F.col("score") * 1000).cast("long").alias("score_milli"))
    order = [F.desc("score_milli"), F.col("id")]
    parted = rows.withColumn("salt_", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parted = parted.withColumn("nth_", F.row_number().over(Window.partitionBy("q", "salt_").orderBy(*order))).filter(F.col("nth_") <= k).drop("salt_", "nth_")
    return parted.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)


def top_k(scored: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """Total order: integer score descending, id ascending; ``rank`` from 1."""
    best = scored.select("id", F.round(F.col("score") * 1000).cast("long").alias("score_milli")).orderBy(F.desc("score_milli"), "id").limit(offset + k)
    # the limit has already bounded the one window partition
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score_milli"), "id")))
    return ranked.filter(F.col("rank") > offset)


def substring_hits(docs: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Case-insensitive literal search; the score is the text's length in bytes."""
    hit = F.contains(F.lower(text_col), F.lit(needle.lower()))
    return docs.filter(hit).select(F.col(id_col).alias("id"), F.octet_length(text_col).cast("long").alias("score"))
