"""Dense, late-interaction and learned-sparse lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import micros


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def clamped_cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1, whatever rounding does."""
    return F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0))


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact search: ``id, score_micros, rank``. The query is a literal, so the scan is map-only and the top-k bounded."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), q), 9).alias("similarity"))
    best = scored.orderBy(F.desc("similarity"), "id").limit(k)
    return best.select("id", micros(F.col("similarity")).alias("score_micros"), F.row_number().over(Window.orderBy(F.desc("similarity"), "id")).alias("rank"))


#: Tokens of a query in late interaction, at most.
MOST_QUERY_TOKENS = 256


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """Late interaction, ``doc_id, score``: for each query token (``q, qv``) the best of a document's (``doc_id, dv``), summed.
    A query has at most ``MOST_QUERY_TOKENS`` tokens, which become literals of one scan without a join."""
    asked = query_tokens.select("qv").limit(MOST_QUERY_TOKENS + 1).collect()
    if len(asked) > MOST_QUERY_TOKENS:
        raise ValueError(f"a query has at most {MOST_QUERY_TOKENS} tokens")
    dots = F.array(*[F.round(dot(F.col("dv"), F.array(*[F.lit(float(x)) for x in r.qv])), 9) for r in asked])
    pairs = doc_tokens.select("doc_id", F.posexplode(dots).alias("q", "part"))
    best = pairs.groupBy("doc_id", "q").agg(F.max("part").alias("best"))
    return best.groupBy("doc_id").agg(F.sum("best").alias("score"))


def sparse_hits(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """``id, term_id, part``: contributions of shared terms of ``vectors (id, term_id, weight)`` and ``query (term_id, weight)``."""
    q = query.select("term_id", F.col("weight").alias("qw"))
    return vectors.join(q, "term_id").select("id", "term_id", (F.col("weight").cast("double") * F.col("qw").cast("double")).alias("part"))


def sparse_vectors(postings: DataFrame, terms: int = 4096) -> DataFrame:
    """``id, term_id, weight`` as ``hashed_terms``, from postings ``(id, term, tf)`` instead of texts."""
    rows = postings.select("id", _term_id(terms).alias("term_id"), "tf")
    return rows.groupBy("id", "term_id").agg((1 + F.log(F.sum("tf"))).alias("weight"))


def sparse_search(postings: DataFrame, query: DataFrame, terms: int = 4096) -> DataFrame:
    """``id, term_id, part`` for a query ``(term_id, weight)``, of at most ``terms`` rows: only its terms are summed at all."""
    asked = F.broadcast(query.select("term_id", F.col("weight").alias("qw")))  # `terms` rows at most
    rows = postings.select("id", _term_id(terms).alias("term_id"), "tf").join(asked, "term_id")
    counts = rows.groupBy("id", "term_id").agg((1 + F.log(F.sum("tf"))).alias("weight"), F.first("qw").alias("qw"))
    return counts.select("id", "term_id", (F.col("weight") * F.col("qw")).alias("part"))


def sparse_scores(hits: DataFrame) -> DataFrame:
    """``id, score_micros`` of positive sums."""
    total = hits.groupBy("id").agg(F.sum("part").alias("s")).filter("s > 0")
    return total.select("id", F.round(F.round("s", 9) * 1_000_000).cast("long").alias("score_micros"))


def contributions(hits: DataFrame, most: int) -> DataFrame:
    """The ``most`` largest contributions of each hit: micros descending, term ascending."""
    rows = hits.withColumn("part_micros", F.round(F.round("part", 9) * 1_000_000).cast("long"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("part_micros"), "term_id"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).select("id", "nth", "term_id", "part_micros")


def hashed_terms(docs: DataFrame, words: Column, terms: int = 4096) -> DataFrame:
    """Deterministic hashed term weights ``id, term_id, weight`` (a test encoder): 1 + ln(tf)."""
    rows = docs.select(F.col("doc_id").alias("id"), F.explode(words).alias("term"))
    rows = rows.select("id", _term_id(terms).alias("term_id"))
    return rows.groupBy("id", "term_id").agg((1 + F.log(F.count("*"))).alias("weight"))


def _term_id(terms: int) -> Column:
    return F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % terms
