"""Rank fusion, representatives and reranking over lane hits.

Lane hits have ``query_id, lane, status, rank, evidence_id, version, dup_cluster, kind,
raw_score, arrival``. An identity is the smallest duplicate cluster of an evidence over
succeeded lanes, else the evidence itself; clusters sort before evidences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_SCALE, BLEND_SCALE = 10_000_000, 1_000_000


def identified(hits: DataFrame) -> DataFrame:
    """Hits of succeeded lanes with ``id_kind`` (0 cluster, 1 evidence) and ``identity``."""
    good = hits.filter(F.col("status") == "Succeeded")
    cluster = F.min("dup_cluster").over(Window.partitionBy("query_id", "evidence_id"))
    return good.withColumn("cluster", cluster).select(*hits.columns, F.when(F.col("cluster").isNull(), 1).otherwise(0).alias("id_kind"), F.coalesce("cluster", "evidence_id").alias("identity"))


def compact_ranks(hits: DataFrame) -> DataFrame:
    """First occurrence of each identity within a lane, ranked anew from 1."""
    rows = identified(hits)
    first = F.row_number().over(Window.partitionBy("query_id", "lane", "id_kind", "identity").orderBy("rank"))
    rows = rows.withColumn("nth", first).filter("nth = 1").drop("nth")
    return rows.withColumn("compact_rank", F.row_number().over(Window.partitionBy("query_id", "lane").orderBy("rank")))


def fused_order(scores: DataFrame) -> DataFrame:
    """0-based rank: score descending, clusters first, identity ascending."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id_kind", "identity")
    return scores.withColumn("fused_rank", F.row_number().over(order) - 1)


def rrf(hits: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion in integers."""
    if k <= 0:
        raise ValueError("k must be positive")
    part = F.expr(f"{RRF_SCALE} div ({k} + compact_rank)")
    return fused_order(compact_ranks(hits).groupBy("query_id", "id_kind", "identity").agg(F.sum(part).alias("score")))


def kind_bounds(hits: DataFrame) -> DataFrame:
    """Least and largest raw score of each score kind over succeeded lanes."""
    return hits.filter(F.col("status") == "Succeeded").groupBy("query_id", "kind").agg(F.min("raw_score").alias("low"), F.max("raw_score").alias("high"))


def blend(hits: DataFrame, lexical_weight: float, kinds: list[str], lexical: str = "lexical") -> DataFrame:
    """Min-max normalised blend: the lexical kind weighs ``lexical_weight``, the others share the rest. No
    duplicate is taken out within a lane."""
    if not 0 <= lexical_weight <= 1 or not kinds:
        raise ValueError("a weight in [0, 1] and kinds to blend are needed")
    rows = identified(hits).filter(F.col("kind").isin(lexical, *kinds)).join(kind_bounds(hits), ["query_id", "kind"])
    span = F.col("high") - F.col("low")
    unit = F.when(span > 0, F.least(F.greatest((F.col("raw_score") - F.col("low")) / span, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    weight = F.when(F.col("kind") == lexical, lexical_weight).otherwise((1 - lexical_weight) / len(kinds))
    part = F.floor(F.round(weight * unit * BLEND_SCALE, 6)).cast("long")
    return fused_order(rows.groupBy("query_id", "id_kind", "identity").agg(F.sum(part).alias("score")))


def representatives(hits: DataFrame) -> DataFrame:
    """The hit of smallest ``(evidence_id, version)`` of each identity (by arrival on ties) and the kinds known of it.

    A smaller newcomer replaces what was merged so far, so kinds count from its first arrival on.
    """
    rows = identified(hits)
    key = ["query_id", "id_kind", "identity"]
    best = rows.groupBy(*key).agg(F.min(F.struct("evidence_id", "version", "arrival")).alias("best"))
    later = rows.join(best, key).filter(F.col("arrival") >= F.col("best.arrival"))
    kinds = later.groupBy(*key, "kind").agg(F.min_by("raw_score", "arrival").alias("raw_score"))
    merged = kinds.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("raw_score").cast("string")))), ",").alias("scores"))
    return best.join(merged, key).select(*key, F.col("best.evidence_id").alias("evidence_id"), F.col("best.version").alias("version"), "scores")


def rerank(fused: DataFrame, relevance: Column, constraints: Column, input_cap: int, score_cap: int, output_cap: int) -> DataFrame:
    """Bounded reranker over ``query_id, fused_rank, identity``: of the first ``input_cap`` the first ``score_cap``
    are scored (a null score counts 0 and is marked), then ordered by total, original rank and identity."""
    rows = fused.filter(F.col("fused_rank") < input_cap)
    inside = F.col("fused_rank") < score_cap
    rows = rows.withColumn("fallback", inside & relevance.isNull()).withColumn("skipped", ~inside)
    rows = rows.withColumn("total", F.when(inside, F.coalesce(relevance + constraints, F.lit(0))).otherwise(0).cast("long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("total"), "fused_rank", "identity")
    return rows.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= output_cap)
