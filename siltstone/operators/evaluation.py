"""Retrieval quality, budgets and promotion gates, in fixed-point integers (10 000 is one)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ONE = 10_000


def ratio(found: Column, of: Column) -> Column:
    """Integer ratio; one where there is nothing to find."""
    return F.when(of == 0, ONE).otherwise(F.least(F.floor(found * ONE / F.greatest(of, F.lit(1))), F.lit(ONE))).cast("long")


def unit(value: Column) -> Column:
    return F.when(value <= 0, 0).when(value >= 1, ONE).otherwise(F.round(F.round(value, 9) * ONE)).cast("long")


def _first_seen(ranked: DataFrame) -> DataFrame:
    """First occurrence of each evidence, ranked anew from 1."""
    first = ranked.groupBy("query_id", "evidence_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "evidence_id")))


def golden_metrics(ranked: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """``query_id, recall, mrr, ndcg`` of ``ranked (query_id, evidence_id, rank)`` against
    ``judgments (query_id, evidence_id, grade)``; gain 2^grade - 1, ideal over all judgments."""
    seen = _first_seen(ranked).join(judgments, ["query_id", "evidence_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("pos") + 1)
    got = seen.groupBy("query_id").agg(
        F.count(F.when((F.col("pos") <= k) & (F.col("grade") > 0), 1)).alias("found"),
        F.min(F.when(F.col("grade") > 0, F.col("pos"))).alias("first"),
        F.sum(F.when(F.col("pos") <= k, gain).otherwise(0.0)).alias("dcg"),
    )
    ideal = judgments.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "evidence_id")))
    best = ideal.groupBy("query_id").agg(F.count(F.when(F.col("grade") > 0, 1)).alias("relevant"), F.sum(F.when(F.col("pos") <= k, gain).otherwise(0.0)).alias("idcg"))
    both = best.join(got, "query_id", "left")
    zero = F.lit(0)
    return both.select(
        "query_id",
        ratio(F.coalesce("found", zero), F.col("relevant")).alias("recall"),
        F.when(F.col("first").isNull(), 0).otherwise(F.floor(F.lit(ONE) / F.col("first"))).cast("long").alias("mrr"),
        F.when(F.col("idcg") == 0, ONE).otherwise(unit(F.coalesce("dcg", F.lit(0.0)) / F.when(F.col("idcg") != 0, F.col("idcg")))).cast("long").alias("ndcg"),
    )


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def span_hits(candidates: DataFrame, judgments: DataFrame) -> DataFrame:
    """Candidates and judgments of one source (an equi key) whose half-open spans overlap."""
    c, j = candidates.alias("c"), judgments.alias("j")
    met = (F.col("c.source_id") == F.col("j.source_id")) & overlaps(F.col("c.start"), F.col("c.end"), F.col("j.start"), F.col("j.end"))
    return c.join(j, met).select("c.source_id", F.col("c.start").alias("c_start"), F.col("c.end").alias("c_end"), F.col("j.start").alias("j_start"), F.col("j.end").alias("j_end"))


def nearest_rank(column: str, p: float) -> Column:
    """The value at index ceil(n p / 100) - 1 of the sorted ones."""
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})")


def mean_metric(value: Column, measured: Column) -> Column:
    """Integer mean, null unless all are measured."""
    return F.when(F.bool_and(measured), F.floor(F.sum(value) / F.count("*"))).cast("long")


def fold_checks(status: Column) -> Column:
    """Failed if any is, NotDetected if all are, else Passed."""
    return F.when(F.bool_or(status == "Failed"), "Failed").when(F.bool_and(status == "NotDetected"), "NotDetected").otherwise("Passed")


def budget_violations(observed: DataFrame, budgets: DataFrame, key: str, resources: list[str]) -> DataFrame:
    """Rows of ``observed`` beyond the budget of their key: ``key, resource, value, budget``."""
    pairs = observed.join(budgets.select(key, *[F.col(r).alias(f"most_{r}") for r in resources]), key)
    items = F.array(*[F.struct(F.lit(r).alias("resource"), F.col(r).cast("double").alias("value"), F.col(f"most_{r}").cast("double").alias("budget")) for r in resources])
    return pairs.select(*[c for c in observed.columns if c not in resources], F.explode(items).alias("x")).select(*[c for c in observed.columns if c not in resources], "x.*").filter("value > budget")


def promotion(metrics: DataFrame, baseline: str, challenger: str, material: int = 500) -> DataFrame:
    """``wins`` and its reasons for ``metrics (route, metric, value, higher_is_better, is_resource, measured)``: all are
    measured, no quality falls (one of which lower is better may double), one improves by ``material`` or more, and
    resources at most double."""
    pair = metrics.groupBy("metric", "higher_is_better", "is_resource").agg(
        F.max(F.when(F.col("route") == baseline, F.col("value"))).alias("old"), F.max(F.when(F.col("route") == challenger, F.col("value"))).alias("new"), F.bool_and("measured").alias("measured")
    )
    quality = ~F.col("is_resource")
    gain = F.when(F.col("higher_is_better"), F.col("new") - F.col("old")).otherwise(F.col("old") - F.col("new"))
    summary = pair.agg(
        F.bool_and(F.col("old").isNotNull() & F.col("new").isNotNull() & F.col("measured")).alias("complete"),
        F.coalesce(F.bool_or(quality & F.when(F.col("higher_is_better"), gain < 0).otherwise(F.col("new") > 2 * F.col("old"))), F.lit(False)).alias("regressed"),
        F.coalesce(F.bool_or(quality & (gain >= material)), F.lit(False)).alias("material"),
        F.coalesce(F.bool_or(F.col("is_resource") & (F.col("new") > 2 * F.col("old"))), F.lit(False)).alias("too_costly"),
    )
    return summary.withColumn("wins", F.col("complete") & ~F.col("regressed") & F.col("material") & ~F.col("too_costly"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def route_quality(observed: DataFrame, metrics: list[str]) -> DataFrame:
    """Per route of ``observed (case_id, route, <metric>, <metric>_measured)``: integer means, null unless every
    observation measured the metric."""
    return observed.groupBy("route").agg(*[mean_metric(F.col(m), F.col(f"{m}_measured")).alias(m) for m in metrics])


def over_budget(observed: DataFrame, cases: DataFrame, resources: list[str]) -> DataFrame:
    """``route, budget_violations``: observations that use more of any resource than their case allows (``most_<resource>``);
    what wasn't measured (null) is no violation."""
    beyond = F.lit(False)
    for r in resources:
        beyond = beyond | F.coalesce(F.col(r) > F.col(f"most_{r}"), F.lit(False))
    return observed.join(cases, "case_id").groupBy("route").agg(F.count(F.when(beyond, 1)).alias("budget_violations"))
