"""Outcomes of searches: evaluation of selected evidence, status reconciliation and evidence packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINAL = ("SourcesConflict", "DeniedByPolicy", "QuarantinedForReview", "Abstained")
SELECTOR_WINS = ("NoEvidenceFound", "AnswerableWithWarnings", "EvidenceIncomplete", "StaleEvidenceOnly")


def reconcile_status(evaluator: Column, selector: Column) -> Column:
    """An evaluator's final status holds; else the selector's, if it is weaker than answerable."""
    return F.when(evaluator.isin(*FINAL), evaluator).when(selector.isin(*SELECTOR_WINS), selector).otherwise(evaluator)


def evaluate(selected: DataFrame) -> DataFrame:
    """One row a query of selected evidence (``query_id, evidence_id, source, document, section, coverage_keys,
    percent_covered, stop_reason, status``): counts, the covered keys and the status. No evidence is no row."""
    return selected.groupBy("query_id").agg(
        F.count("*").alias("evaluated"),
        F.count_distinct("source").alias("distinct_sources"),
        F.count_distinct("document").alias("distinct_documents"),
        F.count_distinct("section").alias("distinct_sections"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("coverage_keys")))).alias("covered_keys"),
        F.max("percent_covered").alias("percent_covered"),
        F.max("stop_reason").alias("stop_reason"),
        F.max("status").alias("status"),
    )


def claim_coverage(selected: DataFrame, claims: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """``query_id, claim, evidence_ids, state`` of ``claims (query_id, claim, needed)``: Conflicted if any of its evidence
    is in ``conflicts (query_id, evidence_id)``, Supported by as many as are needed, Partial by fewer, else Missing."""
    support = selected.select("query_id", "evidence_id", F.explode("coverage_keys").alias("claim"))
    if conflicts is not None:
        support = support.join(conflicts.select("query_id", "evidence_id").distinct().withColumn("against", F.lit(True)), ["query_id", "evidence_id"], "left")
    else:
        support = support.withColumn("against", F.lit(None).cast("boolean"))
    found = support.groupBy("query_id", "claim").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.count("against").alias("n_against"))
    rows = claims.join(found, ["query_id", "claim"], "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<bigint>")))
    n = F.size("evidence_ids")
    state = F.when(F.col("n_against") > 0, "Conflicted").when(n >= F.greatest("needed", F.lit(1)), "Supported").when(n > 0, "Partial").otherwise("Missing")
    return rows.select("query_id", "claim", "evidence_ids", state.alias("state"))


def source_independence(selected: DataFrame) -> DataFrame:
    """``query_id, source_key, evidence_ids``: what comes from one source isn't independent."""
    return selected.groupBy("query_id", F.col("source").alias("source_key")).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def evidence_pack(selected: DataFrame, claims: tuple[str, ...], replay_key: str, needed: int = 1) -> DataFrame:
    """One row a query: counts, claims, sources, freshness, what is missing and the key by which it is repeated.

    Lists hold no more than the selected evidence, which a plan bounds.
    """
    each = F.explode(F.array(*[F.lit(c) for c in claims]).cast("array<string>")).alias("claim")
    wanted = selected.select("query_id").distinct().select("query_id", each).withColumn("needed", F.lit(needed))
    of = lambda df, item, name: df.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias(name))
    covered = claim_coverage(selected, wanted)
    out = evaluate(selected)
    out = out.join(of(covered, F.struct("claim", "state", "evidence_ids"), "claims"), "query_id", "left")
    out = out.join(of(covered.filter("state = 'Missing'"), F.col("claim"), "missing"), "query_id", "left")
    out = out.join(of(source_independence(selected), F.struct("source_key", "evidence_ids"), "sources"), "query_id", "left")
    out = out.join(of(selected, F.struct("evidence_id", "freshness"), "freshness"), "query_id", "left")
    verbatim = of(selected, F.col("evidence_id"), "verbatim")
    return out.join(verbatim, "query_id", "left").withColumn("replay_key", F.lit(replay_key))
