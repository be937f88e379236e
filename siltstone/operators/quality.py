"""Per-case quality of retrieval routes over spans, outcome checks, route metrics and gates.

Everything is integers: 10 000 is one. A case expects evidence, or that a route abstains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.evaluation import ONE, nearest_rank, overlaps, ratio

MATERIAL = 500
RECALLS, NDCGS = (5, 20, 50, 100), (10, 20)


def share(found: Column, of: Column) -> Column:
    """Integer ratio whose denominator is one at least: zero of nothing is zero."""
    return F.least(F.floor(found * ONE / F.greatest(of, F.lit(1))), F.lit(ONE)).cast("long")


def _rounded(value: Column) -> Column:
    return F.least(F.round(F.round(value, 9) * ONE), F.lit(float(ONE))).cast("long")


def _meeting(spans: DataFrame, accepted: DataFrame) -> DataFrame:
    """``spans`` that overlap accepted ones of their case and source (an equi join), one row a pair.

    Merged, never broadcast: Spark's estimate of candidates made by an explode leaves out how many each row gives.
    """
    s, a = spans.alias("s"), accepted.alias("a")
    met = (F.col("s.case_id") == F.col("a.case_id")) & (F.col("s.source_id") == F.col("a.source_id"))
    return s.join(a.hint("merge"), met & overlaps(F.col("s.start"), F.col("s.end"), F.col("a.start"), F.col("a.end"))).select("s.case_id", "s.lane_rank", "s.pos", "s.source_id", "a.span_no")


def graded_quality(accepted: DataFrame, chain: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a case of ``accepted (case_id, span_no, source_id, start, end)``.

    ``chain (case_id, source_id)`` lists the sources of the evidence chain; ``candidates
    (case_id, lane_rank, evidence_id, source_id, start, end, cited_source, cited_start,
    cited_end, grade)`` are a route's hits, ranks from 1 (ties by evidence_id), grades 0 to 2.
    nDCG has gains 3, 1, 0 and takes its ideal from the retrieved list, both cut at k;
    average precision runs over the accepted spans that any candidate overlaps.
    """
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy("lane_rank", "evidence_id"))
    ranked = candidates.withColumn("pos", pos)
    cases = accepted.groupBy("case_id").agg(F.count("*").alias("n_spans"), F.count_distinct("source_id").alias("n_sources"))

    met = _meeting(ranked.select("case_id", "lane_rank", "pos", "source_id", "start", "end"), accepted)
    cover = met.groupBy("case_id", "span_no").agg(F.min("lane_rank").alias("rank"), F.min("pos").alias("pos"))
    covered = cover.groupBy("case_id").agg(F.count("*").alias("covered"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"within_{k}") for k in RECALLS])
    # candidates that cover a span that none before did, each counted once
    fresh = cover.select("case_id", "pos").distinct().withColumn("seen", F.row_number().over(Window.partitionBy("case_id").orderBy("pos")))
    precision = fresh.groupBy("case_id").agg(F.sum(F.col("seen") / F.col("pos")).alias("precision"))
    relevant = met.groupBy("case_id").agg(F.count_distinct("source_id").alias("relevant_sources"), F.min_by("lane_rank", "pos").alias("first_rank"))

    gain = F.when(F.col("grade") == 2, 3).when(F.col("grade") == 1, 1).otherwise(0)
    gains = ranked.select("case_id", "lane_rank", "pos", gain.alias("gain"))

    def dcg(k: int) -> DataFrame:
        inside = gains.filter(F.col("lane_rank") <= k)
        ideal = inside.withColumn("ideal", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("gain"), "pos")))
        sums = ideal.groupBy("case_id").agg(F.sum(F.col("gain") / F.log2(F.col("pos") + 1)).alias("dcg"), F.sum(F.col("gain") / F.log2(F.col("ideal") + 1)).alias("idcg"))
        value = F.when(F.col("idcg") > 0, _rounded(F.col("dcg") / F.col("idcg"))).otherwise(0)
        return sums.select("case_id", value.cast("long").alias(f"ndcg_{k}"))

    retrieved = ranked.groupBy("case_id").agg(F.count("*").alias("n_ranked"), F.count_distinct("source_id").alias("n_retrieved"), F.count("cited_source").alias("n_cited"))
    on_chain = chain.distinct().join(ranked.select("case_id", "source_id").distinct().withColumn("there", F.lit(1)).hint("merge"), ["case_id", "source_id"], "left")
    chained = on_chain.groupBy("case_id").agg(F.count("*").alias("n_chain"), F.count("there").alias("n_found"))
    cited = ranked.filter("cited_source IS NOT NULL").select("case_id", "lane_rank", "pos", F.col("cited_source").alias("source_id"), F.col("cited_start").alias("start"), F.col("cited_end").alias("end"))
    cites = _meeting(cited, accepted).groupBy("case_id").agg(F.count_distinct("pos").alias("citing"), F.count_distinct("span_no").alias("cited"))

    both = cases
    for part in (covered, precision, relevant, *[dcg(k) for k in NDCGS], retrieved, chained, cites):
        both = both.join(part.hint("merge"), "case_id", "left")
    none = [c for c in both.columns if c not in ("case_id", "first_rank")]
    both = both.na.fill(0, none)
    n = F.col("n_spans")
    return both.select(
        "case_id",
        *[share(F.col(f"within_{k}"), n).alias(f"recall_{k}") for k in RECALLS],
        *[F.col(f"ndcg_{k}").cast("long").alias(f"ndcg_{k}") for k in NDCGS],
        F.when(F.col("first_rank") <= 10, share(F.lit(1), F.col("first_rank"))).otherwise(0).cast("long").alias("mrr_10"),
        F.when(F.col("covered") > 0, _rounded(F.col("precision") / F.greatest("covered", F.lit(1)))).otherwise(0).cast("long").alias("average_precision"),
        share(F.col("covered"), n).alias("exact_span_recall"),
        share(F.col("n_found"), F.col("n_chain")).alias("chain_coverage"),
        share(F.least("relevant_sources", "n_sources"), F.col("n_sources")).alias("source_diversity"),
        share(F.col("n_ranked") - F.col("n_retrieved"), F.col("n_ranked")).alias("source_redundancy"),
        share(F.col("citing"), F.col("n_cited")).alias("citation_precision"),
        share(F.col("cited"), n).alias("citation_recall"),
    )


def exact_span_recall(judgments: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, exact_span_recall``: judgments ``(query_id, evidence_id, start, end)`` with a span whose evidence was
    found ``(query_id, evidence_id, start, end)`` with that very span; one where no judgment has a span."""
    hits = found.select("query_id", "evidence_id", "start", "end").distinct().withColumn("there", F.lit(1))
    met = judgments.join(hits, ["query_id", "evidence_id", "start", "end"], "left")
    return met.groupBy("query_id").agg(ratio(F.count("there"), F.count("start")).alias("exact_span_recall"))


# ---- outcomes -----------------------------------------------------------------------------------

ABSTAINING = ("Abstain", "UnsupportedClaim", "Conflict")


def abstention(expected: Column, answered: Column) -> Column:
    """One if a route answered where it should, or abstained where it should."""
    return F.when(expected.isin(*ABSTAINING) != answered, ONE).otherwise(0).cast("long")


def unsupported_check(expected: Column, answered: Column) -> Column:
    return (
        F.when(expected == "UnsupportedClaim", F.when(answered, "Failed").otherwise("Passed"))
        .when(expected == "Evidence", F.when(answered, "Passed").otherwise("Failed"))
        .otherwise("NotDetected")
    )


def conflict_check(expected: Column, answered: Column) -> Column:
    return F.when(expected == "Conflict", F.when(answered, "Failed").otherwise("Passed")).otherwise("NotDetected")


# ---- routes -------------------------------------------------------------------------------------


def route_metrics(cases: DataFrame, observed: DataFrame) -> DataFrame:
    """Per ``class, route`` of ``cases (case_id, class, expects_abstention, n_spans, n_chain)`` and ``observed (case_id,
    route, measured, span_hits, chain_length, outcome_correct, abstained, latency_ms, freshness_error, memory, disk,
    citation, privacy_violation, security_violation, energy)``."""
    rows = cases.join(observed, "case_id")
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("class", "route").agg(
        ratio(F.sum(F.least("span_hits", "n_spans")), F.sum("n_spans")).alias("exact_span_recall"),
        ratio(F.sum(F.least("chain_length", "n_chain")), F.sum("n_chain")).alias("chain_accuracy"),
        ratio(count(F.col("outcome_correct")), F.count("*")).alias("outcome_accuracy"),
        ratio(count(F.col("abstained") == F.col("expects_abstention")), F.count("*")).alias("abstention_accuracy"),
        nearest_rank("latency_ms", 95).alias("p95_latency_ms"),
        count(F.col("freshness_error")).alias("freshness_errors"),
        F.max("memory").alias("peak_memory"),
        F.max("disk").alias("peak_disk"),
        count(F.col("privacy_violation")).alias("privacy_violations"),
        count(F.col("security_violation")).alias("security_violations"),
        F.sum("energy").alias("energy"),
        # a sum of ten-thousandths over a count is capped at one, as any ratio is
        ratio(F.sum("citation"), F.count("*")).alias("citation_alignment"),
        F.bool_and("measured").alias("measured"),
    )


def route_wins(metrics: DataFrame, budgets: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """``class, wins`` over ``route_metrics``: some quality rises materially, and nothing else is worse. ``budgets
    (class, latency_budget_ms)`` holds the least latency budget of a class's cases."""
    old = metrics.filter(F.col("route") == baseline).drop("route").alias("o")
    new = metrics.filter(F.col("route") == challenger).drop("route").alias("n")
    rows = old.join(new, "class").join(budgets, "class", "left")
    of = lambda c: (F.col(f"o.{c}"), F.col(f"n.{c}"))
    gains = [of(c) for c in ("exact_span_recall", "chain_accuracy", "outcome_accuracy")]
    gain = reduce(lambda a, b: a | b, [n >= o + MATERIAL for o, n in gains])
    not_more = ("freshness_errors", "p95_latency_ms", "peak_memory", "peak_disk", "privacy_violations", "security_violations", "energy")
    safe = reduce(lambda a, b: a & b, [n <= o for o, n in map(of, not_more)] + [n >= o for o, n in map(of, ("abstention_accuracy", "citation_alignment"))])
    in_budget = F.coalesce(F.col("n.p95_latency_ms") <= F.col("latency_budget_ms"), F.lit(True))
    return rows.select("class", (F.col("o.measured") & F.col("n.measured") & gain & safe & in_budget).alias("wins"))


# ---- gates --------------------------------------------------------------------------------------

NOTHING_EXPECTED = ("NoEvidenceFound", "Abstained", "DeniedByPolicy", "QuarantinedForReview")
#: Thresholds in the order in which they are checked, with the names of what regressed.
QUALITY_FLOORS = [("recall", "Recall@k"), ("ndcg", "nDCG@k"), ("mrr", "MRR"), ("exact_span_recall", "exact-span recall")]
TELEMETRY = [("resource_telemetry", "resource telemetry"), ("security_telemetry", "security telemetry")]
CEILINGS = [
    ("latency_ms", "latency"), ("memory_bytes", "memory"), ("disk_bytes", "disk"), ("ingest_update_ms", "ingest/update cost"),
    ("energy_millijoules", "energy"), ("acl_leakage", "ACL leakage"), ("attack_successes", "attack success"), ("privacy_violations", "privacy violations"),
]


def golden_gate(reports: DataFrame, floors: dict[str, int], ceilings: dict[str, int]) -> DataFrame:
    """``query_id, regression``: the first threshold that a report breaks, or null. Quality counts only where evidence
    is expected; a ceiling that isn't given, or a value that wasn't measured, is no regression."""
    expects = ~F.col("expected_status").isin(*NOTHING_EXPECTED)
    rules = [(expects & (F.col(c) < floors.get(c, 0)), name) for c, name in QUALITY_FLOORS]
    rules += [(~F.col(c), name) for c, name in TELEMETRY]
    rules += [(F.col(c) > ceilings[c], name) for c, name in CEILINGS if c in ceilings]
    found = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for condition, name in rules[1:]:
        found = found.when(F.coalesce(condition, F.lit(False)), name)
    return reports.select("query_id", found.alias("regression"))


QUALITIES = ("recall", "ndcg", "mrr", "exact_span_recall")
COSTS = ("latency_ms", "memory_bytes", "disk_bytes", "ingest_update_ms", "energy_millijoules", "acl_leakage", "attack_successes", "privacy_violations")


def golden_comparison(baseline: DataFrame, candidate: DataFrame, material: int = MATERIAL, budgets_complete: bool = True) -> DataFrame:
    """One row ``decision, reason`` for two sets of reports: a candidate is promoted if some mean quality rises by
    ``material`` or more (five points at least), no mean and no query got worse, no cost rose, and telemetry and budgets
    are complete."""

    old, new = baseline.alias("o"), candidate.alias("n")
    both = old.join(new, F.col("o.query_id") == F.col("n.query_id"), "full_outer")
    worse = reduce(lambda a, b: a | b, [F.col(f"n.{c}") < F.col(f"o.{c}") for c in QUALITIES])
    folded = [F.coalesce(F.bool_or(worse), F.lit(False)).alias("query_fell")]
    for p in "on":
        reports = F.count(f"{p}.query_id")
        folded += [F.floor(F.sum(f"{p}.{c}") / reports).alias(f"{p}_{c}") for c in QUALITIES]
        # a cost that one report lacks is unknown
        folded += [F.when(F.count(f"{p}.{c}") == reports, F.sum(f"{p}.{c}")).alias(f"{p}_{c}") for c in COSTS]
    one = both.agg(*folded)
    pair = lambda c: (F.col(f"o_{c}"), F.col(f"n_{c}"))
    bad = [F.when(n < o, F.lit(f"mean_{c}")) for c in QUALITIES for o, n in [pair(c)]]
    bad += [F.when(F.coalesce(n > o, F.lit(False)), F.lit(c)) for c in COSTS for o, n in [pair(c)]]
    bad += [F.when(o.isNull() != n.isNull(), F.lit(f"{c} availability differs")) for c in ("ingest_update_ms", "energy_millijoules") for o, n in [pair(c)]]
    bad.append(F.when(F.col("query_fell"), F.lit("a query's quality")))
    regressions = F.array_compact(F.array(*bad))
    complete = reduce(lambda a, b: a & b, [F.col(f"{p}_{c}").isNotNull() for p in "on" for c in ("ingest_update_ms", "energy_millijoules")])
    better = reduce(lambda a, b: a | b, [n >= o + max(material, MATERIAL) for o, n in map(pair, QUALITIES)])
    reason = (
        F.when(F.size(regressions) > 0, F.concat(F.lit("Candidate regressed on: "), F.array_join(regressions, ", ")))
        .when(~complete, "Promotion requires complete ingest/update and energy telemetry")
        .when(F.lit(not budgets_complete), "Promotion requires explicit ingest/update and energy budgets")
        .when(~better, "Candidate did not produce a material quality improvement")
    )
    return one.select(F.when(reason.isNull(), "Promote").otherwise("RetainBaseline").alias("decision"), F.coalesce(reason, F.lit("Candidate materially improved quality without measured regressions")).alias("reason"))
