"""Registered queries of quality scoring, outcome checks and gates, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import quality
from siltstone.queries import query
from siltstone.session import table

# Cases are orders' customers; their lines give accepted spans, their orders a route's hits.
_SPANS = """acc AS (SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS span_no, o_orderkey % 7 AS source_id, o_orderkey % 50 AS a, o_orderkey % 50 + o_orderkey % 9 + 1 AS b FROM orders WHERE o_orderstatus = 'F'),
  chn AS (SELECT DISTINCT case_id, source_id FROM acc WHERE span_no <= 3),
  cand AS (SELECT c_custkey AS case_id, k AS lane_rank, c_custkey * 100 + k AS evidence_id, (c_custkey + k) % 7 AS source_id, (c_custkey * 3 + k * 7) % 55 AS a, (c_custkey * 3 + k * 7) % 55 + 6 AS b,
    CASE WHEN k % 3 <> 0 THEN (c_custkey + k) % 7 END AS cs, (c_custkey * 3 + k * 7) % 55 + 2 AS ca, (c_custkey * 3 + k * 7) % 55 + 4 AS cb, CASE WHEN k % 5 < 3 THEN (c_custkey + k) % 3 END AS grade FROM customer, range(1, 31) t(k) WHERE c_custkey % 4 <> 0)"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    accepted = o.select(F.col("o_custkey").alias("case_id"), nth.alias("span_no"), (k % 7).alias("source_id"), (k % 50).alias("start"), (k % 50 + k % 9 + 1).alias("end"))
    chain = accepted.filter("span_no <= 3").select("case_id", "source_id").distinct()
    c, r = F.col("c_custkey"), F.col("lane_rank")
    ranks = F.explode(F.sequence(F.lit(1), F.lit(30))).alias("lane_rank")
    start = (c * 3 + r * 7) % 55
    hits = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select("c_custkey", ranks).select(
        c.alias("case_id"), "lane_rank", (c * 100 + r).alias("evidence_id"), ((c + r) % 7).alias("source_id"), start.alias("start"), (start + 6).alias("end"),
        F.when(r % 3 != 0, (c + r) % 7).alias("cited_source"), (start + 2).alias("cited_start"), (start + 4).alias("cited_end"), F.when(r % 5 < 3, (c + r) % 3).alias("grade"),
    )
    return accepted, chain, hits


@query(
    f"""WITH {_SPANS},
  cases AS (SELECT case_id, count(*) AS n, count(DISTINCT source_id) AS ns FROM acc GROUP BY 1),
  met AS (SELECT c.case_id, c.lane_rank, c.source_id, x.span_no FROM cand c JOIN acc x ON c.case_id = x.case_id AND c.source_id = x.source_id AND c.a < x.b AND x.a < c.b),
  cov AS (SELECT case_id, span_no, min(lane_rank) AS r FROM met GROUP BY ALL),
  rec AS (SELECT case_id, count(*) AS covered, count(*) FILTER (r <= 5) AS r5, count(*) FILTER (r <= 20) AS r20, count(*) FILTER (r <= 50) AS r50, count(*) FILTER (r <= 100) AS r100 FROM cov GROUP BY 1),
  fresh AS (SELECT case_id, r, row_number() OVER (PARTITION BY case_id ORDER BY r) AS seen FROM (SELECT DISTINCT case_id, r FROM cov)),
  ap AS (SELECT case_id, sum(seen::DOUBLE / r) AS p FROM fresh GROUP BY 1),
  rel AS (SELECT case_id, count(DISTINCT source_id) AS rs, min(lane_rank) AS fr FROM met GROUP BY 1),
  gains AS (SELECT case_id, lane_rank, CASE grade WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS g FROM cand),
  d10 AS (SELECT case_id, sum(g / log2(lane_rank + 1)) AS d, sum(g / log2(i + 1)) AS b FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY g DESC, lane_rank) AS i FROM gains WHERE lane_rank <= 10) GROUP BY 1),
  d20 AS (SELECT case_id, sum(g / log2(lane_rank + 1)) AS d, sum(g / log2(i + 1)) AS b FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY g DESC, lane_rank) AS i FROM gains WHERE lane_rank <= 20) GROUP BY 1),
  got AS (SELECT case_id, count(*) AS nr, count(DISTINCT source_id) AS nd, count(cs) AS nc FROM cand GROUP BY 1),
  ch AS (SELECT case_id, count(*) AS n_chain, count(*) FILTER (EXISTS (SELECT 1 FROM cand WHERE cand.case_id = chn.case_id AND cand.source_id = chn.source_id)) AS on_chain FROM chn GROUP BY 1),
  ct AS (SELECT c.case_id, count(DISTINCT c.lane_rank) AS citing, count(DISTINCT x.span_no) AS cited FROM cand c JOIN acc x ON c.case_id = x.case_id AND c.cs = x.source_id AND c.ca < x.b AND x.a < c.cb GROUP BY 1)
  SELECT case_id, (coalesce(r5, 0) * 10000 // n)::BIGINT AS recall_5, (coalesce(r20, 0) * 10000 // n)::BIGINT AS recall_20, (coalesce(r50, 0) * 10000 // n)::BIGINT AS recall_50, (coalesce(r100, 0) * 10000 // n)::BIGINT AS recall_100,
    coalesce(CASE WHEN d10.b > 0 THEN round(round(d10.d / d10.b, 9) * 10000) END, 0)::BIGINT AS ndcg_10, coalesce(CASE WHEN d20.b > 0 THEN round(round(d20.d / d20.b, 9) * 10000) END, 0)::BIGINT AS ndcg_20,
    (CASE WHEN fr <= 10 THEN 10000 // fr ELSE 0 END)::BIGINT AS mrr_10, coalesce(round(round(p / covered, 9) * 10000), 0)::BIGINT AS average_precision, (coalesce(covered, 0) * 10000 // n)::BIGINT AS exact_span_recall,
    (coalesce(on_chain, 0) * 10000 // greatest(n_chain, 1))::BIGINT AS chain_coverage, (least(coalesce(rs, 0), ns) * 10000 // ns)::BIGINT AS source_diversity, coalesce((nr - nd) * 10000 // nr, 0)::BIGINT AS source_redundancy,
    (coalesce(citing, 0) * 10000 // greatest(coalesce(nc, 0), 1))::BIGINT AS citation_precision, (coalesce(cited, 0) * 10000 // n)::BIGINT AS citation_recall
  FROM cases LEFT JOIN rec USING (case_id) LEFT JOIN ap USING (case_id) LEFT JOIN rel USING (case_id) LEFT JOIN d10 USING (case_id) LEFT JOIN d20 USING (case_id) LEFT JOIN got USING (case_id) LEFT JOIN ch USING (case_id) LEFT JOIN ct USING (case_id)"""
)
def graded_quality(spark, sf_dir):
    return quality.graded_quality(*_cases(spark, sf_dir))


@query(
    """WITH j AS (SELECT l_orderkey AS query_id, l_linenumber AS evidence_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 5 END AS a, l_partkey % 5 + 2 AS b FROM lineitem), f AS (SELECT l_orderkey AS query_id, l_linenumber AS evidence_id, l_suppkey % 5 AS a FROM lineitem)
  SELECT query_id, (CASE WHEN count(a) = 0 THEN 10000 ELSE count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE f.query_id = j.query_id AND f.evidence_id = j.evidence_id AND f.a = j.a)) * 10000 // count(a) END)::BIGINT AS exact_span_recall FROM j GROUP BY 1"""
)
def exact_span_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    line = [F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("evidence_id")]
    p, s = F.col("l_partkey") % 5, F.col("l_suppkey") % 5
    told = rows.select(*line, F.when(F.col("l_linenumber") % 3 != 0, p).alias("start"), (p + 2).alias("end"))
    return quality.exact_span_recall(told, rows.select(*line, s.alias("start"), (s + 2).alias("end")))


_EXPECTED = ["Evidence", "Abstain", "UnsupportedClaim", "Conflict"]


@query(
    """WITH t AS (SELECT event_id, ['Evidence', 'Abstain', 'UnsupportedClaim', 'Conflict'][event_id % 4 + 1] AS e, value > 10 AS a FROM events)
  SELECT event_id, (CASE WHEN e = 'Evidence' THEN CASE WHEN a THEN 10000 ELSE 0 END WHEN a THEN 0 ELSE 10000 END)::BIGINT AS abstention,
    CASE WHEN e = 'UnsupportedClaim' AND a THEN 'Failed' WHEN e = 'UnsupportedClaim' THEN 'Passed' WHEN e = 'Evidence' AND a THEN 'Passed' WHEN e = 'Evidence' THEN 'Failed' ELSE 'NotDetected' END AS unsupported,
    CASE WHEN e <> 'Conflict' THEN 'NotDetected' WHEN a THEN 'Failed' ELSE 'Passed' END AS conflict FROM t"""
)
def outcome_checks(spark, sf_dir):
    expected, answered = F.element_at(F.array(*[F.lit(x) for x in _EXPECTED]), (F.col("event_id") % 4 + 1).cast("int")), F.col("value") > 10
    return table(spark, sf_dir, "events").select("event_id", quality.abstention(expected, answered).alias("abstention"), quality.unsupported_check(expected, answered).alias("unsupported"), quality.conflict_check(expected, answered).alias("conflict"))


_OBSERVED = """cs AS (SELECT o_orderkey AS case_id, o_orderpriority AS class, o_orderkey % 6 = 0 AS abst, o_orderkey % 5 AS n_spans, o_orderkey % 4 AS n_chain FROM orders),
  ob AS (SELECT l_orderkey AS case_id, CASE WHEN l_linenumber = 1 THEN 'general' ELSE 'special' END AS route, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q FROM lineitem WHERE l_linenumber <= 2),
  m AS (SELECT class, route, (CASE WHEN sum(n_spans) = 0 THEN 10000 ELSE sum(least(l_partkey % 5, n_spans)) * 10000 // sum(n_spans) END)::BIGINT AS exact_span_recall, (CASE WHEN sum(n_chain) = 0 THEN 10000 ELSE sum(least(l_suppkey % 4, n_chain)) * 10000 // sum(n_chain) END)::BIGINT AS chain_accuracy,
    (count(*) FILTER (l_partkey % 3 <> 0 OR route = 'special') * 10000 // count(*))::BIGINT AS outcome_accuracy, (count(*) FILTER ((l_suppkey % 6 = 0) = abst) * 10000 // count(*))::BIGINT AS abstention_accuracy, quantile_disc(q, 0.95) AS p95_latency_ms,
    count(*) FILTER (l_partkey % 50 = 0) AS freshness_errors, max(l_partkey) AS peak_memory, max(l_suppkey) AS peak_disk, count(*) FILTER (l_suppkey % 90 = 0) AS privacy_violations, count(*) FILTER (l_suppkey % 70 = 0) AS security_violations, sum(q)::BIGINT AS energy,
    10000::BIGINT AS citation_alignment, bool_and(q > 0) AS measured FROM cs JOIN ob USING (case_id) GROUP BY ALL)"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p, s, q = F.col("o_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    cases = table(spark, sf_dir, "orders").select(k.alias("case_id"), F.col("o_orderpriority").alias("class"), (k % 6 == 0).alias("expects_abstention"), (k % 5).alias("n_spans"), (k % 4).alias("n_chain"))
    route = F.when(F.col("l_linenumber") == 1, "general").otherwise("special")
    observed = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("case_id"), route.alias("route"), (q > 0).alias("measured"), (p % 5).alias("span_hits"), (s % 4).alias("chain_length"), ((p % 3 != 0) | (route == "special")).alias("outcome_correct"),
        (s % 6 == 0).alias("abstained"), q.alias("latency_ms"), (p % 50 == 0).alias("freshness_error"), p.alias("memory"), s.alias("disk"), F.lit(10_000).alias("citation"), (s % 90 == 0).alias("privacy_violation"),
        (s % 70 == 0).alias("security_violation"), q.alias("energy"),
    )
    return quality.route_metrics(cases, observed)


@query(f"WITH {_OBSERVED} SELECT * FROM m")
def route_metrics(spark, sf_dir):
    return _routes(spark, sf_dir)


@query(
    f"""WITH {_OBSERVED}, o AS (SELECT * FROM m WHERE route = 'general'), n AS (SELECT * FROM m WHERE route = 'special')
  SELECT class, o.measured AND n.measured AND (n.exact_span_recall >= o.exact_span_recall + 500 OR n.chain_accuracy >= o.chain_accuracy + 500 OR n.outcome_accuracy >= o.outcome_accuracy + 500) AND n.freshness_errors <= o.freshness_errors AND n.p95_latency_ms <= o.p95_latency_ms
    AND n.p95_latency_ms <= 60 AND n.peak_memory <= o.peak_memory AND n.peak_disk <= o.peak_disk AND n.privacy_violations <= o.privacy_violations AND n.security_violations <= o.security_violations AND n.energy <= o.energy AND n.abstention_accuracy >= o.abstention_accuracy
    AND n.citation_alignment >= o.citation_alignment AS wins FROM o JOIN n USING (class)"""
)
def route_wins(spark, sf_dir):
    metrics = _routes(spark, sf_dir)
    return quality.route_wins(metrics, metrics.select("class").distinct().withColumn("latency_budget_ms", F.lit(60)), "general", "special")


_REPORTS = """r AS (SELECT o_orderkey AS query_id, ['Answerable', 'NoEvidenceFound', 'Abstained'][o_orderkey % 3 + 1] AS expected_status, o_orderkey * 7 % 10001 AS recall, o_orderkey * 11 % 10001 AS ndcg, o_orderkey * 13 % 10001 AS mrr, o_orderkey * 17 % 10001 AS exact_span_recall,
    o_orderkey % 23 <> 0 AS rt, o_orderkey % 29 <> 0 AS st, o_custkey % 300 AS latency_ms, o_custkey % 1000 AS memory_bytes, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 90 END AS energy, CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS leak FROM orders)"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.element_at(F.array(F.lit("Answerable"), F.lit("NoEvidenceFound"), F.lit("Abstained")), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("query_id"), status.alias("expected_status"), (k * 7 % 10001).alias("recall"), (k * 11 % 10001).alias("ndcg"), (k * 13 % 10001).alias("mrr"), (k * 17 % 10001).alias("exact_span_recall"),
        (k % 23 != 0).alias("resource_telemetry"), (k % 29 != 0).alias("security_telemetry"), (c % 300).alias("latency_ms"), (c % 1000).alias("memory_bytes"), F.lit(0).alias("disk_bytes"), F.lit(5).alias("ingest_update_ms"),
        F.when(c % 4 != 0, c % 90).alias("energy_millijoules"), F.when(k % 31 == 0, 1).otherwise(0).alias("acl_leakage"), F.lit(0).alias("attack_successes"), F.lit(0).alias("privacy_violations"),
    )


@query(
    f"""WITH {_REPORTS} SELECT query_id, CASE WHEN expected_status = 'Answerable' AND recall < 1000 THEN 'Recall@k' WHEN expected_status = 'Answerable' AND ndcg < 1500 THEN 'nDCG@k' WHEN expected_status = 'Answerable' AND mrr < 700 THEN 'MRR'
    WHEN expected_status = 'Answerable' AND exact_span_recall < 900 THEN 'exact-span recall' WHEN NOT rt THEN 'resource telemetry' WHEN NOT st THEN 'security telemetry' WHEN latency_ms > 250 THEN 'latency' WHEN memory_bytes > 900 THEN 'memory'
    WHEN energy > 80 THEN 'energy' WHEN leak > 0 THEN 'ACL leakage' END AS regression FROM r"""
)
def golden_gate(spark, sf_dir):
    floors = {"recall": 1000, "ndcg": 1500, "mrr": 700, "exact_span_recall": 900}
    return quality.golden_gate(_reports(spark, sf_dir), floors, {"latency_ms": 250, "memory_bytes": 900, "energy_millijoules": 80, "acl_leakage": 0})


@query(
    """WITH c AS (SELECT o_orderstatus AS arm, (avg(o_orderkey * 7 % 9001))::DOUBLE AS q FROM orders GROUP BY 1)
  SELECT arm, CASE arm WHEN 'F' THEN 'Promote' ELSE 'RetainBaseline' END AS decision, CASE arm WHEN 'F' THEN 'Candidate materially improved quality without measured regressions' WHEN 'O' THEN 'Candidate did not produce a material quality improvement'
    ELSE 'Candidate regressed on: mean_recall, mean_ndcg, mean_mrr, mean_exact_span_recall, latency_ms, a query''s quality' END AS reason FROM c"""
)
def golden_comparison(spark, sf_dir):
    """Each arm's reports against themselves with a plan: F rises by 600, O by 100, P falls and is slower."""
    k, out = F.col("o_orderkey"), None
    for arm, by, slower in (("F", 600, 0), ("O", 100, 0), ("P", -1, 1)):
        rows = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == arm)

        def reports(plus: int, late: int, rows: DataFrame = rows) -> DataFrame:
            q = (k * 7 % 9001 + plus).cast("long")
            costs = {c: F.lit(1) for c in quality.COSTS} | {"latency_ms": F.lit(10 + late)}
            return rows.select(k.alias("query_id"), *[q.alias(c) for c in quality.QUALITIES], *[v.alias(c) for c, v in costs.items()])

        one = quality.golden_comparison(reports(0, 0), reports(by, slower)).select(F.lit(arm).alias("arm"), "decision", "reason")
        out = one if out is None else out.unionByName(one)
    return out
