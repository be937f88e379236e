"""Search plans on the driver: budgets, routing, validation; the written index, and the engine that runs plans.

A plan is a small value object. The engine turns it into DataFrames over the index: policy
filter, lanes, fusion, selection. Catalyst does the rest.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import classify, policy, text
from siltstone.functions.text import lane_allowance
from siltstone.operators import chunking, code, evaluation, lexical, outcome, selection
from siltstone.plans import extensions
from siltstone.session import cut, scratch

LANES = ("lexical", "substring", "cards")
FRESHNESS = ("Any", "UpToDate", "CurrentVersion")


@dataclass(frozen=True)
class Budget:
    max_results: int = 10
    max_candidates: int = 30_000
    max_work: int = 30_000_000
    max_bytes: int = 1 << 30
    max_queries: int = 8
    max_stages: int = 3
    max_latency_ms: int = 600_000

    def of_lane(self, lane: int, lanes: int) -> Budget:
        """Candidates, work and bytes are parted; results are not."""
        parts = {k: lane_allowance(getattr(self, k), lanes, lane) for k in ("max_candidates", "max_work", "max_bytes")}
        return replace(self, **parts)


@dataclass(frozen=True)
class SearchPlan:
    query: str
    intent: str
    queries: tuple[str, ...]
    lanes: tuple[str, ...]
    budget: Budget = Budget()
    authorization: policy.Authorization = policy.Authorization()
    requirements: selection.Requirements = selection.Requirements()
    stages: tuple[str, ...] = ("retrieve", "fuse", "select")
    rrf_k: int = 60
    freshness: str = "Any"
    vectors: tuple[tuple[int, tuple[float, ...]], ...] = ()  # of queries by number, for dense and visual lanes

    def trace_id(self) -> str:
        """SHA-256 of the plan's canonical JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()


class PlanError(ValueError):
    """A plan that breaks an invariant."""


def query_id(query: str) -> int:
    """FNV-1a, 64 bits, over the UTF-8 bytes."""
    h = 0xCBF29CE484222325
    for b in query.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def source_digest(ids: list[int]) -> str:
    """SHA-256 over a tag and big-endian ids in order."""
    return hashlib.sha256(b"source-filter" + b"".join(i.to_bytes(8, "big") for i in sorted(set(ids)))).hexdigest()


def validate(plan: SearchPlan) -> None:
    """All invariants of a plan; the first broken one is raised."""
    b = plan.budget
    checks = [
        (bool(plan.query.strip()), "query is blank"),
        (bool(plan.queries) and plan.queries[0] == plan.query, "the original query comes first"),
        (len(plan.queries) <= b.max_queries, "more queries than budgeted"),
        (len(set(plan.queries)) == len(plan.queries), "queries repeat"),
        (all(q.strip() for q in plan.queries), "a query is blank"),
        (len(set(plan.stages)) == len(plan.stages), "stages repeat"),
        (bool(plan.lanes), "no lane"),
        (len(set(plan.lanes)) == len(plan.lanes), "lanes repeat"),
        (set(plan.lanes) <= set(LANES), "unknown lane"),
        (1 <= b.max_results <= 100, "max_results is from 1 to 100"),
        (b.max_candidates > 0 and b.max_work > 0 and b.max_bytes > 0 and b.max_queries > 0 and b.max_stages > 0 and b.max_latency_ms > 0, "budgets are positive"),
        (b.max_results <= b.max_candidates, "more results than candidates"),
        (len(plan.stages) <= b.max_stages, "more stages than budgeted"),
        (plan.stages[:1] == ("retrieve",), "a plan begins with retrieval"),
        (plan.rrf_k > 0, "k is positive"),
        (plan.freshness in FRESHNESS, "unknown freshness"),
        (len(set(plan.requirements.required_keys)) == len(plan.requirements.required_keys) and all(k.strip() for k in plan.requirements.required_keys), "required keys repeat or are blank"),
        (plan.authorization.scopes is None or len(plan.authorization.scopes) > 0, "the effective scope is empty"),
    ]
    for fine, why in checks:
        if not fine:
            raise PlanError(why)


def plan(spark: SparkSession, query: str, budget: Budget = Budget(), authorization: policy.Authorization = policy.Authorization(), requirements: selection.Requirements = selection.Requirements()) -> SearchPlan:
    """Classify, rewrite, route and validate. One row is evaluated by the same expressions that tables use."""
    if not query.strip():
        raise PlanError("query is blank")
    row = spark.range(1).select(classify.intent(F.lit(query)).alias("i"), classify.rewrites(F.lit(query)).alias("r")).first()
    made = [query]
    for r in row.r:
        if r not in made and len(made) < budget.max_queries:
            made.append(r)
    lanes = ("lexical", "substring", "cards") if row.i != "ExactLookup" else ("substring", "lexical")
    out = SearchPlan(query, row.i, tuple(made), lanes, budget, authorization, requirements)
    validate(out)
    return out


def governed(plan: SearchPlan, classified: str, capabilities: set[str], most: Budget, policy_: policy.Authorization) -> str | None:
    """The first governance rule that a valid plan breaks, or null: its intent is the classifier's, its lanes are there,
    its scopes and permissions are no wider than the policy's, and no budget is above the policy's."""
    a, scopes = plan.authorization, policy_.scopes
    order = policy.SENSITIVITY
    wider = (a.require_read_allowed < policy_.require_read_allowed) or a.allow_quarantined > policy_.allow_quarantined or a.allow_prompt_injection > policy_.allow_prompt_injection
    ceiling = policy_.max_sensitivity is not None and (a.max_sensitivity is None or order.index(a.max_sensitivity) > order.index(policy_.max_sensitivity))
    rules = [
        (plan.intent != classified, "intent mismatch"),
        (not set(plan.lanes) <= capabilities, "unsupported capability"),
        (scopes is not None and (a.scopes is None or not set(a.scopes) <= set(scopes)), "scope exceeds policy"),
        (policy_.trust_zone is not None and a.trust_zone != policy_.trust_zone, "trust zone exceeds policy"),
        (wider or ceiling or (a.allow_unscoped and not policy_.allow_unscoped), "security exceeds policy"),
    ]
    rules += [(getattr(plan.budget, f) > getattr(most, f), f"{f} exceeds policy") for f in ("max_results", "max_candidates", "max_work", "max_bytes", "max_queries", "max_stages", "max_latency_ms")]
    return next((why for broken, why in rules if broken), None)


@dataclass(frozen=True)
class Index:
    """A written corpus: documents with what policy needs, and full-text postings of texts and of cards' fields.

    Texts are tokenized, and scanned for secrets and injections, once, when the index is built.
    """

    spark: SparkSession
    path: str
    documents: DataFrame

    @staticmethod
    def build(documents: DataFrame, path: str | None = None) -> Index:
        """From ``doc_id, text, path, version_id`` and security columns; written below the shared folder or at ``path``."""
        spark = documents.sparkSession
        path = path or scratch(spark, "index")
        checked = documents.withColumn("has_secret", text.has_secret(F.col("text"))).withColumn("injected", text.injection_risk(F.col("text")))
        checked.write.parquet(f"{path}/documents")
        rows = spark.read.parquet(f"{path}/documents")
        lexical.Postings.write(rows.select("doc_id", "text"), f"{path}/text")
        chunks = chunking.markdown_chunks(rows.select("doc_id", "text"))
        cards = cut(chunking.summary_cards(rows.select("doc_id", "text", "path"), chunks, F.col("path")))
        for c in ("title", "body"):
            lexical.Postings.write(cards, f"{path}/{c}", text_col=c)
        return Index.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(spark, path, spark.read.parquet(f"{path}/documents"))

    def allowed(self, authorization: policy.Authorization) -> DataFrame:
        """Documents that a request may read, and that hold neither secrets nor injections."""
        return policy.authorized(self.documents, authorization).filter(~F.col("has_secret") & ~F.col("injected"))

    def full_text(self, field: str) -> lexical.Postings:
        return lexical.Postings.read(self.spark, f"{self.path}/{field}")


class Policed:
    """The evaluator that comes with the engine: status from coverage, freshness and diversity."""

    def evaluate(self, selected: DataFrame) -> DataFrame:
        return outcome.evaluate(selected)


@dataclass
class Engine:
    """Index documents, then search them.

    ``index`` takes ``doc_id, text, path, version_id`` and security columns and writes an
    ``Index``; ``search`` returns the selected evidence with scores and status;
    ``code_search`` queries a symbol table; ``evaluate`` scores rankings against judgments.
    Lanes, fusion, reranker, expander and evaluator are parts (see ``extensions``).
    """

    spark: SparkSession
    corpus: Index | None = None
    symbols: DataFrame | None = None
    retrievers: tuple[extensions.CandidateRetriever, ...] = ()
    eligibility: extensions.Eligibility = extensions.Eligibility()
    fusion: extensions.RankFusion | None = None
    reranker: extensions.CandidateReranker | None = None
    expander: extensions.ContextExpander | None = None
    evaluator: extensions.RetrievalEvaluator = field(default_factory=Policed)

    def index(self, documents: DataFrame, path: str | None = None) -> Engine:
        return self.over(Index.build(documents, path))

    def over(self, corpus: Index) -> Engine:
        """An engine over an index, with its text lanes before any others that were given."""
        lanes = (extensions.LexicalLane(corpus), extensions.SubstringLane(corpus), extensions.CardLane(corpus))
        return replace(self, corpus=corpus, retrievers=(*lanes, *self.retrievers))

    def index_code(self, files: DataFrame, path: str | None = None) -> Engine:
        """Extract symbols and write them."""
        path = path or scratch(self.spark, "symbols")
        code.symbols(files).write.parquet(path)
        return replace(self, symbols=self.spark.read.parquet(path))

    def active(self, plan: SearchPlan) -> list[extensions.CandidateRetriever]:
        """Lanes of a plan that its query's class may use, in the plan's order; specialised ones follow."""
        by_id = {r.descriptor.id: r for r in self.retrievers}
        row = self.spark.range(1).select(classify.query_class(F.lit(plan.query)).alias("c")).first()
        named = [by_id[n] for n in plan.lanes if n in by_id]
        others = [r for n, r in by_id.items() if n not in LANES]
        return [r for r in (*named, *others) if self.eligibility.admits(r.descriptor, row.c)]

    def shadows(self, plan: SearchPlan) -> list[extensions.CandidateRetriever]:
        """Sparse lanes that run beside a search, to be measured, where they aren't part of it."""
        live = {r.descriptor.id for r in self.active(plan)}
        return [r for r in self.retrievers if r.descriptor.is_sparse and r.descriptor.id not in live]

    def lane_hits(self, plan: SearchPlan, queries: tuple[str, ...] | None = None, first_lane: int = 0, lanes: list | None = None) -> DataFrame:
        """Hits of all lanes and queries in the fusion's form: one scan a lane, whatever the number of queries. Denied
        rows are dropped before anything is scored; a query of a lane brings its share of the plan's candidates."""
        asked, out = queries or plan.queries, None
        lanes = self.active(plan) if lanes is None else lanes
        total = len(lanes) * len(asked)
        for n, lane in enumerate(lanes):
            shares = [plan.budget.of_lane(n * len(asked) + i, total).max_candidates for i in range(len(asked))]
            request = extensions.Request(asked, plan.authorization, max(shares), dict(plan.vectors))
            best = lexical.best_of_each(lane.retrieve(request), max(shares))
            best = best.filter(F.col("rank") <= F.array(*[F.lit(x) for x in shares])[F.col("q")])
            place = F.lit(first_lane + n * len(asked)) + F.col("q")
            hits = best.select(
                F.lit(plan.query).alias("query_id"), F.concat(F.lit(f"{lane.descriptor.id}:"), place.cast("string")).alias("lane"), F.lit("Succeeded").alias("status"), F.col("rank"),
                F.col("id").cast("long").alias("evidence_id"), F.lit(1).alias("version"), F.lit(None).cast("long").alias("dup_cluster"), F.lit(lane.descriptor.id).alias("kind"),
                F.col("score_milli").alias("raw_score"), (F.col("rank") + place * 1_000_000).alias("arrival"),
            )
            out = hits if out is None else out.unionByName(hits)
        if out is None:
            raise PlanError("no lane may serve the plan")
        return out

    def ranked(self, plan: SearchPlan, hits: DataFrame) -> DataFrame:
        """Fused, reranked and expanded candidates: ``query_id, identity, score, fused_rank``, at most the plan's."""
        fused = (self.fusion or extensions.ReciprocalRanks(plan.rrf_k)).fuse(hits).filter(F.col("fused_rank") < plan.budget.max_candidates)
        if self.reranker:
            fused = self.reranker.rerank(fused)
        if self.expander:
            seeds = fused.select("query_id", "identity", "fused_rank").withColumnRenamed("fused_rank", "seed")
            wide = self.expander.expand(fused).join(seeds, ["query_id", "identity"], "left")
            order = Window.partitionBy("query_id").orderBy(F.col("seed").isNull(), "seed", F.desc("score"), "identity")
            fused = wide.withColumn("fused_rank", F.row_number().over(order) - 1)
        return fused.select("query_id", "identity", "score", "fused_rank")

    def select(self, plan: SearchPlan, hits: DataFrame) -> DataFrame:
        """The evidence that is selected from lane hits, with coverage, freshness and the stop reason.

        A document covers a required key if all words of the key are in its text.
        """
        words = text.tokens(F.col("text"))
        keys = [F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in sorted(set(ws))]), words)) == 0, F.lit(k)) for k, ws in self._key_words(plan).items() if ws]
        covered = F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")
        # what may be read is checked again: expansion may have brought other documents
        places = self.corpus.allowed(plan.authorization).select(F.col("doc_id").alias("identity"), "path", "version_id", covered.alias("coverage_keys"))
        candidates = self.ranked(plan, hits).join(places, "identity").select(
            "query_id", F.col("fused_rank").alias("rank"), F.col("identity").alias("evidence_id"), F.lit(None).cast("long").alias("dup_cluster"), F.col("path").alias("source"),
            F.col("version_id").cast("string").alias("document"), F.concat_ws(":", F.lit("artifact"), F.col("version_id").cast("string")).alias("section"), F.lit("Current").alias("freshness"), "coverage_keys", "score",
        )
        candidates = cut(candidates)  # read by the selection and again for its scores
        chosen = selection.select(candidates.drop("score"), plan.requirements, plan.budget.max_results, plan.budget.max_candidates).filter("placement = 'Selected'")
        return chosen.join(candidates.select("query_id", "evidence_id", "score", "source", "document", "section", "freshness", "coverage_keys"), ["query_id", "evidence_id"])

    def _key_words(self, plan: SearchPlan) -> dict[str, list[str]]:
        keys = plan.requirements.required_keys
        rows = self.spark.createDataFrame([(k,) for k in keys], "k string").select("k", text.tokens(F.col("k")).alias("w")).collect() if keys else []
        return {r.k: list(r.w) for r in rows}

    def search(self, plan: SearchPlan) -> DataFrame:
        """``evidence_id, rank, score, stop_reason, percent_covered, status`` of the fused and selected evidence."""
        validate(plan)
        return _evidence(self.select(plan, self.lane_hits(plan)))

    def outcome(self, plan: SearchPlan) -> DataFrame:
        """One row: status, coverage and counts of a search, and the plan's identity."""
        validate(plan)
        return self.evaluator.evaluate(self.select(plan, self.lane_hits(plan))).withColumn("trace_id", F.lit(plan.trace_id()))

    def pack(self, plan: SearchPlan) -> DataFrame:
        """The evidence pack of a search: claims with their evidence, sources, freshness and how to repeat it."""
        validate(plan)
        return outcome.evidence_pack(self.select(plan, self.lane_hits(plan)), plan.requirements.required_keys, plan.trace_id())

    def adaptive_search(self, plan: SearchPlan) -> DataFrame:
        """Ask again with each required key that is uncovered, while the plan has stages and queries left.

        Hits of all rounds are fused anew. A key that carries injection markers counts as
        tried and is never executed. The search stops when nothing is missing, when a status
        is final, when every missing key was tried, when a round brought nothing new and no
        key is left, or when stages, queries or time are used up.
        """
        validate(plan)
        began, rounds = time.monotonic(), plan.budget.max_stages - len(plan.stages)
        hits = cut(self.lane_hits(plan))
        # at most max_results rows; a stage is evaluated before the next is planned
        found = cut(self.select(plan, hits))
        tried: list[str] = []
        asked, lanes = list(plan.queries), len(self.active(plan)) * len(plan.queries)
        known = {r.evidence_id for r in found.select("evidence_id").collect()}
        while True:
            status = (self.evaluator.evaluate(found).select("status").first() or [None])[0]
            missing = self._missing(plan, found)
            late = (time.monotonic() - began) * 1000 >= plan.budget.max_latency_ms
            stop = adaptive_stop(status, missing, tried, len(tried) >= rounds or len(asked) >= plan.budget.max_queries or late)
            if stop is not None:
                break
            key = next(k for k in missing if k not in tried)
            tried.append(key)
            if not self.spark.range(1).select(text.injection_risk(F.lit(key)).alias("x")).first().x:
                asked.append(key)
                more = self.lane_hits(plan, (key,), lanes)
                lanes += len(self.active(plan))
                hits = cut(hits.unionByName(more))
                found = cut(self.select(plan, hits))
            now = {r.evidence_id for r in found.select("evidence_id").collect()}
            left = self._missing(plan, found)
            if now == known and all(k in tried for k in left):
                stop = "EvidenceComplete" if not left else "LowMarginalGain" if now else "NoEvidence"
                break
            known = now
        return _evidence(found).withColumn("stop_reason", F.when(F.lit(stop == "EvidenceComplete"), F.col("stop_reason")).otherwise(F.lit(stop)))

    def _missing(self, plan: SearchPlan, found: DataFrame) -> list[str]:
        """Required keys that no selected evidence covers, in order."""
        row = found.select(F.explode("coverage_keys").alias("k")).agg(F.collect_set("k").alias("k")).first()
        return sorted(set(plan.requirements.required_keys) - set(row.k))

    def explain(self, plan: SearchPlan) -> dict:
        """What a plan is and how it runs: its identity and fields, its lanes, and the optimized plan of its fusion."""
        validate(plan)
        fused = self.ranked(plan, self.lane_hits(plan))
        return {"trace_id": plan.trace_id(), "plan": asdict(plan), "lanes": [r.descriptor.id for r in self.active(plan)], "shadow": [r.descriptor.id for r in self.shadows(plan)], "physical": fused._jdf.queryExecution().optimizedPlan().toString()}

    def shadow(self, plan: SearchPlan) -> DataFrame | None:
        """Hits of the lanes that run beside a search, to be recorded and never served; none without such a lane."""
        lanes = self.shadows(plan)
        return self.lane_hits(plan, lanes=lanes) if lanes else None

    def code_search(self, kind: str, value: str | None = None, limit: int = 20) -> DataFrame:
        """A code query; an invalid pattern gives no rows (see ``code.regex_error``)."""
        if kind == "regex" and code.regex_error(value):
            return code.query(self.symbols, F.lit(False), limit)
        return code.query(self.symbols, code.matches(kind, value), limit)

    def evaluate(self, ranked: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
        """Golden metrics of ``ranked (query_id, evidence_id, rank)`` against ``judgments (query_id, evidence_id, grade)``."""
        return evaluation.golden_metrics(ranked, judgments, k)

    def chunks(self) -> DataFrame:
        return extensions.parse(self.corpus.documents.select("doc_id", "path", "text"))


def adaptive_stop(status: str | None, missing: list[str], tried: list[str], spent: bool) -> str | None:
    """Why an adaptive search ends before another round, or null if it goes on."""
    if status == "SourcesConflict":
        return "RequirementsUnmet"
    if status in ("DeniedByPolicy", "QuarantinedForReview"):
        return "PolicyDenied"
    if status == "Abstained":
        return "Abstained"
    if not missing:
        return "EvidenceComplete"
    if spent:
        return "BudgetExhausted"
    return "RequirementsUnmet" if all(k in tried for k in missing) else None


def _evidence(chosen: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("original_rank")
    return chosen.select("evidence_id", F.row_number().over(order).alias("rank"), "score", "stop_reason", "percent_covered", "status")


def secured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Security columns derived from tables: toxic is quarantined, unlabelled unreviewed; source gives path and
    scope, doc_id the sensitivity, permissions and which are rejected or have no scope."""
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.join(marks, "doc_id", "left")
    places = F.array(*[F.lit(s) for s in policy.SENSITIVITY])
    return rows.select(
        "doc_id", "text", "lang", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), text.version_id(F.col("text")).alias("version_id"),
        F.when(F.col("toxic") == 1, "Quarantined").when(F.col("toxic") == 0, "Verified").otherwise("Untrusted").alias("trust_zone"),
        F.when(F.col("doc_id") % 19 == 0, "Rejected").when(F.col("toxic").isNull(), "Unreviewed").otherwise("Approved").alias("review_status"), F.lit("External").alias("authority"),
        F.when(F.col("doc_id") % 97 == 0, "Compromised").otherwise("Unverified").alias("integrity"), F.element_at(places, (F.col("doc_id") % 4 + 1).cast("int")).alias("sensitivity"),
        (F.col("doc_id") % 13 != 0).alias("read_allowed"), (F.col("doc_id") % 11 != 0).alias("write_allowed"),
        F.when(F.col("doc_id") % 5 != 0, F.regexp_extract("source", "([0-9]+)$", 1).cast("long")).alias("scope_id"), text.injection_risk(F.col("text")).alias("prompt_injection_risk"),
        F.when(F.col("doc_id") % 31 == 0, F.array(F.lit("seeded"))).otherwise(F.array().cast("array<string>")).alias("poisoning_flags"),
    )
