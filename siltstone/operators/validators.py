"""Checks of claims, tasks, memories and search outcomes as anti joins and folds; each is one row ``check, passed, failures``."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import policy
from siltstone.plans.extensions import Check, Validator


def _row(name: str, failures: DataFrame) -> DataFrame:
    """The check's row from the rows that fail it."""
    return failures.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), (F.col("failures") == 0).alias("passed"), "failures")


def uncited_claims(claims: DataFrame) -> DataFrame:
    """``claims (claim_id, evidence_ids)`` without evidence."""
    return claims.filter(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0)


def missing_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """References of ``items (evidence_ids)`` that are no ``evidence (evidence_id)``, one row a reference."""
    return items.select(F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")


def unready_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that aren't being validated."""
    return tasks.filter(~F.col("status").eqNullSafe(F.lit("Validating")))


def failed_runs(runs: DataFrame) -> DataFrame:
    """Runs that ended with an error; one without an exit code has none."""
    return runs.filter(F.col("exit_code").isNotNull() & (F.col("exit_code") != 0))


def basic_checks(claims: DataFrame, evidence: DataFrame, tasks: DataFrame, runs: DataFrame, memories: DataFrame) -> DataFrame:
    parts = [
        _row("citation", uncited_claims(claims)),
        _row("evidence_existence", missing_evidence(claims, evidence)),
        _row("task_state", unready_tasks(tasks)),
        _row("harness_run", failed_runs(runs)),
        _row("memory", missing_evidence(memories, evidence)),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- outcomes -----------------------------------------------------------------------------------


def coverage_problems(outcomes: DataFrame) -> DataFrame:
    """``outcome_id, problem`` of ``outcomes (outcome_id, status, percent, n_evidence, n_gaps, sources, documents, sections,
    primary, min_corroboration, min_sources, min_documents, min_sections, needs_primary)``, a row a problem."""
    c, answerable = F.col, F.col("status") == "Answerable"
    rules = {
        "no evidence": c("n_evidence") == 0,
        "not answerable": ~answerable,
        "no coverage": c("percent") == 0,
        "incomplete coverage": answerable & ((c("percent") != 100) | (c("n_gaps") > 0)),
        "corroboration": c("n_evidence") < c("min_corroboration"),
        "sources": c("sources") < c("min_sources"),
        "documents": c("documents") < c("min_documents"),
        "sections": c("sections") < c("min_sections"),
        "primary source": c("needs_primary") & ~c("primary"),
    }
    return _problems(outcomes, "outcome_id", rules)


def _problems(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))
    return rows.select(key, F.explode(found).alias("problem"))


def stale_candidates(outcomes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that aren't up to date under outcomes that ask for it (``freshness`` other than Any)."""
    asking = outcomes.filter("freshness <> 'Any'").select("outcome_id")
    return candidates.join(asking, "outcome_id", "left_semi").filter("freshness <> 'UpToDate'")


def misaligned_claims(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """``claims (outcome_id, claim_id, evidence_ids)`` none of whose evidence is among the outcome's candidates."""
    cited = claims.select("outcome_id", "claim_id", F.explode("evidence_ids").alias("evidence_id"))
    good = cited.join(candidates.select("outcome_id", "evidence_id"), ["outcome_id", "evidence_id"], "left_semi").select("outcome_id", "claim_id").distinct()
    return claims.join(good, ["outcome_id", "claim_id"], "left_anti")


def orphaned_candidates(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """``outcome_id, evidence_id, problem``: candidates without a record, or whose artifact or span isn't the record's."""
    told = evidence.select("evidence_id", F.col("artifact_id").alias("own_artifact"), F.col("start").alias("own_start"), F.col("end").alias("own_end"), F.lit(True).alias("there"))
    met = candidates.join(told, "evidence_id", "left")
    same = F.col("artifact_id").eqNullSafe(F.col("own_artifact")) & F.col("start").eqNullSafe(F.col("own_start")) & F.col("end").eqNullSafe(F.col("own_end"))
    problem = F.when(F.col("there").isNull(), "no record").when(~same, "provenance")
    return met.select("outcome_id", "evidence_id", problem.alias("problem")).filter("problem IS NOT NULL")


def irreproducible(outcomes: DataFrame, traces: DataFrame) -> DataFrame:
    """``outcome_id, problem`` where ``outcomes`` and ``traces (outcome_id, trace_id, fingerprint, generation, evidence,
    percent)`` differ, candidates repeat, or a complete stop left an answer incomplete."""
    t = traces.select("outcome_id", *[F.col(c).alias(f"t_{c}") for c in ("trace_id", "fingerprint", "generation", "evidence", "percent", "stop_reason")])
    rows, c = outcomes.join(t, "outcome_id", "left"), F.col
    rules = {
        "trace identity": ~c("trace_id").eqNullSafe(c("t_trace_id")),
        "fingerprint": ~c("fingerprint").eqNullSafe(c("t_fingerprint")),
        "generation": ~c("generation").eqNullSafe(c("t_generation")),
        "evidence": ~c("evidence").eqNullSafe(c("t_evidence")),
        "coverage": ~c("percent").eqNullSafe(c("t_percent")),
        "duplicates": F.size(F.array_distinct("evidence")) < F.size("evidence"),
        "incomplete": (c("t_stop_reason") == "EvidenceComplete") & (c("percent") != 100) & (c("status") == "Answerable"),
    }
    return _problems(rows, "outcome_id", rules)


def required_filters(restricted: bool, authorization: policy.Authorization, freshness: str) -> list[str]:
    """The security filters that a search's trace has to name as applied."""
    out = ["Quarantine", "PromptInjection"]
    out += ["Scope"] * (restricted or authorization.scopes is not None) + ["Acl"] * authorization.require_read_allowed
    out += ["Trust"] * (authorization.trust_zone is not None) + ["Sensitivity"] * (authorization.max_sensitivity is not None)
    return out + ["Freshness"] * (freshness != "Any")


def applied_filters(authorization: policy.Authorization, restricted: bool, code: bool) -> list[str]:
    """The security filters that a plan's lanes apply: freshness only where a code lane enforces it."""
    return required_filters(restricted, authorization, "UpToDate" if code else "Any")


def unreleasable(candidates: DataFrame, authorization: policy.Authorization) -> DataFrame:
    """Candidates with security columns that the policy of their search denies."""
    return candidates.withColumn("denial", policy.denial(authorization)).filter("denial IS NOT NULL")


# ---- corpora and runs ---------------------------------------------------------------------------

ROLES = ("TaskDefinition", "EvidenceSource", "SecurityFixture", "JudgmentGuidance")


def corpus_problems(sources: DataFrame, cases: DataFrame, spans: DataFrame, judges: int) -> DataFrame:
    """``problem, item`` of a benchmark corpus: ``sources (source_id, path, role)``, ``cases (case_id, class, split,
    task_id)``, ``spans (case_id, source_id, start, end)``."""
    say = lambda df, problem, item: df.select(F.lit(problem).alias("problem"), F.col(item).cast("string").alias("item"))
    spark = sources.sparkSession
    path = F.col("path")
    bad_path = (F.trim("path") == "") | path.startswith("/") | F.array_contains(F.split("path", "/"), "..")
    roles = spark.createDataFrame([(r,) for r in ROLES], "role string")
    splits = spark.createDataFrame([("development",), ("final",)], "split string")
    repeated = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    parts = [
        say(sources.filter(bad_path | (F.trim("source_id") == "")), "source path", "source_id"),
        say(repeated(sources, "source_id"), "repeated source", "source_id"),
        say(roles.join(sources.select("role").distinct(), "role", "left_anti"), "missing role", "role"),
        say(repeated(cases, "case_id"), "repeated case", "case_id"),
        say(splits.join(cases.select("split").distinct(), "split", "left_anti"), "missing split", "split"),
        say(spans.join(sources.select("source_id"), "source_id", "left_anti"), "unknown source", "source_id"),
        say(spans.filter("start >= end"), "empty span", "case_id"),
        # a task of the final split in two classes would count twice
        say(cases.filter("split = 'final'").groupBy("task_id").agg(F.count_distinct("class").alias("n")).filter("n > 1"), "task in classes", "task_id"),
    ]
    if judges < 2:
        parts.append(spark.createDataFrame([("judges", str(judges))], "problem string, item string"))
    return reduce(DataFrame.unionByName, parts).distinct()


@dataclass(frozen=True)
class Failing:
    """A validator from a function that gives the rows that fail."""

    name: str
    failures: object

    def validate(self, context: object) -> Check:
        n = self.failures(context).count()
        return Check(self.name, n == 0, "nothing fails" if n == 0 else f"{n} row(s) fail")


def run_all(validators: list[Validator], context: object) -> tuple[bool, list[Check]]:
    """All checks, and whether every one passed."""
    checks = [v.validate(context) for v in validators]
    return all(c.passed for c in checks), checks
