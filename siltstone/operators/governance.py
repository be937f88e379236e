"""Gates, lifecycles and checks: decisions as column expressions and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import policy, text

# Decisions by autonomy profile group and risk class.
RISKS = ["Low", "Medium", "High", "Critical"]
APPROVAL = {
    "ReadOnly": ["Allow", "RequireApproval", "RequireApproval", "Deny"],
    "Assisted": ["Allow", "RequireApproval", "RequireApproval", "Deny"],
    "ScopedAutonomy": ["Allow", "RequireApproval", "RequireApproval", "Deny"],
    "StrictResearch": ["Allow", "Allow", "RequireApproval", "Deny"],
    "TrustedWorkspace": ["Allow", "Allow", "RequireApproval", "RequireApproval"],
}

# Task states that may follow each other.
TASK_NEXT = {
    "Draft": ["Open", "Cancelled"],
    "Open": ["Active", "Cancelled"],
    "Active": ["Validating", "Blocked", "Failed", "Cancelled"],
    "Validating": ["CompletedVerified", "CompletedWithWarnings", "Failed", "Active"],
    "Blocked": ["Active", "Failed", "Cancelled"],
}


def approval(profile: Column, risk: Column) -> Column:
    """Decision of a profile on a risk class; unknown ones are denied."""
    found = F.lit("Deny")
    for name, actions in APPROVAL.items():
        for r, action in zip(RISKS, actions, strict=True):
            found = F.when((profile == name) & (risk == r), action).otherwise(found)
    return found


def task_step(now: Column, to: Column) -> Column:
    allowed = F.lit(False)
    for a, following in TASK_NEXT.items():
        allowed = allowed | ((now == a) & to.isin(*following))
    return allowed


def completion(status: Column, report_task: Column, task: Column, passed: Column, warnings: Column, proposed: Column, allow_warnings: bool = True) -> Column:
    """Why a task's completion is blocked, else AllowCompletion; ``passed`` is null without a report."""
    return (
        F.when(status != "Validating", "NotValidating")
        .when(passed.isNull(), "MissingValidation")
        .when(~report_task.eqNullSafe(task), "WrongTask")
        .when(~passed, "Failed")
        .when((warnings > 0) & ~F.lit(allow_warnings), "WarningsBlocked")
        .when((proposed == "Verified") & (warnings > 0), "WarningsPresent")
        .when((proposed == "WithWarnings") & (warnings == 0), "NoWarnings")
        .otherwise("AllowCompletion")
    )


def memory_transition(action: Column, status: Column, self_superseding: Column, replacement_exists: Column) -> Column:
    """Status after a lifecycle action on a memory (null status: it doesn't exist)."""
    gone = status.isNull()
    return (
        F.when((action == "promote") & gone, "Active")
        .when(gone, "MissingMemory")
        .when(action == "contradict", "Contradicted")
        .when(action == "deprecate", "Deprecated")
        .when((action == "supersede") & self_superseding, "SelfSuperseded")
        .when((action == "supersede") & ~replacement_exists, "MissingReplacement")
        .when(action == "supersede", "Superseded")
        .otherwise(status)
    )


def conflict_problems(outcomes: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """``outcome_id, problem``: a conflict set without its status or the reverse, and members that aren't evidence."""
    sized = outcomes.join(members.groupBy("outcome_id").agg(F.count("*").alias("n")), "outcome_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    odd = sized.filter((F.col("n") > 0) != (F.col("status") == "SourcesConflict")).select("outcome_id", F.lit("status").alias("problem"))
    alien = members.join(evidence, ["outcome_id", "evidence_id"], "left_anti").select("outcome_id", F.lit("member").alias("problem"))
    return odd.unionByName(alien).distinct()


def page(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with ``complete``: whether there are no more, by reading one more."""
    more = df.orderBy(*order).limit(n + 1)
    nth = F.row_number().over(Window.orderBy(*order))  # n + 1 rows
    numbered = more.withColumn("nth", nth)
    return numbered.withColumn("complete", F.count("*").over(Window.partitionBy()) <= n).filter(F.col("nth") <= n)


def drop_stale_code(candidates: DataFrame) -> DataFrame:
    """Candidates without the code lane's stale ones, which never reach fusion."""
    return candidates.filter(~_stale_code())


def stale_code_only(candidates: DataFrame) -> DataFrame:
    """``query_id, stale_code_only``: whether a query found nothing but stale code."""
    return candidates.groupBy("query_id").agg(F.bool_and(_stale_code()).alias("stale_code_only"))


def _stale_code() -> Column:
    return (F.col("lane") == "code") & (F.col("freshness") == "Stale")


def _clean(column: str) -> Column:
    """Whether a text is there and holds no secret: what can't be scanned isn't clean."""
    return F.col(column).isNotNull() & ~text.has_secret(F.col(column))


def eligible_chunks(artifacts: DataFrame, chunks: DataFrame, evidence: DataFrame, auth: policy.Authorization) -> DataFrame:
    """Chunks ``(chunk_id, artifact_id, ord, body)`` that may be scored, with their artifact and evidence: the artifact is
    indexed and may be read, the chunk's text is clean, and its evidence exists, may be read and has a clean excerpt."""
    mine = policy.authorized(artifacts.filter("index_status = 'Indexed'"), auth).select("artifact_id", "path")
    cited = policy.authorized(evidence, auth).filter(_clean("excerpt")).select("evidence_id")
    clean = chunks.filter(_clean("body")).withColumn("evidence_id", text.evidence_id(F.col("artifact_id"), F.col("ord")))
    return clean.join(mine, "artifact_id").join(cited, "evidence_id")


def eligible_cards(cards: DataFrame, artifacts: DataFrame, chunks: DataFrame, evidence: DataFrame, auth: policy.Authorization) -> DataFrame:
    """Cards ``(card_id, artifact_id, node, card_body)`` with security columns that may be scored: the card may be read and
    its body is clean, and of the chunks at its node the first by order and id may be scored."""
    first = chunks.groupBy("artifact_id", "node").agg(F.min(F.struct("ord", "chunk_id")).alias("at"))
    at_node = chunks.join(first.select("artifact_id", "node", "at.ord", "at.chunk_id"), ["artifact_id", "node", "ord", "chunk_id"], "left_semi")
    fine = policy.authorized(cards, auth).filter(_clean("card_body")).select("card_id", "artifact_id", "node")
    return fine.join(eligible_chunks(artifacts, at_node, evidence, auth), ["artifact_id", "node"])


def candidates(hits: DataFrame, artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates of ``hits (artifact_id, node, evidence_id, start_line, end_line)`` with their ``problem``, null if fine.

    The version is the artifact's content hash, the place that of the evidence's kind: a
    file's lines, a page, a region, or a symbol. Trust and freshness begin as unknown. A hit
    without its artifact or evidence is dropped.
    """
    own = evidence.select("evidence_id", F.col("artifact_id").alias("owner"), "kind", "path", "page")
    met = hits.join(artifacts.select("artifact_id", "content_hash"), "artifact_id").join(own, "evidence_id")
    paged = F.col("start_line").isNull()
    place = (
        F.when(F.col("kind") == "FileSpan", F.concat_ws(":", F.lit("file"), "path", "start_line", "end_line"))
        .when(F.col("kind").isin("PdfSpan", "PdfRegion"), F.concat_ws(":", F.lit("page"), F.col("page").cast("string")))
        .when(F.col("kind") == "WebSnapshot", F.concat_ws(":", F.lit("symbol"), "path", F.lit("web_snapshot")))
        .otherwise(F.concat(F.lit("symbol:evidence:"), F.col("evidence_id").cast("string")))
    )
    problem = F.when(F.col("owner") != F.col("artifact_id"), "foreign evidence").when((F.col("kind") == "FileSpan") & paged, "span").when(F.col("content_hash").isNull(), "no version")
    return met.select("evidence_id", "artifact_id", "node", "content_hash", place.alias("location"), F.lit("Unverified").alias("trust"), F.lit("Unknown").alias("freshness"), problem.alias("problem"))


def lineage_broken(seeds: DataFrame, expanded: DataFrame, keys: list[str]) -> DataFrame:
    """Seeds that an expansion lost or changed: it may only add."""
    return seeds.join(expanded.select(*keys).distinct(), keys, "left_anti")


def of_model(vectors: DataFrame, dimension: int, **identity: str) -> DataFrame:
    """Vectors of a dimension whose identity columns (provider, model, version, generation, representation, fingerprint)
    are those that are asked for; others may be anything."""
    rows = vectors.filter(F.col("dimension") == dimension)
    for name, value in identity.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def within_budget(expanded: DataFrame, max_candidates: int, max_bytes: int) -> DataFrame:
    """Expansion candidates (``query_id, ord, bytes, is_seed``) whose running use stays in budget; seeds are free."""
    before = Window.partitionBy("query_id").orderBy("ord").rangeBetween(Window.unboundedPreceding, 0)  # equal places stand or fall together
    cost = F.when(F.col("is_seed"), 0).otherwise(1)
    rows = expanded.withColumn("used", F.sum(cost).over(before)).withColumn("read", F.sum(F.when(F.col("is_seed"), 0).otherwise(F.col("bytes"))).over(before))
    return rows.filter(F.col("is_seed") | ((F.col("used") <= max_candidates) & (F.col("read") <= max_bytes)))


def incomplete_observations(cases: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, route) pairs that were asked for and not observed."""
    return cases.join(observed.select("case_id", "route").distinct(), ["case_id", "route"], "left_anti")


# Bounds of what one realm may read of another.
FEDERATED_RESULTS, FEDERATED_BYTES = (1, 100), (1, 65_536)


def federated_read(provider: Column, consumer: Column, operation: Column) -> Column:
    """Why a grant (``provider, consumer, state, access, max_results, max_bytes``) doesn't cover a read, or Allowed."""
    c = F.col
    bounds = c("max_results").between(*FEDERATED_RESULTS) & c("max_bytes").between(*FEDERATED_BYTES)
    return (
        F.when(c("provider") != provider, "ProviderRealmMismatch")
        .when(c("consumer") != consumer, "ConsumerRealmMismatch")
        .when(c("state") != "Active", "GrantRevoked")
        .when((operation == "OpenEvidence") & (c("access") != "SearchAndOpenEvidence"), "UnsupportedAccess")
        .when(~bounds, "InvalidBounds")
        .otherwise("Allowed")
    )


def federated_results(evidence: DataFrame) -> DataFrame:
    """Evidence ``(grant_id, rank, bytes, sensitivity_level, max_results, max_bytes, ceiling_level)`` that a grant lets
    out: at or below its sensitivity ceiling, then the first results and no evidence above its bytes."""
    fine = evidence.filter(F.col("sensitivity_level") <= F.col("ceiling_level")).filter(F.col("bytes") <= F.col("max_bytes"))
    nth = F.row_number().over(Window.partitionBy("grant_id").orderBy("rank"))
    return fine.withColumn("nth", nth).filter(F.col("nth") <= F.col("max_results"))


_MOST = (1 << 63) - 1


def usage(rows: DataFrame, key: str, resources: list[str]) -> DataFrame:
    """What executions used by ``key``: sums that stop at the largest number instead of overflowing."""
    return rows.groupBy(key).agg(*[F.least(F.sum(F.col(r).cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long").alias(r) for r in resources])


def compared(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Two recorded searches side by side: ``key``, each column of both, and whether they are equal."""
    a, b = left.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]), right.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    same = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns]
    equal = same[0]
    for s in same[1:]:
        equal = equal & s
    return a.join(b, key, "full_outer").withColumn("equal", equal)


def advanced_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counter upsert ``name, next_id``: the larger of both."""
    joined = old.withColumnRenamed("next_id", "o").join(new.withColumnRenamed("next_id", "n"), "name", "full_outer")
    return joined.select("name", F.greatest(F.coalesce("o", "n"), F.coalesce("n", "o")).alias("next_id"))


def specialised_wins(metrics: DataFrame, baseline: str, challenger: str, material: int = 500) -> DataFrame:
    """Stricter gate over ``route, recall, chain, outcome, abstention, citation, p95, memory, disk``: some quality
    rises materially, nothing else is worse."""
    of = lambda route, c: F.max(F.when(F.col("route") == route, F.col(c)))
    names = ("recall", "chain", "outcome", "abstention", "citation", "p95", "memory", "disk")
    both = metrics.agg(*[of(r, c).alias(f"{p}_{c}") for p, r in (("a", baseline), ("b", challenger)) for c in names])
    gain = F.lit(False)
    for c in ("recall", "chain", "outcome"):
        gain = gain | (F.col(f"b_{c}") >= F.col(f"a_{c}") + material)
    safe = F.lit(True)
    for c in ("abstention", "citation"):
        safe = safe & (F.col(f"b_{c}") >= F.col(f"a_{c}"))
    for c in ("p95", "memory", "disk"):
        safe = safe & (F.col(f"b_{c}") <= F.col(f"a_{c}"))
    return both.select(F.coalesce(gain & safe, F.lit(False)).alias("wins"))
