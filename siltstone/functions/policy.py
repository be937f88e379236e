"""Security predicates as column expressions: authorization, scopes, taint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Security enums, each from best to worst.
TRUST_ZONES = ["System", "Verified", "Untrusted", "Quarantined"]
AUTHORITIES = ["System", "User", "Agent", "External"]
INTEGRITY = ["Verified", "Unverified", "Compromised"]
SENSITIVITY = ["Public", "Internal", "Confidential", "Restricted"]
REVIEW = ["Approved", "Unreviewed", "Pending", "Rejected"]


def level(value: Column, order: list[str]) -> Column:
    """Place of a name in its enum."""
    found = F.when(value == order[0], 0)
    for i, name in enumerate(order[1:], 1):
        found = found.when(value == name, i)
    return found


def name_of(place: Column, order: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), (place + 1).cast("int"))


@dataclass(frozen=True)
class Authorization:
    """What a request may read; the fields' order is the order of the rules."""

    require_read_allowed: bool = True
    allow_quarantined: bool = False
    trust_zone: str | None = None
    max_sensitivity: str | None = None
    scopes: tuple[int, ...] | None = None
    allow_unscoped: bool = True
    allow_prompt_injection: bool = False


def quarantined(trust_zone: Column) -> Column:
    """The trust zone alone decides."""
    return trust_zone == "Quarantined"


def retrieval_allowed(read_allowed: Column, trust_zone: Column, review_status: Column, integrity: Column) -> Column:
    return read_allowed & ~quarantined(trust_zone) & (review_status != "Rejected") & (integrity != "Compromised")


def _own(trust_zone: Column, authority: Column) -> Column:
    return ~trust_zone.isin("Untrusted", "Quarantined") & (authority != "External")


def promotion_allowed(c: dict[str, Column]) -> Column:
    """Whether what rests on a row of security columns may become a memory."""
    fine = retrieval_allowed(c["read_allowed"], c["trust_zone"], c["review_status"], c["integrity"])
    return fine & _own(c["trust_zone"], c["authority"]) & ~c["prompt_injection_risk"] & (F.size(c["poisoning_flags"]) == 0)


def action_authorized(c: dict[str, Column]) -> Column:
    """Whether a row of security columns may be acted on."""
    return _own(c["trust_zone"], c["authority"]) & c["write_allowed"] & retrieval_allowed(c["read_allowed"], c["trust_zone"], c["review_status"], c["integrity"])


def ceiling(*levels: Column) -> Column:
    """The lowest of sensitivity ceilings; null ones don't restrict."""
    return name_of(F.least(*[level(x, SENSITIVITY) for x in levels]), SENSITIVITY)


def denial(auth: Authorization, prefix: str = "") -> Column:
    """The first rule that denies a row of security columns, or null if it may be read.

    Fixed values: the messages are part of what is published.
    """
    c = {n: F.col(prefix + n) for n in ("read_allowed", "trust_zone", "review_status", "integrity", "sensitivity", "scope_id", "prompt_injection_risk", "poisoning_flags")}
    rules: list[tuple[Column, Column]] = []
    if auth.require_read_allowed:
        rules.append((~c["read_allowed"], F.lit("Read not allowed by ACL")))
    if not auth.allow_quarantined:
        rules.append((quarantined(c["trust_zone"]), F.lit("Item is quarantined or rejected")))
    rules.append(((c["review_status"] == "Rejected") | (c["integrity"] == "Compromised"), F.lit("Item is quarantined or rejected")))
    if auth.trust_zone:
        rules.append((c["trust_zone"] != auth.trust_zone, F.concat(F.lit(f"Trust zone mismatch: expected {auth.trust_zone}, found "), c["trust_zone"])))
    if auth.max_sensitivity:
        rules.append((level(c["sensitivity"], SENSITIVITY) > SENSITIVITY.index(auth.max_sensitivity), F.concat(F.lit("Sensitivity too high: "), c["sensitivity"])))
    if auth.scopes is not None:
        outside = c["scope_id"].isNotNull() & ~c["scope_id"].isin(*auth.scopes) if auth.scopes else c["scope_id"].isNotNull()
        rules.append((outside, F.concat(F.lit("Scope mismatch: item scope "), c["scope_id"].cast("string"), F.lit(" is outside request scope"))))
        if not auth.allow_unscoped:
            rules.append((c["scope_id"].isNull(), F.lit("Item has no scope_id")))
    if not auth.allow_prompt_injection:
        rules.append((c["prompt_injection_risk"], F.lit("Prompt injection risk detected")))
    rules.append((F.size(c["poisoning_flags"]) > 0, F.lit("Poisoning flags detected")))
    found = F.when(*rules[0])
    for condition, reason in rules[1:]:
        found = found.when(condition, reason)
    return found


def authorized(df: DataFrame, auth: Authorization) -> DataFrame:
    """Rows that may be read. Authored as the first filter of every lane: nothing denied is ever scored."""
    return df.filter(denial(auth).isNull())


def effective_scopes(*sets: Column) -> Column:
    """Intersection of scope sets, of which null ones don't restrict; empty: denied."""
    out = sets[0]
    for s in sets[1:]:
        out = F.when(out.isNull(), s).when(s.isNull(), out).otherwise(F.array_intersect(out, s))
    return F.array_sort(out)


def taint(df: DataFrame, *keys: str) -> DataFrame:
    """Worst-case merge of security columns by key: maximum of each enum, union of flags, AND of permissions;
    the scope stays where all rows that have one agree."""
    worst = [name_of(F.max(level(F.col(c), order)), order).alias(c) for c, order in (("trust_zone", TRUST_ZONES), ("authority", AUTHORITIES), ("integrity", INTEGRITY), ("sensitivity", SENSITIVITY), ("review_status", REVIEW))]
    one_scope = F.min("scope_id") == F.max("scope_id")
    return df.groupBy(*keys).agg(
        *worst,
        F.bool_and("read_allowed").alias("read_allowed"),
        F.bool_and("write_allowed").alias("write_allowed"),
        F.bool_or("prompt_injection_risk").alias("prompt_injection_risk"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("poisoning_flags")))).alias("poisoning_flags"),
        F.when(one_scope, F.max("scope_id")).alias("scope_id"),
    )
