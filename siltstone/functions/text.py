"""Column functions over text: tokens, identities, normalisers, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stride of identities and the offsets of cards and evidence in it.
STRIDE, CARD_OFFSET, EVIDENCE_OFFSET = 1_000_003, 900_001, 500_001


def tokens(text: Column) -> Column:
    """Lower-case Unicode letter and digit runs."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_estimate(text: Column) -> Column:
    """Whitespace words, at least one."""
    return F.greatest(F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")), F.lit(1))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def version_id(text: Column) -> Column:
    """First 64 bits of the SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def chunk_id(artifact: Column, order: Column) -> Column:
    return artifact * STRIDE + order + 1


def card_id(artifact: Column) -> Column:
    return artifact * STRIDE + CARD_OFFSET


def evidence_id(artifact: Column, order: Column) -> Column:
    return artifact * STRIDE + order + EVIDENCE_OFFSET


def excerpt(text: Column, most: int = 240) -> Column:
    """Whitespace-joined words up to ``most`` characters, never cutting one."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(acc: Column, word: Column) -> Column:
        longer = F.when(acc.s == "", word).otherwise(F.concat(acc.s, F.lit(" "), word))
        stop = acc.full | (F.length(longer) > most)
        return F.struct(F.when(stop, acc.s).otherwise(longer).alias("s"), stop.alias("full"))

    return F.aggregate(words, start, add, lambda acc: acc.s)


def prompt_text(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs joined by one space."""
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


# Canonical prompt-injection phrases.
INJECTION_PHRASES = [
    "ignore previous instructions",
    "ignore all instructions",
    "reveal system prompt",
    "reveal secrets",
    "disable safety",
    "approve this action",
    "disregard prior instructions",
    "override previous instructions",
    "ignore prior commands",
    "skip previous directions",
    "do not follow instructions",
    "bypass all restrictions",
    "forget prior constraints",
]


def injection_risk(text: Column) -> Column:
    return prompt_text(text).rlike("|".join(INJECTION_PHRASES))


#: Own patterns for credentials; categories only are published, so this claims no parity.
SECRET_PATTERNS = [
    r"AKIA[0-9A-Z]{16}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"(?i)(?:password|passwd|secret|api[_-]?key|token)\s*[:=]\s*\S{8,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
]


def has_secret(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in SECRET_PATTERNS)), F.lit(False))


def payload(**fields: Column) -> Column:
    """An event's payload as JSON; fields that are null are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def human_bytes(n: Column) -> Column:
    """Whole MiB or KiB where it divides, else bytes."""
    mib, kib = 1 << 20, 1 << 10
    return (
        F.when((n >= mib) & (n % mib == 0), F.concat((n / mib).cast("long").cast("string"), F.lit("MiB")))
        .when((n >= kib) & (n % kib == 0), F.concat((n / kib).cast("long").cast("string"), F.lit("KiB")))
        .otherwise(F.concat(n.cast("string"), F.lit("B")))
    )


def human_size(n: Column) -> Column:
    """Bytes in binary units with one decimal, from KiB to GiB."""
    found = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30)):
        found = F.when(n >= size, F.format_string(f"%.1f {unit}", n / F.lit(float(size)))).otherwise(found)
    return found


def human_duration(seconds: Column) -> Column:
    """Whole seconds as ``h:mm:ss``, or ``m:ss`` below an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def one_line(text: Column) -> Column:
    """Words joined by one space: a snippet for display."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def marker_kind(comment: Column) -> Column:
    """TODO, FIXME or HACK that opens a comment's text, else null."""
    found = F.regexp_extract(comment, r"^[!*]?\s*(TODO|FIXME|HACK)(?:[\s(\[:]|$)", 1)
    return F.when(found != "", F.lower(found))


def plausible_commit(ref: Column) -> Column:
    """Seven to forty hexadecimal digits, or HEAD with at most one ``~`` or ``^`` and its number."""
    return ref.rlike(r"\A(?:[0-9A-Fa-f]{7,40}|HEAD(?:[~^][0-9]*)?)\z")


def milli(score: Column) -> Column:
    return F.round(score * 1000).cast("long")


def micros(similarity: Column) -> Column:
    """Finite and positive: floor of the similarity, at most 1, times a million; else 0."""
    fine = (similarity > 0) & ~F.isnan(similarity) & (similarity != float("inf"))
    return F.when(fine, F.floor(F.least(similarity, F.lit(1.0)) * 1_000_000)).otherwise(0).cast("long")


def section_identity(version: Column, node: Column, path: Column, first_line: Column, last_line: Column) -> Column:
    artifact = F.concat(F.lit("artifact:"), version.cast("string"))
    lines = F.concat_ws(":", F.lit("file"), path, first_line.cast("string"), last_line.cast("string"))
    return F.when(node.isNotNull(), F.concat(artifact, F.lit(":node:"), node.cast("string"))).otherwise(F.concat(artifact, F.lit(":"), lines))


def lane_allowance(total: int, lanes: int, lane: int) -> int:
    """A lane's part of a budget; the first lanes take the remainder."""
    return total // lanes + (lane < total % lanes)
