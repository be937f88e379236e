"""Query classifiers and deterministic rewrites as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import injection_risk

# Intents in order of precedence with their terms.
INTENT_TERMS = [
    ("ExactLookup", ["id:", "::", ".rs", "cargo.toml", "path:"]),
    ("ContradictionAudit", ["contradict", "conflict", "disagree", "counterevidence"]),
    ("CurrentWeb", ["latest", "today", "current", "web", "news", "http"]),
    ("VisualDocument", ["table", "chart", "figure", "image", "visual", "pdf", "formula", "equation", "diagram", "scan", "ocr"]),
    ("RepositoryCode", ["rust", "cargo", "function", "struct", "trait", "module", "repository"]),
    ("TemporalMemory", ["when", "before", "after", "history", "previous", "last"]),
    ("MultiHop", ["how does", "relationship", "connected", "multi-hop"]),
    ("CorpusSynthesis", ["summarize", "summary", "overview", "across", "compare", "synthesis"]),
    ("CompositionalConstraints", ["must", "without", "requires", "constraint"]),
    ("SemanticDiscovery", ["similar", "related", "discover", "explore"]),
]

# Repository question classes in order of precedence with their phrases.
REPOSITORY_PHRASES = [
    ("StaleWorktree", ["stale", "worktree", "out of date"]),
    ("CorrectAbstention", ["don't know", "unknown", "not in the repository", "abstain"]),
    ("IssueToFile", ["issue #", "issue "]),
    ("TestAssociation", ["test", "tested by"]),
    ("MultiHopDependency", ["depends on", "dependency", "call chain"]),
    ("ReferenceUsage", ["used by", "callers of", "where is", "usages of"]),
    ("DefinitionReference", ["definition", "references", "reference"]),
    ("DocComment", ["doc comment", "docs for", "documented"]),
    ("CodeMarker", ["todo", "fixme", "unsafe block", "marker"]),
    ("ExactSymbol", ["symbol", "struct ", "function ", "fn ", "::"]),
]

# Visual question classes in order of precedence with their words.
VISUAL_WORDS = [
    ("ScannedPage", ["scanned", "scan", "ocr"]),
    ("Formula", ["formula", "equation", "mathematical"]),
    ("Table", ["table"]),
    ("Chart", ["chart", "graph"]),
    ("Figure", ["figure", "diagram"]),
]

# Rewrites as (text that must occur, text that must not, from, to).
REWRITES = [
    ("PR", None, "PR", "Pull Request"),
    ("DB", None, "DB", "Database"),
    ("-", None, "-", "_"),
    ("src/", None, "src/", "crates/"),
    ("test", "tests/", "test", "tests/"),
    ("fn ", None, "fn ", "function "),
    ("impl ", None, "impl ", "implementation "),
    ("module", None, "module", "mod"),
]
VERSION_REWRITES = [("v1.", "version 1."), ("v2.", "version 2.")]


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _has(query: Column, terms: list[str]) -> Column:
    """Words match by the beginning of a token, other terms anywhere."""
    words = [t for t in terms if t.replace("_", "").isalnum()]
    others = [t for t in terms if t not in words]
    found = F.lit(False)
    if words:
        found = found | query.rlike(f"(?:^|[^a-z0-9_])(?:{'|'.join(words)})")
    for t in others:
        found = found | query.contains(t)
    return found


def intent(text: Column) -> Column:
    query = _ascii_lower(F.trim(text))
    one_word = F.size(F.filter(F.split(query, r"\s+"), lambda x: x != "")) == 1
    exact = (query == "") | (query.startswith('"') & query.endswith('"')) | (one_word & query.contains("-") & query.rlike("[a-z0-9]"))
    found = F.when(exact | _has(query, INTENT_TERMS[0][1]), "ExactLookup")
    for name, terms in INTENT_TERMS[1:]:
        condition = _has(query, terms)
        if name == "CompositionalConstraints":
            condition = condition | (query.contains(" and ") & query.contains(" where "))
        found = found.when(condition, name)
    return found.otherwise("FactualLocal")


def query_class(text: Column) -> Column:
    """Class that decides whether the sparse lane serves a query."""
    kind = intent(text)
    return (
        F.when(injection_risk(text), "Security")
        .when(kind == "ExactLookup", "ExactLiteral")
        .when(kind == "SemanticDiscovery", "VocabularyExpansion")
        .when(kind == "CompositionalConstraints", "MultiTerm")
        .otherwise("DomainTerminology")
    )


def repository_class(text: Column) -> Column:
    query, found = _ascii_lower(text), None
    for name, phrases in REPOSITORY_PHRASES:
        condition = F.lit(False)
        for p in phrases:
            condition = condition | query.contains(p)
        found = F.when(condition, name) if found is None else found.when(condition, name)
    return found


def visual_class(text: Column) -> Column:
    words = F.split(_ascii_lower(text), "[^a-z0-9]+")

    def any_of(*names: str) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))

    found = None
    for name, terms in VISUAL_WORDS:
        found = F.when(any_of(*terms), name) if found is None else found.when(any_of(*terms), name)
    return found.when(any_of("pdf", "page", "document") & any_of("text", "paragraph"), "Text")


def rewrites(text: Column) -> Column:
    """Deterministic variants of a query in a fixed order, without the query itself."""
    made = []
    for must, never, old, new in REWRITES:
        condition = text.contains(must)
        if never:
            condition = condition & ~text.contains(never)
        made.append(F.when(condition, F.replace(text, F.lit(old), F.lit(new))))
    made.append(F.when(text.rlike("^[^#]*#[0-9]"), F.replace(text, F.lit("#"), F.lit("Issue "))))
    made += [F.when(text.contains(old), F.replace(text, F.lit(old), F.lit(new))) for old, new in VERSION_REWRITES]
    dates = F.filter(F.split(text, r"\s+"), lambda x: x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    dated = F.transform(dates, lambda d: F.replace(text, d, F.concat(F.lit("date "), d)))
    return F.concat(F.array_compact(F.array(*made)), dated)
