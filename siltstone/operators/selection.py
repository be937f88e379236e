"""Diversity selection, coverage and outcome status.

Selection depends on all rows chosen before, so it runs in one ``applyInPandas`` group
per query over a fused list that the plan's candidate budget bounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SELECTED = "query_id string, evidence_id long, original_rank int, placement string, marginal int, stop_reason string, percent_covered int, status string"


@dataclass(frozen=True)
class Requirements:
    minimum_sources: int = 1
    minimum_documents: int = 1
    minimum_sections: int = 1
    minimum_corroboration: int = 1
    required_keys: tuple[str, ...] = field(default=())

    def met(self, covered: set, sources: int, documents: int, sections: int) -> bool:
        enough = sources >= max(self.minimum_sources, self.minimum_corroboration)
        return all(k in covered for k in self.required_keys) and enough and documents >= self.minimum_documents and sections >= self.minimum_sections


def percent_covered(matched: Column, required: Column, found: Column) -> Column:
    """Integer percent; 0 if nothing was selected, 100 if nothing is required."""
    return F.when(found == 0, 0).when(required == 0, 100).otherwise((matched * 100 / F.greatest(required, F.lit(1))).cast("int"))


def status(selected: Column, all_stale: Column, percent: Column, diverse: Column, unmet: Column) -> Column:
    return (
        F.when(selected == 0, "NoEvidenceFound")
        .when(all_stale, "StaleEvidenceOnly")
        .when(percent < 100, "EvidenceIncomplete")
        .when(~diverse | unmet, "AnswerableWithWarnings")
        .otherwise("Answerable")
    )


def _select(rows: pd.DataFrame, needs: Requirements, max_results: int) -> pd.DataFrame:
    rows = rows.sort_values(["rank", "evidence_id"])
    chosen: list[tuple] = []
    sources, documents, sections, covered, clusters = set(), set(), set(), set(), set()
    stop, stale = None, []
    required = set(needs.required_keys)
    for r in rows.itertuples():
        if max_results and len(stale) >= max_results:
            stop = "ResultsLimit"
            break
        keys = set(r.coverage_keys) if r.coverage_keys is not None else set()
        if pd.notna(r.dup_cluster) and r.dup_cluster in clusters:
            chosen.append((r.evidence_id, r.rank, "Duplicate", 0))
            continue
        gain = (r.source not in sources) + (r.document not in documents) + (r.section not in sections) + len((keys & required) - covered)
        if gain == 0 and needs.met(covered, len(sources), len(documents), len(sections)):
            stop = "LowMarginalGain"  # the scan ends here, it doesn't skip
            break
        sources.add(r.source)
        documents.add(r.document)
        sections.add(r.section)
        covered |= keys
        if pd.notna(r.dup_cluster):
            clusters.add(r.dup_cluster)
        stale.append(r.freshness == "Stale")
        chosen.append((r.evidence_id, r.rank, "Selected", gain))
    n = len(stale)
    met = needs.met(covered, len(sources), len(documents), len(sections))
    stop = stop or ("NoEvidence" if not n else "ResultsLimit" if max_results and n >= max_results else "EvidenceComplete" if met else "RequirementsUnmet")
    matched = sum(k in covered for k in needs.required_keys)
    percent = 0 if not n else 100 if not needs.required_keys else matched * 100 // len(needs.required_keys)
    diverse = len(sources) >= max(needs.minimum_sources, needs.minimum_corroboration) and len(documents) >= needs.minimum_documents and len(sections) >= needs.minimum_sections
    end = "NoEvidenceFound" if not n else "StaleEvidenceOnly" if all(stale) else "EvidenceIncomplete" if percent < 100 else "AnswerableWithWarnings" if not diverse or stop == "RequirementsUnmet" else "Answerable"
    return pd.DataFrame(
        [(rows.query_id.iloc[0], e, int(k), p, int(m), stop, int(percent), end) for e, k, p, m in chosen],
        columns=["query_id", "evidence_id", "original_rank", "placement", "marginal", "stop_reason", "percent_covered", "status"],
    )


def select(candidates: DataFrame, needs: Requirements = Requirements(), max_results: int = 10, max_candidates: int = 1000) -> DataFrame:
    """Greedy selection per query over ``query_id, rank, evidence_id, dup_cluster, source, document, section,
    freshness, coverage_keys``. ``max_candidates`` is the plan's budget: the feature that bounds a group."""
    inside = candidates.filter(F.col("rank") < max_candidates)
    return inside.groupBy("query_id").applyInPandas(lambda g: _select(g, needs, max_results), SELECTED)
