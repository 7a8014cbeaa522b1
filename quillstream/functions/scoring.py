"""Scores: relevance of engagements, recency, blended ranks, cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
WEIGHTS = {
    "oral_evidence_committee": 4.0, "government_review_role": 3.5, "ministerial_meeting": 3.0, "appg_secretariat": 2.5, "advisory_group_member": 2.5, "expert_panel_member": 2.5, "appg_officer": 2.0, "cited_in_parliamentary_record": 1.5,
    "consultation_response": 1.0, "written_evidence_committee": 1.0, "lobbying_register": 0.5,
}
CITED_BONUS, HALF_LIFE_DAYS, POLICY_FACTOR, DEPARTMENT_FACTOR = 1.5, 1825, 2.0, 1.5


def weight(source_type: Column, changes: dict[str, float] | None = None) -> Column:
    """A source type's weight, 0 for others. A change to an unknown type is an error."""
    unknown = set(changes or {}) - set(WEIGHTS)
    if unknown:
        raise ValueError(f"unknown source types: {sorted(unknown)}")
    table = F.create_map(*(F.lit(x) for kv in (WEIGHTS | (changes or {})).items() for x in kv))
    return F.coalesce(table[source_type], F.lit(0.0))


def halved(days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """F54."""
    return F.pow(F.lit(0.5), F.greatest(days, F.lit(0)) / F.lit(half_life))


def engagement_score(source_type: Column, date: Column, cited: Column, policy: Column, department: Column, as_of: Column, wanted_policy: str | None, wanted_department: str | None, changes: dict[str, float] | None = None) -> Column:
    """RS: weight, recency, citation and matches of one engagement."""
    factor = lambda c, wanted, f: F.when(F.coalesce(c == wanted, F.lit(False)), F.lit(f)).otherwise(F.lit(1.0)) if wanted else F.lit(1.0)
    return weight(source_type, changes) * halved(F.datediff(as_of, date)) * F.when(cited, F.lit(1 + CITED_BONUS)).otherwise(F.lit(1.0)) * factor(policy, wanted_policy, POLICY_FACTOR) * factor(department, wanted_department, DEPARTMENT_FACTOR)


def recency(age_days: Column) -> Column:
    """F51."""
    return F.lit(1.0) / (F.lit(1.0) + age_days / F.lit(45.0))


def engagement_level(n: Column) -> Column:
    """F52."""
    return F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(F.lit(100.0)))


def breadth(n: Column) -> Column:
    """F53."""
    return F.least(F.lit(1.0), n / F.lit(3.0))


def blended(relevance: Column, age_days: Column, engagement: Column, areas: Column) -> Column:
    """RK."""
    return 0.40 * relevance + 0.35 * recency(age_days) + 0.15 * engagement_level(engagement) + 0.10 * breadth(areas)


def explanation(weight_: Column, days: Column, cited: Column, policy: Column, department: Column, score: Column) -> Column:
    """a sentence that names the factors in force."""
    clauses = F.concat_ws(", ", F.format_string("weight %.2f", weight_), F.when(days > 0, F.format_string("recency %.2f", halved(days))), F.when(cited, "cited in outcome"), F.when(policy, "policy area match"), F.when(department, "department match"))
    return F.concat(F.upper(F.left(clauses, F.lit(1))), F.substring(clauses, 2, 1000), F.format_string(": %.2f", score))


def cosine(a: Column, b: Column) -> Column:
    """F32."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
