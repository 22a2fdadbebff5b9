"""Short ordered lookups used across jobs: statuses, severities, scores, keyword classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names whose change matters most when two versions are compared.
HIGH_IMPACT_FIELDS = ["site_address", "proposed_use", "building_height", "floor_area", "num_storeys", "application_type"]
MEDIUM_IMPACT_FIELDS = ["postcode", "applicant_name", "agent_name", "description"]

# Impact level scores and severity order.
IMPACT_SCORES = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2}
SEVERITY_ORDER = ["debug", "info", "warning", "error", "critical"]


def first_match(col: Column, pairs: Sequence[tuple[str, str]], default: str | None) -> Column:
    """Class of the first keyword contained in ``col`` (case as given)."""
    result = F.lit(default)
    for keyword, label in reversed(pairs):
        result = F.when(col.contains(keyword), F.lit(label)).otherwise(result)
    return result


def contains_any(col: Column, words: Sequence[str]) -> Column:
    result = F.lit(False)
    for word in words:
        result = result | col.contains(word)
    return result


def normalise_status(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit(""))))


def is_issue(status: Column) -> Column:
    return ~normalise_status(status).isin("pass", "passed")


def impact_score(level: Column) -> Column:
    score = F.lit(IMPACT_SCORES["low"])
    for name, value in IMPACT_SCORES.items():
        score = F.when(level == name, F.lit(value)).otherwise(score)
    return score


def severity_at_least(severity: Column, floor: str) -> Column:
    order = F.array(*[F.lit(s) for s in SEVERITY_ORDER])
    return F.array_position(order, severity) >= SEVERITY_ORDER.index(floor) + 1


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``part / whole * scale`` with 0.0 where the divisor is zero."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)) * F.lit(scale), F.lit(0.0))


def confidence_label(confidence: Column) -> Column:
    return (
        F.when(confidence.isNull(), "Unknown")
        .when(confidence >= 0.9, "High")
        .when(confidence >= 0.7, "Medium")
        .when(confidence >= 0.5, "Low")
        .otherwise("Very Low")
    )


def kappa_label(kappa: Column) -> Column:
    """Landis and Koch (1977) agreement classes; NaN falls through to the last one."""
    return (
        F.when(F.isnan(kappa), "almost perfect")
        .when(kappa < 0, "poor")
        .when(kappa < 0.2, "slight")
        .when(kappa < 0.4, "fair")
        .when(kappa < 0.6, "moderate")
        .when(kappa < 0.8, "substantial")
        .otherwise("almost perfect")
    )
