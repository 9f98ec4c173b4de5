"""Scores, thresholds and small numeric formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark.functions import fixed as X


def ladder(value: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """The label of the first threshold that the value reaches (PR-16)."""
    out = F.when(value >= steps[0][0], F.lit(steps[0][1]))
    for bound, label in steps[1:]:
        out = out.when(value >= bound, F.lit(label))
    return out.otherwise(F.lit(default))


def decision(score: Column) -> Column:
    return ladder(score, X.DECISIONS, "IGNORE")


def risk_level(score: Column) -> Column:
    return ladder(score, X.RISK_LEVELS, "LOW")


def attribution_strength(probability: Column) -> Column:
    return ladder(probability, X.ATTRIBUTION_STRENGTHS, "INSUFFICIENT")


def case_severity(urgency: Column, confidence: Column, deepfake: Column) -> Column:
    """PR-16d."""
    return (
        F.when((urgency == "CRITICAL") | (deepfake > 0.8), "CRITICAL")
        .when((urgency == "HIGH") | (confidence > 0.85) | (deepfake > 0.65), "HIGH")
        .when((confidence > 0.5) | (deepfake > 0.3), "MEDIUM")
        .otherwise("LOW")
    )


def expansion_alert(new_channels: Column, risk: Column) -> Column:
    """PR-16e."""
    return (
        F.when((new_channels >= 5) | (risk >= 85), "EMERGENCY")
        .when((new_channels >= 3) | (risk >= 70), "CRITICAL")
        .when((new_channels >= 1) | (risk >= 50), "WARNING")
        .otherwise("WATCH")
    )


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def four_places(x: Column) -> Column:
    """``round(x, 4)``, bit for bit; shares from 0 to 1 that are no near ties are rounded without decimals, many times faster."""
    y = x * 10_000
    clear = (x >= 0) & (x <= 1) & (F.abs(y - F.floor(y) - 0.5) > 1e-6)
    return F.when(clear, F.floor(y + 0.5) / 10_000).otherwise(F.round(x, 4))


def confidence_interval(log_odds: Column, n_evidence: Column, z: float = 1.645) -> tuple[Column, Column]:
    """90 % interval of the probability from the logistic deviation (SF-32)."""
    deviation = math.pi / (math.sqrt(3) * F.greatest(F.sqrt(n_evidence), F.lit(1.0)))
    return four_places(sigmoid(log_odds - z * deviation)), four_places(sigmoid(log_odds + z * deviation))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays, 0 if both are empty (SE-4)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 for a zero norm or unequal lengths (SF-30)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 1e-20), dot / size).otherwise(F.lit(0.0))


def decay(hours: Column) -> Column:
    """exp(-|h| / 48); 0 for null (SF-31)."""
    return F.coalesce(F.exp(-F.abs(hours) / X.DECAY_HOURS), F.lit(0.0))


def entropy(parts: Column) -> Column:
    """Normalised Shannon entropy of an array of counts or shares, 4 places; n counts empty bins (AG-40)."""
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    summed = F.aggregate(
        parts, F.lit(0.0), lambda s, x: s - F.when(x > 0, (x / total) * F.log2(x / total)).otherwise(F.lit(0.0))
    )
    return F.when((F.size(parts) > 1) & (total > 0), F.round(summed / F.log2(F.size(parts).cast("double")), 4)).otherwise(F.lit(0.0))


def campaign_risk(posts: Column, entities: Column, platforms: Column, reach: Column) -> Column:
    """AG-24."""
    parts = F.least(F.lit(40), posts * 3) + F.least(F.lit(30), entities * 5) + F.least(F.lit(20), platforms * 7)
    return F.round(F.least(F.lit(100.0), parts + F.least(F.lit(10.0), reach / 10_000)), 1)


def graph_risk(level: Column, channels: Column, phones: Column, upis: Column, victims: Column) -> Column:
    """GR-6."""
    base = F.when(level == "CRITICAL", 85.0).when(level == "HIGH", 65.0).when(level == "MEDIUM", 40.0).otherwise(20.0)
    parts = (
        base + F.least(F.lit(20.0), channels * 2.0) + F.least(F.lit(10.0), phones * 1.5) + F.least(F.lit(10.0), upis * 2.0)
        + F.least(F.lit(15.0), F.log1p(victims.cast("double")))
    )
    return F.round(F.least(F.lit(100.0), parts), 2)


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1) (SF-50)."""
    return a / F.greatest(b, F.lit(1))
