"""Expressions over model output: entropy, review classes, scores, weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from landshift.config import REVIEW, ReviewThresholds


def predictive_entropy(probs: Column, n_classes: int) -> Column:
    """Normalised entropy of the positive classes; the array holds class 1..n."""
    total = F.aggregate(
        probs,
        F.lit(0.0),
        lambda acc, p: acc + F.least(F.greatest(p, F.lit(1e-7)), F.lit(1.0))
        * F.ln(F.least(F.greatest(p, F.lit(1e-7)), F.lit(1.0))),
    )
    return -total / F.lit(math.log(n_classes))


def histogram_entropy(counts: Column) -> Column:
    """Entropy of an array of counts over its non-zero entries, in [0, 1]."""
    used = F.filter(counts, lambda c: c > 0)
    total = F.aggregate(used, F.lit(0.0), lambda acc, c: acc + c)
    raw = F.aggregate(used, F.lit(0.0), lambda acc, c: acc - (c / total) * F.ln(c / total))
    return F.when(F.size(used) > 1, raw / F.ln(F.size(used).cast("double"))).otherwise(F.lit(0.0))


def dominant_entry(hist: Column) -> Column:
    """struct(class_id, count) of the largest bucket of a map, lowest id on ties."""
    ranked = F.transform(
        F.map_entries(hist),
        lambda e: F.struct(e["value"].alias("count"), (-e["key"]).alias("neg_id")),
    )
    best = F.array_max(ranked)
    return F.struct(
        F.coalesce(-best["neg_id"], F.lit(0)).alias("class_id"),
        F.coalesce(best["count"], F.lit(0)).alias("count"),
    )


def review_zone(confidence: Column, entropy: Column, disagreement: Column,
                t: ReviewThresholds = REVIEW) -> Column:
    """Later rules win: 3 disagreement, 2 high entropy, 1 low confidence."""
    return (
        F.when(confidence.isNull(), 0)
        .when(disagreement, 3)
        .when(entropy >= t.high_entropy, 2)
        .when(confidence < t.low_confidence, 1)
        .otherwise(0)
    )


def review_priority(weak_fraction: Column, anomaly: Column, t: ReviewThresholds = REVIEW) -> Column:
    return (
        F.when(anomaly >= t.high_anomaly, "high_anomaly")
        .when(weak_fraction < t.weak_support, "weak_support_review")
        .otherwise("embedding_supported")
    )


def review_score(weak_fraction: Column, anomaly: Column, priority: Column) -> Column:
    weight = (
        F.when(priority == "high_anomaly", 1.0)
        .when(priority == "weak_support_review", 0.75)
        .when(priority == "embedding_supported", 0.15)
        .otherwise(0.25)
    )
    gap = F.greatest(F.lit(0.0), 1.0 - weak_fraction)
    return F.lit(0.5) * anomaly + F.lit(0.35) * gap + F.lit(0.15) * weight


def sampling_role(priority: Column) -> Column:
    return F.when(priority == "embedding_supported", "control_after_review").otherwise("candidate_review")


def risk_level(value: Column, low: float, high: float, inverse: bool = False) -> Column:
    if inverse:
        return F.when(value >= high, "low").when(value >= low, "moderate").otherwise("high")
    return F.when(value <= low, "low").when(value <= high, "moderate").otherwise("high")


def fraction(num: Column, den: Column, default: float | None = None) -> Column:
    out = F.when(den != 0, num / den)
    return out if default is None else F.coalesce(out, F.lit(default))


def effective_number_weight(count: Column, beta: float) -> Column:
    return F.when(count > 0, F.lit(1.0 - beta) / (F.lit(1.0) - F.pow(F.lit(beta), count))).otherwise(0.0)
