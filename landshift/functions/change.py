"""Change rules, confidence and land-cover state expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from landshift.config import CHANGE, CHANGE_TYPES, ChangeThresholds
from landshift.functions.bands import all_valid, clip

TRANSITION_MARK = "_to_"


def classify_change(d_ndvi: Column, d_ndbi: Column, d_ndwi: Column, d_ratio: Column,
                    t: ChangeThresholds = CHANGE) -> Column:
    """0 none, 1 vegetation loss, 2 built-up gain, 3 moisture, 4 radar."""
    loss = d_ndvi <= t.ndvi_loss
    return (
        F.when(~all_valid(d_ndvi, d_ndbi, d_ndwi, d_ratio), 0)
        .when(loss & (d_ndbi >= t.ndbi_gain), 2)
        .when(loss, 1)
        .when(F.abs(d_ndwi) >= t.ndwi_abs, 3)
        .when(F.abs(d_ratio) >= t.radar_ratio_abs, 4)
        .otherwise(0)
    )


def change_confidence(change_class: Column, d_ndvi: Column, d_ndbi: Column, d_ndwi: Column,
                      d_ratio: Column, t: ChangeThresholds = CHANGE) -> Column:
    optical = F.greatest(
        F.abs(d_ndvi) / abs(t.ndvi_loss),
        F.abs(d_ndbi) / t.ndbi_gain,
        F.abs(d_ndwi) / t.ndwi_abs,
    )
    radar = F.abs(d_ratio) / t.radar_ratio_abs
    score = F.lit(0.65) * clip(optical, 0.0, 1.0) + F.lit(0.35) * clip(radar, 0.0, 1.0)
    return F.when(change_class > 0, score).otherwise(F.lit(0.0))


def gate(value: Column, confidence: Column, t: ChangeThresholds = CHANGE) -> Column:
    """Value where the confidence reaches the threshold, else a zero of its type."""
    return F.when(confidence >= t.confidence, value).otherwise(0)


def change_type(change_class: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in CHANGE_TYPES.items():
        out = F.when(change_class == code, name).otherwise(out)
    return out


def landcover_state(ndvi: Column, ndbi: Column, ndwi: Column) -> Column:
    return (
        F.when(~all_valid(ndvi, ndbi, ndwi), "unknown")
        .when(ndwi >= 0.2, "water_moisture")
        .when((ndvi >= 0.45) & (ndvi > ndbi), "vegetation")
        .when((ndbi >= 0.12) & (ndbi > ndvi), "built_up")
        .when((ndvi <= 0.2) & (ndbi <= 0.12), "bare_sparse")
        .otherwise("mixed")
    )


def change_magnitude(*deltas: Column) -> Column:
    """Root mean square of the deltas that are present."""
    total, count = F.lit(0.0), F.lit(0)
    for d in deltas:
        total = total + F.coalesce(d * d, F.lit(0.0))
        count = count + F.when(d.isNotNull(), 1).otherwise(0)
    return F.when(count > 0, F.sqrt(total / count))


def monitored_land_cover(kind: Column, before: Column, after: Column) -> Column:
    return (
        F.when(kind == "vegetation_loss", "vegetation")
        .when(kind == "built_up_gain", "built_up")
        .when(kind == "moisture_change", "water_moisture")
        .when(before != "unknown", before)
        .otherwise(after)
    )


def transition_label(before: Column, after: Column) -> Column:
    return F.concat_ws(TRANSITION_MARK, before, after)


def transition_before(label: Column) -> Column:
    return F.when(F.instr(label, TRANSITION_MARK) > 0, F.split(label, TRANSITION_MARK)[0]).otherwise("unknown")


def transition_after(label: Column) -> Column:
    return F.when(F.instr(label, TRANSITION_MARK) > 0, F.split(label, TRANSITION_MARK)[1]).otherwise("unknown")


def penalties(kind: Column, group: Column, before: Column, after: Column) -> list[Column]:
    """Deductions for radar-only changes, mixed cover and an unchanged state."""
    return [
        F.when(kind == "radar_change", -0.12).otherwise(0.0),
        F.when(group == "mixed", -0.08).otherwise(0.0),
        F.when(before.eqNullSafe(after), -0.05).otherwise(0.0),
    ]


def confidence_adjustment(kind: Column, group: Column, before: Column, after: Column) -> Column:
    radar, mixed, same = penalties(kind, group, before, after)
    return radar + mixed + same


def adjusted_confidence(base: Column, deductions: Sequence[Column], magnitude: Column) -> Column:
    """Unrounded; the published value is its rounding to three digits.

    Deductions are taken off one by one: their sum first would leave 0.85 - (0.12 + 0.08) below the limit of 0.65.
    """
    for d in deductions:
        base = base + d
    bonus = F.least(F.coalesce(magnitude, F.lit(0.0)), F.lit(1.0)) * 0.05
    return clip(base + bonus, 0.0, 1.0)


def reliability_label(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")


def review_reason(publish_ready: Column) -> Column:
    return F.when(publish_ready, "meets_publish_threshold").otherwise("below_publish_threshold")
