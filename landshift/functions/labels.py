"""Weak labels, class spaces and pseudo-label expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from landshift.config import HARMONIZED_TO_MODEL, LANDUSE_CLASSES, WEAK, WeakLabelThresholds
from landshift.functions.bands import all_valid, clip


def int_map(mapping: Mapping[int, int]) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def remap(code: Column, mapping: Mapping[int, int]) -> Column:
    """Codes outside the mapping become 0 (unlabeled)."""
    return F.coalesce(F.try_element_at(int_map(mapping), code.cast("int")), F.lit(0))


def harmonized_to_model(label: Column) -> Column:
    return remap(label, HARMONIZED_TO_MODEL)


def ramp(value: Column, center: float, scale: float) -> Column:
    return clip((value - center) / scale, 0.0, 1.0)


def soft_scores(ndvi: Column, ndwi: Column, ndbi: Column, ratio: Column) -> Column:
    """Six class scores in harmonized order, not normalised."""
    green = ramp(ndvi, 0.18, 0.5) * (1.0 - ramp(ndwi, 0.25, 0.4))
    return F.array(
        ramp(ndbi, 0.08, 0.28) * (1.0 - ramp(ndwi, 0.15, 0.4)),
        green * 0.45,
        green * 0.55,
        (1.0 - ramp(ndvi, 0.15, 0.45)) * (1.0 - ramp(ndwi, 0.12, 0.4)) * (1.0 - ramp(ndbi, 0.18, 0.3)),
        ramp(ndwi, 0.12, 0.35),
        F.lit(0.12) + ramp(F.abs(ratio), 1.2, 3.5) * 0.2,
    )


def score_total(scores: Column, classes: int = 6) -> Column:
    """The sum in order, written out so that Spark compiles it."""
    return reduce(add, [F.get(scores, F.lit(i)) for i in range(classes)], F.lit(0.0))


def shares(scores: Column, total: Column, classes: int = 6) -> Column:
    return F.array(*[F.get(scores, F.lit(i)) / total for i in range(classes)])


def soft_probabilities(ndvi: Column, ndwi: Column, ndbi: Column, ratio: Column) -> Column:
    """Six class probabilities in harmonized order, NULL when any input is nodata."""
    scores = soft_scores(ndvi, ndwi, ndbi, ratio)
    return F.when(all_valid(ndvi, ndwi, ndbi, ratio), shares(scores, score_total(scores)))


def argmax_class(values: Column) -> Column:
    """1-based position of the first maximum; 0 for nodata."""
    return F.coalesce(F.array_position(values, F.array_max(values)).cast("int"), F.lit(0))


def probability_gap(probs: Column) -> Column:
    ranked = F.sort_array(probs, asc=False)
    return F.get(ranked, 0) - F.get(ranked, 1)


def monitored_group_class(group: Column, p_managed: Column, p_natural: Column) -> Column:
    return (
        F.when(group == "built_up", 1)
        .when(group == "bare_sparse", 4)
        .when(group == "water_moisture", 5)
        .when((group == "vegetation") & (p_managed >= p_natural), 2)
        .when(group == "vegetation", 3)
        .otherwise(6)
    )


def label_confidence(max_probability: Column, agrees: Column, change_confidence: Column) -> Column:
    return (
        F.lit(0.55) * max_probability
        + F.lit(0.25) * F.when(agrees, 1.0).otherwise(0.0)
        + F.lit(0.20) * clip(F.coalesce(change_confidence, F.lit(0.0)), 0.0, 1.0)
    )


def hard_label(dominant: Column, max_probability: Column, confidence: Column, gap: Column,
               t: WeakLabelThresholds = WEAK) -> Column:
    keep = (
        (max_probability >= t.min_dominant_probability)
        & (confidence >= t.min_label_confidence)
        & (gap >= t.min_probability_gap)
    )
    return F.when(keep, dominant).otherwise(0)


def tag_class(tags: Column) -> Column:
    """Class of a vector feature from its tag map; presence of a key outranks land use."""
    landuse = F.lower(F.coalesce(F.try_element_at(tags, F.lit("landuse")), F.lit("")))
    out = F.when(F.map_contains_key(tags, "building") | F.map_contains_key(tags, "highway"), 1)
    for code, names in LANDUSE_CLASSES.items():
        out = out.when(landuse.isin(*names), code)
    return out


def compatible(model_class: Column, harmonized: Column) -> Column:
    """Model class matches the harmonized label it was trained from."""
    return (harmonized > 0) & (harmonized_to_model(harmonized) == model_class)


def vote_counts(labels: Column, classes: Iterable[int]) -> Column:
    def count(k: int) -> Column:
        return F.size(F.filter(labels, lambda x: x == k))

    return F.array(*[count(k) for k in classes])


def refined_confidence(strict: Column, external: Column, confidence: Column, entropy: Column,
                       consensus: Column, source_count: Column) -> Column:
    return F.when(strict, F.least(confidence, 1.0 - entropy, consensus)).when(
        external, clip(source_count / 4.0, 0.0, 1.0)
    )
