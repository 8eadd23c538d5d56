"""Thresholds, taxonomies and grid contracts.

Everything here is a fixed value of the problem domain: it is turned into
literals inside a plan, never into rows that have to be joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: class spaces ------------------------------------------------
CHANGE_TYPES = {1: "vegetation_loss", 2: "built_up_gain", 3: "moisture_change", 4: "radar_change"}

HARMONIZED_CLASSES = {
    0: "unlabeled",
    1: "built_up",
    2: "managed_vegetation",
    3: "natural_vegetation",
    4: "bare_soil",
    5: "water_wetland",
    6: "uncertain_mixed",
}

MODEL_CLASSES = {1: "built_up", 2: "vegetation", 3: "bare_sparse", 4: "water_moisture", 5: "mixed"}

HARMONIZED_TO_MODEL = {1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5}

# external product codes -> harmonized class
WORLD_COVER_CODES = {
    10: 3, 20: 3, 30: 3, 40: 2, 50: 1, 60: 4, 70: 6, 80: 5, 90: 5, 95: 5, 100: 6,
}
LABEL_COLLECTION_CODES = {0: 5, 1: 3, 2: 3, 3: 5, 4: 2, 5: 3, 6: 1, 7: 4, 8: 6}

# vector tag "landuse" -> harmonized class
LANDUSE_CLASSES = {
    2: ("farmland", "orchard", "plant_nursery", "vineyard", "allotments"),
    3: ("forest", "grass", "meadow", "recreation_ground", "village_green"),
    5: ("basin", "reservoir"),
    4: ("quarry", "construction", "brownfield", "landfill"),
    1: ("residential", "commercial", "industrial", "retail"),
}

MINORITY_MODEL_CLASSES = (3, 4, 5)

# display colours of the model classes (red, green, blue)
CLASS_COLORS = {
    1: (214, 70, 23),
    2: (47, 137, 86),
    3: (181, 119, 27),
    4: (43, 139, 214),
    5: (112, 76, 219),
}

# display ramps per layer, evenly spaced stops from low to high
RAMPS = {
    "ndvi": ((116, 75, 42), (238, 226, 143), (35, 132, 67), (0, 68, 27)),
    "ndwi": ((121, 85, 72), (232, 226, 206), (93, 173, 226), (21, 67, 96)),
    "ndbi": ((35, 132, 67), (244, 241, 222), (214, 96, 77), (123, 50, 64)),
    "vv": ((38, 50, 56), (84, 110, 122), (176, 190, 197), (255, 255, 255)),
    "vh": ((28, 35, 42), (74, 85, 104), (129, 140, 248), (224, 231, 255)),
    "ratio": ((49, 54, 149), (69, 117, 180), (254, 224, 144), (165, 0, 38)),
    "d_ndvi": ((118, 42, 131), (247, 247, 247), (27, 120, 55)),
    "change_confidence": ((240, 240, 240), (253, 174, 97), (215, 48, 39), (103, 0, 31)),
    "entropy": ((247, 247, 247), (254, 224, 144), (253, 174, 97), (165, 0, 38)),
    "consensus": ((26, 150, 65), (255, 255, 191), (253, 174, 97), (215, 25, 28)),
}
OPACITY = 0.72

FROZEN_YEAR = 2026


@dataclass(frozen=True)
class ChangeThresholds:
    ndvi_loss: float = -0.22
    ndbi_gain: float = 0.16
    ndwi_abs: float = 0.25
    radar_ratio_abs: float = 0.3
    confidence: float = 0.75
    min_region_area_m2: float = 5000.0


@dataclass(frozen=True)
class WeakLabelThresholds:
    min_dominant_probability: float = 0.55
    min_label_confidence: float = 0.65
    min_probability_gap: float = 0.15


@dataclass(frozen=True)
class ReviewThresholds:
    low_confidence: float = 0.6
    high_entropy: float = 0.65
    unstable_fraction: float = 0.6
    strict_confidence: float = 0.8
    strict_entropy: float = 0.35
    strict_consensus: float = 0.7
    weak_support: float = 0.65
    high_anomaly: float = 0.9


@dataclass(frozen=True)
class SceneSearch:
    required_tiles: tuple[str, ...]
    radar_days: int = 6
    preferred_orbit: str = "ascending"
    max_gap_hours: float | None = 96.0
    preferred_cloud: float = 10.0
    fallback_cloud: float = 20.0
    max_groups: int = 12
    max_pairs: int = 4


@dataclass(frozen=True)
class MasterGrid:
    """North-up grid: x = left + col * res, y = top - row * res."""

    crs: str = "EPSG:32735"
    width: int = 2009
    height: int = 1997
    resolution: float = 10.0
    left: float = 830650.0
    bottom: float = 9774830.0
    right: float = 850740.0
    top: float = 9794800.0
    tolerance: float = 0.001
    dtype: str = "float32"
    check_dtype: bool = False

    @property
    def affine(self) -> tuple[float, ...]:
        return (self.resolution, 0.0, self.left, 0.0, -self.resolution, self.top)

    @property
    def bounds(self) -> tuple[float, ...]:
        return (self.left, self.bottom, self.right, self.top)

    @property
    def pixel_area(self) -> float:
        return self.resolution * self.resolution


@dataclass(frozen=True)
class PublishGate:
    min_consensus: float = 0.75
    max_instability: float = 0.25
    min_confidence: float = 0.70
    min_compatibility: float = 0.70
    max_review: float = 0.50
    publish_label: str = "publish_supported_candidates"
    review_label: str = "publish_with_review_required"
    hold_label: str = "hold_for_processing"


@dataclass(frozen=True)
class PatchPolicy:
    size: int = 128
    min_agreement_fraction: float = 0.05
    min_valid_fraction: float = 0.9
    min_training_pixels: int = 96
    max_patches: int | None = None
    train_remainders: tuple[int, ...] = (0, 1, 2, 3, 4, 5)
    validation_remainders: tuple[int, ...] = (6, 7)
    balance_limit: int = 24
    balance_multiplier: float = 2.0


AOI_AREA_KM2 = 400.0
CHANGE = ChangeThresholds()
WEAK = WeakLabelThresholds()
REVIEW = ReviewThresholds()
GATE = PublishGate()
GRID = MasterGrid()
