"""Raster overlay: scans, stacks, and before/after comparison of scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.config import CHANGE, CHANGE_TYPES, ChangeThresholds
from landshift.functions import change as ch

INDICES = ("ndvi", "ndbi", "ndwi", "ratio")


def scan_band(pixels: DataFrame, band: str, window: tuple[int, int, int, int] | None = None,
              scene: int | None = None) -> DataFrame:
    """One band, optionally one scene and one (y0, y1, x0, x1) inclusive window."""
    if band not in pixels.columns:
        raise ValueError(f"band {band!r} is not in the stack {pixels.columns}")
    out = pixels
    if scene is not None:
        out = out.where(F.col("scene") == scene)
    if window is not None:
        y0, y1, x0, x1 = window
        out = out.where(F.col("y").between(y0, y1) & F.col("x").between(x0, x1))
    return out.select("scene", "y", "x", F.col(band).alias("value"))


def to_long(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Wide stack to (scene, y, x, band, value) rows."""
    return pixels.unpivot(["scene", "y", "x"], list(bands), "band", "value")


def pivot_stack(long: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Long bands to one wide row per pixel; one shuffle however many bands."""
    return long.groupBy("scene", "y", "x").agg(
        *[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands]
    )


def add_static_bands(stack: DataFrame, static: DataFrame) -> DataFrame:
    """Scene-independent layers (terrain) joined by pixel."""
    return stack.join(static, ["y", "x"], "left")


def with_valid(stack: DataFrame, bands: Sequence[str]) -> DataFrame:
    valid = F.lit(True)
    for b in bands:
        valid = valid & F.col(b).isNotNull()
    return stack.withColumn("valid", valid)


def scene_inventory(pixels: DataFrame) -> DataFrame:
    """Scenes that hold data, with a flag on the latest one; the window sees one row per scene, so the pixels are read once."""
    found = pixels.groupBy("scene").agg(F.count(F.lit(1)).alias("pixel_count"))
    return found.withColumn("is_latest", F.col("scene") == F.max("scene").over(Window.partitionBy(F.lit(0))))


def consecutive_pairs(scenes: DataFrame) -> DataFrame:
    """(before, after, seq) of neighbouring scenes; one row per scene date."""
    w = Window.orderBy("scene")
    return (
        scenes.select("scene").distinct()
        .select(F.lag("scene").over(w).alias("before_scene"), F.col("scene").alias("after_scene"))
        .where(F.col("before_scene").isNotNull())
    )


def pair_map(pairs: DataFrame) -> Column:
    """after -> before of consecutive scenes as a scalar; one entry per date, so that no pixel moves for it."""
    return pairs.agg(F.map_from_entries(F.collect_list(F.struct("after_scene", "before_scene")))).scalar()


def keep_where(df: DataFrame, condition: Column, columns: Sequence[str]) -> DataFrame:
    """The columns of the rows where a condition holds that was built in many steps.

    Spark moves a plain filter below the steps and copies each into it as often as it is used; this one stays behind them.
    """
    kept = F.explode(F.array(F.when(condition, F.struct(*columns)))).alias("_kept")
    return df.select(kept).where(F.col("_kept").isNotNull()).select("_kept.*")


def with_touching(features: DataFrame, pairs: DataFrame, t: ChangeThresholds = CHANGE) -> DataFrame:
    """Beside every pixel of a scene what the two comparisons that touch the scene say about it.

    Both neighbours come from one window, so the comparisons need no rows of their own:
    change_confidence is the larger confidence of the changes, group the monitored group
    of the later one; both NULL where nothing changed. Each step is a column of its own,
    which keeps the generated code small.
    """
    w = Window.partitionBy("y", "x").orderBy("scene")
    near = features.withColumns({
        "_here": F.struct("scene", *INDICES), "_b": F.lag(F.struct("scene", *INDICES)).over(w), "_n": F.lead(F.struct("scene", *INDICES)).over(w),
    }).withColumn("_pairs", pair_map(pairs))
    sides = {"_e": ("_b", "_here"), "_l": ("_here", "_n")}
    out = near.withColumns({
        f"{s}_{k}": F.when(F.try_element_at("_pairs", F.col(f"{after}.scene")) == F.col(f"{before}.scene"), F.col(f"{after}.{k}") - F.col(f"{before}.{k}"))
        for s, (before, after) in sides.items() for k in INDICES
    })
    deltas = {s: [F.col(f"{s}_{k}") for k in INDICES] for s in sides}
    out = out.withColumns({f"{s}_raw": ch.classify_change(*deltas[s], t=t) for s in sides})
    out = out.withColumns({f"{s}_score": ch.change_confidence(F.col(f"{s}_raw"), *deltas[s], t=t) for s in sides})
    out = out.withColumns({f"{s}_class": ch.gate(F.col(f"{s}_raw"), F.col(f"{s}_score"), t) for s in sides})
    out = out.withColumns({f"{o}_state": ch.landcover_state(*[F.col(f"{o}.{k}") for k in ("ndvi", "ndbi", "ndwi")]) for o in ("_b", "_here", "_n")})
    out = out.withColumns({
        f"{s}_group": F.when(F.col(f"{s}_class") > 0, ch.monitored_land_cover(ch.change_type(F.col(f"{s}_class")), F.col(f"{before}_state"), F.col(f"{after}_state")))
        for s, (before, after) in sides.items()
    })
    found = {s: F.col(f"{s}_class") > 0 for s in sides}
    return out.select(
        *features.columns, F.greatest(*[F.when(found[s], F.col(f"{s}_score")) for s in sides]).alias("change_confidence"),
        F.when(found["_l"], F.col("_l_group")).otherwise(F.col("_e_group")).alias("group"),
    )


def compare_scenes(features: DataFrame, pairs: DataFrame, keep: Sequence[str] = INDICES) -> DataFrame:
    """Before/after rows of every consecutive pair, with one shuffle by pixel.

    Each pixel looks back to its own previous observation and keeps it only if
    that observation is the scene the pair names, so gaps never bridge.
    """
    w = Window.partitionBy("y", "x").orderBy("scene")
    prior = features.select(
        "scene", "y", "x", *keep,
        F.lag(F.struct("scene", *keep)).over(w).alias("_b"),
    ).where(F.col("_b").isNotNull())
    out = prior.withColumn("_pairs", pair_map(pairs)).where(F.try_element_at("_pairs", F.col("scene")) == F.col("_b.scene"))
    return out.select(
        F.col("_b.scene").alias("before_scene"), F.col("scene").alias("after_scene"), "y", "x",
        *[F.col(f"_b.{k}").alias(f"b_{k}") for k in keep],
        *[F.col(k).alias(f"a_{k}") for k in keep],
        *[(F.col(k) - F.col(f"_b.{k}")).alias(f"d_{k}") for k in keep],
    )


def detect(compared: DataFrame, t: ChangeThresholds = CHANGE) -> DataFrame:
    """Classify, score and gate the deltas."""
    d = [F.col(f"d_{k}") for k in INDICES]
    return (
        compared.withColumn("raw_class", ch.classify_change(*d, t=t))
        .withColumn("raw_confidence", ch.change_confidence(F.col("raw_class"), *d, t=t))
        .withColumn("change_class", ch.gate(F.col("raw_class"), F.col("raw_confidence"), t))
        .withColumn("confidence", ch.gate(F.col("raw_confidence"), F.col("raw_confidence"), t).cast("double"))
    )


def change_summary(detected: DataFrame) -> DataFrame:
    """Counts per comparison; classes that never occur keep a zero."""

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return detected.groupBy("before_scene", "after_scene").agg(
        F.count(F.lit(1)).alias("compared_pixels"),
        n(F.col("change_class") > 0).alias("changed_pixels"),
        *[n(F.col("change_class") == k).alias(f"{name}_pixels") for k, name in CHANGE_TYPES.items()],
        F.round(F.avg(F.when(F.col("change_class") > 0, F.round("confidence", 6))), 4).alias("mean_confidence"),
    )
