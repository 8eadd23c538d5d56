"""Clustering experiments over scenes, feature sets, reductions, masks and cluster counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from landshift.operators import fits
from landshift.operators.embed import assign_clusters
from landshift.storage import store

REDUCTIONS = ("none", "pca")
MASKS = ("all", "high_confidence_change")
COMPONENTS = 3  # of the reduced spaces
SCHEMA = ("scene int, feature_set string, reduction string, mask_mode string, k int, status string, reason string, "
          "pixel_count bigint, explained_variance double, silhouette double")


def feature_spaces(pixels: DataFrame, sets: Mapping[str, Sequence[str]], confident: str) -> tuple[DataFrame, DataFrame]:
    """(points, axes): the pixels of every scene, feature set, mask and reduction as rows (space, id, y, x, v).

    A pixel takes part where all features of the set are there and, with the mask of
    confident change, where `confident` holds. Features are scaled by the mean and
    deviation of their space; constant ones keep scale 1. Vectors are padded with zeros to one
    width, which changes no distance. `axes` has a row per space before its reduction.
    """
    width = max(map(len, sets.values()))
    spaces = F.array_compact(F.array(*[
        F.when(
            F.lit(True if mask == "all" else False) | F.col(confident),
            F.when(F.forall(F.array(*features), lambda v: v.isNotNull()), F.struct(
                F.concat_ws("|", "scene", F.lit(name), F.lit(mask)).alias("space"),
                F.array(*features, *[F.lit(0.0)] * (width - len(features))).alias("v"))))
        for name, features in sets.items() for mask in MASKS]))
    raw = store(pixels.select(F.concat_ws("_", "scene", "y", "x").alias("id"), "y", "x", F.explode(spaces).alias("s")).select("s.space", "id", "y", "x", "s.v"))
    moments = raw.groupBy("space").agg(
        F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(width)]).alias("m"), F.array(*[F.stddev_pop(F.get("v", F.lit(i))) for i in range(width)]).alias("d"))
    scaled = F.transform("v", lambda v, i: (v - F.get("m", i)) / F.when(F.get("d", i) > 0, F.get("d", i)).otherwise(1.0))
    # as many rows as spaces, which the parameters bound
    whole = store(raw.join(F.broadcast(moments), "space").select("space", "id", "y", "x", scaled.alias("v")))
    axes = store(fits.principal_axes(whole, "v", width, COMPONENTS, F.col("space")).withColumnRenamed("key", "space"))
    code = F.concat(fits.project(F.col("v"), F.col("axes")), F.array_repeat(F.lit(0.0), width - COMPONENTS))
    reduced = whole.join(F.broadcast(axes.select("space", "axes")), "space").select(F.concat("space", F.lit("|pca")).alias("space"), "id", "y", "x", code.alias("v"))
    return store(whole.withColumn("space", F.concat("space", F.lit("|none"))).unionByName(reduced)), axes


def run_experiments(spark: SparkSession, points: DataFrame, axes: DataFrame, scenes: Sequence[int], sets: Sequence[str], ks: Sequence[int],
                    seed: int, steps: int) -> tuple[DataFrame, list[fits.Configuration]]:
    """One row per configuration, and the fitted runs in the same order.

    All configurations share every pass over the points; the driver handles the grid
    of configurations, which the parameters give, and its centroids.
    """
    centres = fits.first_centres(points, "space", F.col("id"), "v", max(ks), seed)
    known = {r.space: r for r in axes.select("space", "n", "explained").collect()}
    grid = list(product(scenes, sets, REDUCTIONS, MASKS, ks))
    runs = []
    for scene, name, reduction, mask, k in grid:
        space = f"{scene}|{name}|{mask}|{reduction}"
        runs.append(fits.Configuration(space, k, centres[space][:k]) if space in centres else fits.Configuration(space, k))
    fits.lloyd(points, runs, steps)
    rows = []
    for (scene, name, reduction, mask, k), (_, _, score) in zip(grid, fits.silhouettes(points, runs)):
        space = known.get(f"{scene}|{name}|{mask}")
        rows.append((scene, name, reduction, mask, k, "skipped" if space is None else "ok", "no valid pixels" if space is None else None,
                     0 if space is None else space.n, space.explained if space is not None and reduction == "pca" else None, score))
    return spark.createDataFrame(rows, SCHEMA), runs


def ranked_experiments(found: DataFrame) -> DataFrame:
    """Experiments with their rank: finished ones first, the best silhouette first, those without one last."""
    order = [F.col("status") != "ok", F.col("silhouette").desc_nulls_last(), "scene", "feature_set", "reduction", "mask_mode", "k"]
    rounded = found.withColumns({"silhouette": F.round("silhouette", 4), "explained_variance": F.round("explained_variance", 4)})
    return rounded.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_clusters(points: DataFrame, ranked: DataFrame, runs: Sequence[fits.Configuration]) -> DataFrame:
    """(y, x, cluster) of the pixels of the best experiment, by its own centroids."""
    best = ranked.orderBy("rank").first()
    space = f"{best.scene}|{best.feature_set}|{best.mask_mode}|{best.reduction}"
    run = next(r for r in runs if (r.space, r.k) == (space, best.k))
    return assign_clusters(points.where(F.col("space") == space), "v", run.centroids.tolist()).select(
        F.lit(best.scene).alias("scene"), "y", "x", "cluster")
