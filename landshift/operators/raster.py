"""Overlapping windows, resampling, vector rasterising and display tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landshift.functions import geo, labels as lb, model as md

MODEL = range(1, 6)
TILE = 256  # fixed value: pixels per tile side
CELLS_PER_TASK = 300_000  # that boxes of features cover


def covering_windows(pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """One row per (pixel, window that covers it); window starts are multiples of the stride."""

    def starts(pos: str) -> Column:
        last = F.floor(F.col(pos) / stride)
        first = F.greatest(F.ceil((F.col(pos) - size + 1) / stride), F.lit(0))
        return F.sequence(first, last)

    return pixels.withColumn("wrow", F.explode(starts("y"))).withColumn("wcol", F.explode(starts("x")))


def vote_mosaic(windows: DataFrame) -> DataFrame:
    """Class vote, mean confidence and entropy over the windows of a pixel. A pixel's
    windows sit in one task, so they fold together before the shuffle."""
    n = F.count(F.lit(1))
    votes = F.array(*[F.count(F.when(F.col("window_class") == k, 1)) for k in MODEL])

    def mean(c: str) -> Column:
        return F.sum(F.round(F.col(c) * 1e9).cast("bigint")) / (n * 1e9)

    return windows.groupBy("scene", "y", "x").agg(
        n.alias("coverage"), votes.alias("_v"), mean("confidence").alias("confidence"), mean("entropy").alias("entropy")
    ).withColumn("mosaic_class", lb.argmax_class(F.col("_v"))).drop("_v")


def coverage_summary(mosaic: DataFrame, area: Column) -> DataFrame:
    n = F.count(F.lit(1))
    return mosaic.groupBy("scene").agg(
        n.alias("covered_pixels"), F.round(n / F.max(area), 6).alias("coverage_fraction"), F.max("coverage").alias("max_coverage"),
        F.round(F.sum(F.round(F.col("confidence") * 1e6).cast("bigint")) / (n * 1e6), 5).alias("mean_confidence"))


def probability_mosaic(windows: DataFrame, valid: Column) -> DataFrame:
    """Mean probability per class over covering windows, then class, confidence and entropy."""
    n = F.count(F.lit(1))
    mean = F.array(*[F.round(F.sum(F.round(F.get("probs", k - 1) * 1e9).cast("bigint")) / (n * 1e9), 9) for k in MODEL])
    return windows.where(valid).groupBy("scene", "y", "x").agg(n.alias("coverage"), mean.alias("mean_probs")).withColumns({
        "model_class": lb.argmax_class(F.col("mean_probs")), "confidence": F.array_max("mean_probs"),
        "entropy": md.predictive_entropy(F.col("mean_probs"), len(MODEL)),
    })


def resample_nearest(cells: DataFrame, value: str, scale: float, height: Column, width: Column) -> DataFrame:
    """Every source cell emits the target cells whose centre falls into it: no shuffle."""

    def targets(pos: str, extent: Column) -> Column:
        first = F.ceil(F.col(pos) / scale - 0.5)
        last = F.least(F.ceil((F.col(pos) + 1) / scale - 0.5) - 1, F.ceil(extent / scale) - 1)
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    return cells.withColumn("ty", targets("y", height)).withColumn("tx", targets("x", width)).select("ty", "tx", value)


def resample_bilinear(cells: DataFrame, value: str, scale: float, height: Column, width: Column, units: int = 1000) -> DataFrame:
    """Source cells send weighted values to the targets they influence; nodata drops out and
    the weights renormalise. One aggregation, no join."""

    def targets(pos: str, extent: Column) -> Column:
        first = F.greatest(F.ceil((F.col(pos) - 0.5) / scale - 0.5), F.lit(0))
        last = F.least(F.floor((F.col(pos) + 1.5) / scale - 0.5), F.ceil(extent / scale) - 1)
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    def weight(target: str, pos: str) -> Column:
        return F.greatest(F.lit(0.0), 1 - F.abs((F.col(target) + 0.5) * scale - 0.5 - F.col(pos)))

    sent = cells.where(F.col(value).isNotNull()).withColumn("ty", targets("y", height)).withColumn("tx", targets("x", width))
    w = F.round(weight("ty", "y") * weight("tx", "x") * 1e6).cast("bigint")
    return sent.select("ty", "tx", w.alias("w"), F.round(F.col(value) * units).cast("bigint").alias("v")).where("w > 0").groupBy("ty", "tx").agg(
        (F.sum(F.col("w") * F.col("v")) / (F.sum("w") * float(units))).alias(value))


def rasterize(shapes: DataFrame, buffer: float, block: int = 256) -> DataFrame:
    """Burn classed polygons and buffered lines into unit cells, every touched cell counts
    and the later feature (by id) wins.

    Bounding boxes are cut into blocks that are spread over the cluster before
    they become cells, so one huge polygon does not land on one task. Every cell meets the
    segments of its feature row by row, which Spark compiles, and folds them in the block's task.
    """
    grow = F.when(F.col("shape") == "line", F.lit(buffer)).otherwise(0.0)
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    boxed = shapes.where(F.col("shape").isin("line", "polygon")).select(
        "id", "class_id", (F.col("shape") == "polygon").alias("filled"), geo.segments(F.col("points")).alias("segments"),
        F.floor(F.array_min(xs) - grow).alias("x0"), F.floor(F.array_max(xs) + grow).alias("x1"),
        F.floor(F.array_min(ys) - grow).alias("y0"), F.floor(F.array_max(ys) + grow).alias("y1"),
    )
    covered = boxed.agg(F.sum((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))).first()[0]
    tasks = 1 + (covered or 0) // CELLS_PER_TASK
    blocks = boxed.withColumn("by", F.explode(F.sequence(F.floor(F.col("y0") / block), F.floor(F.col("y1") / block)))).withColumn(
        "bx", F.explode(F.sequence(F.floor(F.col("x0") / block), F.floor(F.col("x1") / block)))
    ).repartition(tasks, "id", "by", "bx")
    # a number per block of a feature, given before its segments part, tells features of one id apart; it stays in its task
    edges = blocks.withColumn("row", F.monotonically_increasing_id()).withColumn("s", F.explode("segments")).drop("segments").select(
        "*", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx_"), F.col("s.b.y").alias("by_")).drop("s")
    cells = edges.withColumn(
        "y", F.explode(F.sequence(F.greatest("y0", F.col("by") * block), F.least("y1", F.col("by") * block + block - 1)))
    ).withColumn("x", F.explode(F.sequence(F.greatest("x0", F.col("bx") * block), F.least("x1", F.col("bx") * block + block - 1))))
    cx, cy = F.col("x").cast("double"), F.col("y").cast("double")
    ends = [F.col(c) for c in ("ax", "ay", "bx_", "by_")]
    # each test is an aggregate of its own, since one that holds them all is too long a method for the JVM to compile
    near = [F.bool_or(~F.col("filled") & (distance <= buffer)).alias(f"near{i}") for i, distance in enumerate(geo.corner_distances(*ends, cx, cy))]
    crossed = F.col("filled") & geo.ray_crosses(cx + 0.5, cy + 0.5, *ends)
    found = cells.groupBy("id", "by", "bx", "row", "class_id", "y", "x").agg(
        F.bool_or(geo.segment_hits_cell(*ends, cx, cy)).alias("met"), *near, F.count_if(crossed).alias("crossings"))
    hit = found.where(F.greatest("met", *[f"near{i}" for i in range(len(near))]) | (F.col("crossings") % 2 == 1))
    return hit.groupBy("y", "x").agg(F.max_by("class_id", "id").alias("class_id"), F.max("id").alias("feature_id"))


def tile_keys(pixels: DataFrame, mx: Column, my: Column, zooms: tuple[int, ...]) -> DataFrame:
    """Mercator pixel centres to (z, tile, pixel inside tile) for every zoom."""
    span = F.lit(2 * geo.HALF_WORLD) / F.pow(F.lit(2.0), F.col("z"))
    out = pixels.withColumns({"_mx": mx, "_my": my}).withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    tx, ty = geo.mercator_to_tile(F.col("_mx"), F.col("_my"), F.col("z"))
    out = out.withColumns({"tx": tx, "ty": ty})
    px = F.floor(((F.col("_mx") + geo.HALF_WORLD) / span - F.col("tx")) * TILE).cast("int")
    py = F.floor(((geo.HALF_WORLD - F.col("_my")) / span - F.col("ty")) * TILE).cast("int")
    return out.withColumns({"px": px, "py": py}).drop("_mx", "_my")


TILE_PIXEL = ("z", "tx", "ty", "px", "py")


def continuous_tiles(keyed: DataFrame, value: str, layer: tuple[str, ...] = ()) -> DataFrame:
    """Mean per tile pixel; `layer` names what has a pyramid of its own, such as each date."""
    n = F.count(value)
    return keyed.where(F.col(value).isNotNull()).groupBy(*layer, *TILE_PIXEL).agg(
        F.round(F.sum(F.round(F.col(value) * 1e6).cast("bigint")) / (n * 1e6), 12).alias("value"))


def categorical_tiles(keyed: DataFrame, value: str, layer: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent class per tile pixel, lowest on ties; 0 stays transparent."""
    c = keyed.where(F.col(value) > 0).groupBy(*layer, *TILE_PIXEL, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*layer, *TILE_PIXEL).agg((-F.max(F.struct("n", (-F.col(value)).alias("neg")))["neg"]).alias("value"))
