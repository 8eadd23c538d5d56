"""Change regions: pixel runs, distributed connected components, zonal statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.functions import change as ch
from landshift.operators.overlay import INDICES
from landshift.session import cut_lineage
from landshift.storage import store

ROW_STRIDE = 1 << 21  # y * stride + x names a pixel; a wider raster row is an error
RUNS_PER_TASK = 200_000  # in a sweep
FLAGS = ("a_start", "a_end", "b_start", "b_end")


def tasks_for(rows: int) -> int:
    """Tasks for so many rows; Spark would size them by compressed bytes, of which sorted runs have few."""
    return 1 + rows // RUNS_PER_TASK


def pixel_runs(pixels: DataFrame, layer: str, value: str, means: Sequence[str] = ()) -> DataFrame:
    """Horizontal runs of equal value: (layer, value, node, y, x0, x1, n) and, per mean, its sum in micro-units and its count.

    A run lies in one raster row and its first pixel names it. Everything later works on runs.
    """
    w = Window.partitionBy(layer, "y", value).orderBy("x")
    start = F.coalesce(F.lag("x").over(w) != F.col("x") - 1, F.lit(True))
    marked = pixels.select(layer, value, "y", "x", *means).withColumn("_start", F.when(start, F.col("x")))
    x0 = F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    fits = F.assert_true(F.col("x").between(0, ROW_STRIDE - 1), F.lit(f"raster rows must be narrower than {ROW_STRIDE}"))
    named = marked.withColumn("node", F.coalesce(fits.cast("bigint"), F.col("y") * ROW_STRIDE + x0))
    micro = {m: F.round(F.col(m) * 1e6).cast("bigint") for m in means}
    return named.groupBy(layer, value, "y", "node").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"),
        *[F.sum(micro[m]).alias(f"_s_{m}") for m in means], *[F.count(m).alias(f"_n_{m}") for m in means])


def line_events(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where runs begin and end along the lines between raster rows: (keys, line, x, and four flags).

    A run lies below the line of its own row and above the next one. Its end is the first
    position after it. Flags of one place are one row; a line of one key is no longer than a raster row.
    Tasks follow the runs, two of which have eight ends.
    """
    below, above = F.col("y"), F.col("y") + 1
    ends = F.col("x1") + 1
    event = F.explode(F.array(*[
        F.struct(line.alias("line"), x.cast("int").alias("x"), *[F.lit(kind == k).alias(k) for k in FLAGS])
        for line, x, kind in ((above, F.col("x0"), "a_start"), (above, ends, "a_end"), (below, F.col("x0"), "b_start"), (below, ends, "b_end"))
    ]))
    placed = runs.select(*keys, event.alias("e")).select(*keys, "e.*").repartition(tasks_for(2 * runs.count()), *keys, "line")
    return placed.groupBy(*keys, "line", "x").agg(*[F.max(k).alias(k) for k in FLAGS])


def run_edges(runs: DataFrame, layer: str, value: str) -> DataFrame:
    """Pairs (a above, b below) of runs of equal value that touch vertically, each once.

    Along a line between two rows, the runs on either side are swept together by where they
    start, two rows per run and no join: of two runs that touch, the one that starts later finds
    the other as the last one on its side. The sweep sorts and may spill; its tasks grow in number
    with the runs, since their bytes are few when compressed and would be put into few tasks.
    """
    keys = [layer, value, "line"]
    side = F.explode(F.array(
        F.struct(F.col("y").alias("line"), F.lit(False).alias("above")), F.struct((F.col("y") + 1).alias("line"), F.lit(True).alias("above"))))
    placed = runs.select(layer, value, "x0", "x1", side.alias("s")).select(layer, value, "x0", "x1", "s.*")
    w = Window.partitionBy(*keys).orderBy("x0").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def latest(above: bool) -> Column:
        return F.last(F.when(F.col("above") == above, F.struct("x0", "x1")), ignorenulls=True).over(w)

    swept = placed.repartition(tasks_for(runs.count()), *keys).withColumns({"_a": latest(True), "_b": latest(False)})
    other = F.when(F.col("above"), F.col("_b")).otherwise(F.col("_a"))
    # runs that start at one place see each other; the upper one names the pair
    met = (other["x1"] >= F.col("x0")) & (F.col("above") | (other["x0"] < F.col("x0")))
    return swept.where(met).select(
        layer, ((F.col("line") - 1) * ROW_STRIDE + F.col("_a.x0")).alias("a"), (F.col("line") * ROW_STRIDE + F.col("_b.x0")).alias("b"))


def connected_components(edges: DataFrame, layer: str) -> DataFrame:
    """(layer, node, label) with the smallest node of each component as label.

    Minimum labels spread along edges, are hooked onto the current label's own
    node and then short-cut, so long thin components close in few rounds. Edge
    lists keep their bounded degree.
    """
    ways = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    both = cut_lineage(edges.select(layer, ways.alias("e")).select(layer, "e.*"))
    labels = cut_lineage(both.select(layer, F.col("u").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = (
            both.join(labels.select(layer, F.col("node").alias("v"), "label"), [layer, "v"])
            .groupBy(layer, F.col("u").alias("node")).agg(F.min("label").alias("near"))
        )
        spread = labels.join(near, [layer, "node"]).select(
            layer, "node", "label", F.least("label", "near").alias("low")
        )
        hooks = spread.groupBy(layer, F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        # read twice within the round; a lost executor recomputes it from the stored labels
        hooked = spread.join(hooks, [layer, "node"], "left").select(
            layer, "node", "label", F.least("low", F.coalesce("hook", F.col("low"))).alias("low")
        ).persist()
        # a popular label is a skewed key with plain rows on either side, which Spark splits at run time
        moved = hooked.where(F.col("low") < F.col("node")).select(layer, F.col("node").alias("low"), F.col("low").alias("next"))
        after = cut_lineage(
            hooked.join(moved, [layer, "low"], "left").select(
                layer, "node", F.col("label").alias("_old"), F.coalesce("next", "low").alias("label")
            )
        )
        hooked.unpersist()
        if after.where(F.col("_old") != F.col("label")).isEmpty():
            return after.select(layer, "node", "label")
        labels = after.drop("_old")


def label_runs(pixels: DataFrame, layer: str, value: str, means: Sequence[str] = ()) -> DataFrame:
    """Runs with the label of their 4-connected region of equal value; the runs are written once, pixels are not."""
    runs = store(pixel_runs(pixels, layer, value, means))
    labels = connected_components(run_edges(runs, layer, value), layer)
    parts = tasks_for(runs.count())
    return runs.repartition(parts, layer, "node").join(labels.repartition(parts, layer, "node"), [layer, "node"], "left").withColumn("region", F.coalesce("label", "node")).drop("label")


def label_regions(pixels: DataFrame, layer: str, value: str) -> DataFrame:
    """(layer, value, region, y, x) of every pixel."""
    runs = label_runs(pixels, layer, value)
    return runs.select(layer, value, "region", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def zonal_statistics(runs: DataFrame, layer: str, value: str, means: Sequence[str], pixel_area: float,
                     min_area: float = 0.0) -> DataFrame:
    """One row per region from its labelled runs, so one huge region stays cheap.

    The representative point is the middle of the longest run and lies inside
    the region by construction. Means go through integer micro-units.
    """
    longest = F.max(F.struct("n", (-F.col("y")).alias("ny"), (-F.col("x0")).alias("nx")))
    out = runs.groupBy(layer, value, "region").agg(
        F.sum("n").alias("pixel_count"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.count(F.lit(1)).alias("run_count"), longest.alias("_l"),
        *[(F.sum(f"_s_{m}") / (F.nullif(F.sum(f"_n_{m}"), F.lit(0)) * 1e6)).alias(m) for m in means],
    )
    return out.withColumns({
        "area_m2": F.col("pixel_count") * F.lit(pixel_area),
        "point_y": -F.col("_l.ny"),
        "point_x": (-F.col("_l.nx") + F.floor((F.col("_l.n") - 1) / 2)).cast("int"),
    }).drop("_l").where(F.col("area_m2") >= min_area)


def describe_regions(stats: DataFrame) -> DataFrame:
    """States, transition, magnitude and monitored group from the regional means."""
    c = F.col
    kind = ch.change_type(c("change_class"))
    return stats.withColumns({
        "change_type": kind,
        "before_state": ch.landcover_state(c("b_ndvi"), c("b_ndbi"), c("b_ndwi")),
        "after_state": ch.landcover_state(c("a_ndvi"), c("a_ndbi"), c("a_ndwi")),
        "change_magnitude": F.round(ch.change_magnitude(*[c(f"d_{k}") for k in INDICES]), 4),
        "base_confidence": F.round("confidence", 3),
    }).withColumns({
        "transition": ch.transition_label(c("before_state"), c("after_state")),
        "monitored_land_cover": ch.monitored_land_cover(c("change_type"), c("before_state"), c("after_state")),
    })


def sample_at_points(regions: DataFrame, raster: DataFrame, layer: str, value: str) -> DataFrame:
    """Raster value under each region's representative point; outside and 0 are skipped."""
    pts = regions.select(F.col(layer).alias("scene"), F.col("point_y").alias("y"), F.col("point_x").alias("x"), "region", "monitored_land_cover")
    return pts.join(raster.select("scene", "y", "x", F.col(value).alias("sampled")), ["scene", "y", "x"]).where("sampled > 0")


def alignment(samples: DataFrame) -> DataFrame:
    """Per monitored group: the class most of its regions fall on and its share."""
    counts = samples.groupBy("monitored_land_cover", "sampled").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("sampled")).alias("neg")))
    return counts.groupBy("monitored_land_cover").agg(F.sum("n").alias("region_count"), best.alias("b")).select(
        "monitored_land_cover", "region_count", (-F.col("b.neg")).alias("dominant_class"),
        F.round(F.col("b.n") / F.col("region_count"), 6).alias("dominant_share"),
    )
