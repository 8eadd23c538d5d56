"""Outlines of regions: closed rings with holes, chained from run ends by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.config import GRID, MasterGrid
from landshift.functions import geo
from landshift.operators.regions import ROW_STRIDE, line_events, tasks_for
from landshift.storage import discard, store


def _side(row: Column, x: Column, right: int) -> Column:
    """Name of the left (upward) or right (downward) side of the pixels of one run."""
    return (row * ROW_STRIDE + x) * 2 + right


def boundary_links(runs: DataFrame, layer: str) -> DataFrame:
    """(layer, region, side, next, line, x_from, x_to): the side of a run that follows each side along its ring.

    The interior lies to the right of the direction of travel. Along each line between two raster
    rows, the ends of a region's runs above and below are swept from left to right: where only
    one side of the line is inside up to the next end, the outline runs along the line between the
    two; where both rows begin or end at the same place, it goes straight on (x_from is null).
    Where two pixels meet at a corner only, the outline turns to the other pixel, so no ring
    touches itself and holes that touch the outside at a point stay holes.
    """
    w = Window.partitionBy(layer, "region", "line").orderBy("x")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)

    def inside(side: str) -> Column:
        return F.sum(F.col(f"{side}_start").cast("int") - F.col(f"{side}_end").cast("int")).over(so_far)

    ahead = {f"_{c}": F.lead(c).over(w) for c in ("x", "a_start", "a_end", "b_start", "b_end")}
    e = line_events(runs, [layer, "region"]).withColumns({"_a": inside("a"), "_b": inside("b"), **ahead})
    line, x, to = F.col("line"), F.col("x"), F.col("_x")
    above = line - 1
    none = F.lit(None).cast("int")

    def link(of: Column, then: Column, x_from: Column, x_to: Column) -> Column:
        return F.struct(of.alias("side"), then.alias("next"), x_from.alias("x_from"), x_to.alias("x_to"))

    eastward = link(
        F.when(F.col("a_end"), _side(above, x, 1)).otherwise(_side(line, x, 0)),
        F.when(F.col("_a_start"), _side(above, to, 0)).otherwise(_side(line, to, 1)), x, to)
    westward = link(
        F.when(F.col("_b_start"), _side(line, to, 0)).otherwise(_side(above, to, 1)),
        F.when(F.col("b_end"), _side(line, x, 1)).otherwise(_side(above, x, 0)), to, x)
    found = F.array_compact(F.array(
        F.when(F.col("a_start") & F.col("b_start"), link(_side(line, x, 0), _side(above, x, 0), none, none)),
        F.when(F.col("a_end") & F.col("b_end"), link(_side(above, x, 1), _side(line, x, 1), none, none)),
        F.when((F.col("_a") == 0) & (F.col("_b") == 1), eastward),
        F.when((F.col("_a") == 1) & (F.col("_b") == 0), westward)))
    return e.select(layer, "region", "line", F.explode(found).alias("l")).select(layer, "region", "line", "l.*")


def ring_order(links: DataFrame, layer: str) -> DataFrame:
    """(layer, side, ring, steps): the smallest side of each side's ring and how many links lead to it.

    Every side looks twice as far in each round, so a ring of n sides takes log2(n) joins
    of a written table with itself and is never gathered. Their tasks grow in number with the sides.
    """
    state = store(links.select(layer, "side", "next", F.col("side").alias("ring"), F.lit(0).cast("bigint").alias("steps")))
    reach, parts = 1, tasks_for(state.count())
    while True:
        there = state.select(layer, F.col("side").alias("next"), F.col("next").alias("after"), F.col("ring").alias("far"), F.col("steps").alias("far_steps"))
        lower = F.col("far") < F.col("ring")
        state_after = store(state.repartition(parts, layer, "next").join(there.repartition(parts, layer, "next"), [layer, "next"]).select(
            layer, "side", F.col("after").alias("next"), F.least("ring", "far").alias("ring"),
            F.when(lower, F.col("far_steps") + reach).otherwise(F.col("steps")).alias("steps"), lower.alias("moved")))
        discard(state)
        state, reach = state_after, reach * 2
        if state.where("moved").isEmpty():
            return state.select(layer, "side", "ring", "steps")


def ring_vertices(runs: DataFrame, layer: str) -> DataFrame:
    """(layer, region, ring, place, line, x_first, x_second): the corners of every ring, two per row, in order of `place`.

    Rings run counterclockwise on a map with north up, holes clockwise. `place` counts up along the ring.
    """
    links = store(boundary_links(runs, layer))
    parts = tasks_for(links.count())
    steps = ring_order(links, layer).repartition(parts, layer, "side")
    ordered = links.where("x_from IS NOT NULL").repartition(parts, layer, "side").join(steps, [layer, "side"])
    # steps count down along the links, and the rings run against them; the first side's own corners come last
    return ordered.select(layer, "region", "ring", F.when(F.col("steps") == 0, F.lit(1 << 62)).otherwise(F.col("steps")).alias("place"),
                          "line", F.col("x_to").alias("x_first"), F.col("x_from").alias("x_second"))


def region_rings(runs: DataFrame, layer: str, g: MasterGrid = GRID, decimals: int = 7) -> DataFrame:
    """(layer, region, ring, hole, corner_count, pixel_area, coordinates): one row per ring, closed, in longitude and latitude.

    Corners are projected row by row before a ring's are put together; a ring is one value, as
    a feature needs it. pixel_area is negative for holes; a region's sum is its pixel count.
    """
    def corner(x: str) -> Column:
        lon, lat = geo.utm_to_lonlat(*geo.pixel_to_map(F.col("line"), F.col(x), g, center=False))
        return F.array(F.round(lon, decimals), F.round(lat, decimals))

    placed = ring_vertices(runs, layer).select(
        layer, "region", "ring", ((F.col("x_first") - F.col("x_second")) * F.col("line")).alias("strip"),
        F.struct("place", corner("x_first").alias("first"), corner("x_second").alias("second")).alias("c"))
    rings = placed.groupBy(layer, "region", "ring").agg(
        (-F.sum("strip")).alias("pixel_area"), (F.count(F.lit(1)) * 2).alias("corner_count"), F.sort_array(F.collect_list("c")).alias("c"))
    points = F.flatten(F.transform("c", lambda c: F.array(c["first"], c["second"])))
    return rings.select(layer, "region", "ring", (F.col("pixel_area") < 0).alias("hole"), "corner_count", "pixel_area",
                        F.concat(points, F.slice(points, 1, 1)).alias("coordinates"))


def region_polygons(rings: DataFrame, layer: str) -> DataFrame:
    """(layer, region, polygon): the rings of each region in one value, the outer ring first, holes by their number."""
    each = F.sort_array(F.collect_list(F.struct("hole", "ring", "coordinates")))
    return rings.groupBy(layer, "region").agg(F.transform(each, lambda r: r["coordinates"]).alias("polygon"))
