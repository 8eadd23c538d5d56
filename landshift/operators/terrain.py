"""Neighbourhood operators, image registration and grid audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.config import GRID, MasterGrid
from landshift.functions.geo import point_in_ring, stretch01
from landshift.operators.quantiles import exact_quantiles

_MOMENTS = {"dy": pa.int32(), "dx": pa.int32(), "n": pa.int64(), **{c: pa.float64() for c in ("sr", "st", "srr", "stt", "srt")}}


def _row_pass(cells: DataFrame, value: str, width: Column) -> DataFrame:
    """Horizontal neighbours inside one raster row, missing ones as NULL."""
    w = Window.partitionBy("y").orderBy("x")
    left = F.when(F.lag("x").over(w) == F.col("x") - 1, F.lag(value).over(w))
    right = F.when(F.lead("x").over(w) == F.col("x") + 1, F.lead(value).over(w))
    return cells.withColumns({"_l": left, "_r": right, "_w": width})


def _difference(at: str, low: str, high: str, pos: str, extent: str, step: float) -> Column:
    """Central difference, one-sided on the raster edge."""
    return (
        F.when(F.col(pos) == 0, (F.col(high) - F.col(at)) / step)
        .when(F.col(pos) == F.col(extent) - 1, (F.col(at) - F.col(low)) / step)
        .otherwise((F.col(high) - F.col(low)) / (2 * step))
    )


def _column_pass(rows: DataFrame, carry: dict[str, Column], height: Column) -> DataFrame:
    """Send each cell's row summary to itself and its vertical neighbours: three rows out, one aggregation."""
    sent = rows.select("y", "x", *[c.alias(n) for n, c in carry.items()], F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("dy"))
    moved = sent.select((F.col("y") + F.col("dy")).alias("y"), "x", "dy", *carry, height.alias("_h"))
    return moved.where((F.col("y") >= 0) & (F.col("y") < F.col("_h")))


def terrain_derivatives(cells: DataFrame, height: Column, width: Column, resolution: float = 10.0,
                        scale: int = 1000) -> DataFrame:
    """Slope in degrees, ruggedness and topographic position from a 3x3 window.

    Edges repeat the border cell, nodata neighbours are skipped. The window is
    separable: one window pass along raster rows, then one three-way vertical
    exchange. Sums run in integer units of 1/scale.
    """
    v = F.round(F.col("elevation") * scale).cast("bigint")
    r = _row_pass(cells, "elevation", width)
    gx = _difference("elevation", "_l", "_r", "x", "_w", resolution)

    def units(c: Column) -> Column:
        return F.coalesce(F.round(c * scale).cast("bigint"), F.lit(0))

    def present(c: Column) -> Column:
        return F.when(c.isNotNull(), 1).otherwise(0)

    edge = F.when(F.col("x") == 0, 1).otherwise(0) + F.when(F.col("x") == F.col("_w") - 1, 1).otherwise(0)
    center = F.col("elevation")
    carry = {
        "c": center,
        "gx": gx,
        "s": units(F.col("_l")) + units(F.col("_r")) + F.coalesce(v, F.lit(0)) * (1 + edge),
        "k": present(F.col("_l")) + present(F.col("_r")) + present(center) * (1 + edge),
        "hi": F.greatest(center, F.col("_l"), F.col("_r")),
        "lo": F.least(center, F.col("_l"), F.col("_r")),
    }
    m = _column_pass(r, carry, height)
    twice = F.when((F.col("dy") == 0), 1 + F.when(F.col("y") == 0, 1).otherwise(0)
                   + F.when(F.col("y") == F.col("_h") - 1, 1).otherwise(0)).otherwise(1)
    here = F.col("dy") == 0
    agg = m.groupBy("y", "x").agg(
        F.max(F.when(here, F.col("c"))).alias("c"), F.max(F.when(here, F.col("gx"))).alias("gx"),
        F.max(F.when(F.col("dy") == 1, F.col("c"))).alias("up"), F.max(F.when(F.col("dy") == -1, F.col("c"))).alias("down"),
        F.sum(F.col("s") * twice).alias("s"), F.sum(F.col("k") * twice).alias("k"),
        F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("_h").alias("_h"),
    ).where(F.col("c").isNotNull())
    gy = _difference("c", "up", "down", "y", "_h", resolution)
    return agg.select(
        "y", "x", F.col("c").alias("elevation"),
        F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + gy * gy))).alias("slope"),
        F.greatest(F.col("hi") - F.col("c"), F.col("c") - F.col("lo")).alias("ruggedness"),
        (F.col("c") - F.col("s") / (F.col("k") * float(scale))).alias("tpi"),
    )


def terrain_summary(derived: DataFrame) -> DataFrame:
    p95 = exact_quantiles(derived.select(F.round("slope", 6).alias("slope")), "slope", [0.95]).scalar()
    micro = F.round(F.col("slope") * 1e6).cast("bigint")
    milli = F.round(F.col("elevation") * 1e3).cast("bigint")
    return derived.agg(
        F.count(F.lit(1)).alias("cell_count"), F.min("elevation").alias("min_elevation"), F.max("elevation").alias("max_elevation"),
        F.round(F.sum(milli) / (F.count("elevation") * 1e3), 4).alias("mean_elevation"),
        F.round(F.sum(micro) / (F.count("slope") * 1e6), 4).alias("mean_slope"),
    ).withColumn("slope_p95", F.round(F.get(p95, 0), 4))


def stretch_limits(df: DataFrame, value: str) -> DataFrame:
    q = exact_quantiles(df, value, [0.02, 0.98])
    return q.select(F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))


def gradient_magnitude(cells: DataFrame, value: str, height: Column, width: Column) -> DataFrame:
    """Gradient of the 2-98 percent stretched band; nodata counts as 0 for neighbours and stays nodata itself."""
    lim = stretch_limits(cells, value).select(F.struct("low", "high")).scalar()
    st = cells.withColumn("_lim", lim).withColumn(
        "_s", stretch01(F.col(value), F.col("_lim.low"), F.col("_lim.high"))
    ).withColumn("_z", F.coalesce("_s", F.lit(0.0)))
    r = _row_pass(st, "_z", width)
    gx = _difference("_z", "_l", "_r", "x", "_w", 1.0)
    m = _column_pass(r, {"z": F.col("_z"), "gx": gx, "ok": F.col("_s").isNotNull()}, height)
    here = F.col("dy") == 0
    agg = m.groupBy("y", "x").agg(
        F.max(F.when(here, F.col("z"))).alias("z"), F.max(F.when(here, F.col("gx"))).alias("gx"), F.max(F.when(here, F.col("ok"))).alias("ok"),
        F.max(F.when(F.col("dy") == 1, F.col("z"))).alias("up"), F.max(F.when(F.col("dy") == -1, F.col("z"))).alias("down"),
        F.max("_h").alias("_h"),
    )
    gy = _difference("z", "up", "down", "y", "_h", 1.0)
    return agg.where("ok").select("y", "x", F.sqrt(F.col("gx") * F.col("gx") + gy * gy).alias("gradient"))


def block_mean(cells: DataFrame, value: str, stride: int, scale: int = 1000) -> DataFrame:
    units = F.round(F.col(value) * scale).cast("bigint")
    return cells.groupBy(F.floor(F.col("y") / stride).alias("y"), F.floor(F.col("x") / stride).cast("int").alias("x")).agg(
        (F.sum(units) / (F.nullif(F.count(value), F.lit(0)) * float(scale))).alias(value))


def _shift_moments(block: pa.Table, reach: int, side: int) -> pa.Table:
    """Count and five sums of one block under every shift; the block's target cells include its border."""
    mine, y, x, v = (block.column(c).to_numpy() for c in ("is_reference", "y", "x", "v"))
    y0, x0 = block.column("by")[0].as_py() * side, block.column("bx")[0].as_py() * side
    r = np.full((side, side), np.nan)
    t = np.full((side + 2 * reach, side + 2 * reach), np.nan)
    r[y[mine] - y0, x[mine] - x0] = v[mine]
    t[y[~mine] - y0 + reach, x[~mine] - x0 + reach] = v[~mine]
    rows = []
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            other = t[reach - dy:reach - dy + side, reach - dx:reach - dx + side]
            both = ~np.isnan(r) & ~np.isnan(other)
            p, q = r[both], other[both]
            if len(p):
                rows.append((dy, dx, len(p), p.sum(), q.sum(), (p * p).sum(), (q * q).sum(), (p * q).sum()))
    columns = list(zip(*rows)) or [[]] * len(_MOMENTS)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(_MOMENTS.items(), columns)})


def halo_blocks(cells: DataFrame, side: int, reach: int = 0) -> DataFrame:
    """Cells with the blocks (by, bx) of `side` cells whose area, widened by `reach`, holds them; a cell has four copies at most."""

    def blocks(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))

    return cells.withColumn("by", F.explode(blocks("y"))).withColumn("bx", F.explode(blocks("x")))


def shift_correlations(reference: DataFrame, target: DataFrame, value: str, reach: int = 3, min_samples: int = 500,
                       side: int = 64) -> DataFrame:
    """Pearson correlation of two rasters under every integer shift within reach.

    Each block of `side` x `side` cells gets the border of the target around it once, sums
    its moments for all shifts by itself, and only these few sums travel on. So little more
    than the two rasters is shuffled, whatever the number of shifts, and a group is a block.
    """
    if reach > side:
        raise ValueError("reach must not exceed the side of a block")

    def prepared(cells: DataFrame, is_reference: bool) -> DataFrame:
        some = cells.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.lit(is_reference).alias("is_reference"), "y", "x", F.col(value).alias("v"))
        return halo_blocks(some, side, 0 if is_reference else reach)

    moments = prepared(reference, True).unionByName(prepared(target, False)).groupBy("by", "bx").applyInArrow(
        lambda block: _shift_moments(block, reach, side),
        "dy int, dx int, n bigint, sr double, st double, srr double, stt double, srt double")
    sums = moments.groupBy("dy", "dx").agg(F.sum("n").alias("samples"), *[F.sum(c).alias(c) for c in ("sr", "st", "srr", "stt", "srt")])
    n = F.col("samples")
    var_r, var_t = F.col("srr") - F.col("sr") * F.col("sr") / n, F.col("stt") - F.col("st") * F.col("st") / n
    c = (F.col("srt") - F.col("sr") * F.col("st") / n) / F.sqrt(F.nullif(F.greatest(var_r, F.lit(0.0)) * F.greatest(var_t, F.lit(0.0)), F.lit(0.0)))
    return sums.select("dy", "dx", "samples", F.when(n >= min_samples, F.round(c, 8)).alias("correlation"))


def best_shift(correlations: DataFrame, stride: int, warn_pixels: int = 10, resolution: float = 10.0) -> DataFrame:
    best = F.max(F.struct("correlation", (-F.col("dy")).alias("ny"), (-F.col("dx")).alias("nx"), "samples"))
    b = correlations.where(F.col("correlation").isNotNull()).agg(best.alias("b"))
    dy, dx = -F.col("b.ny") * stride, -F.col("b.nx") * stride
    far = F.greatest(F.abs(dy), F.abs(dx))
    return b.select(
        dy.alias("dy_pixels"), dx.alias("dx_pixels"), F.col("b.correlation").alias("correlation"), F.col("b.samples").alias("samples"),
        (far * resolution).alias("shift_m"), F.when(far > warn_pixels, "warning").otherwise("passed").alias("status"),
        F.when(F.col("b.correlation") >= 0.45, "strong").otherwise("weak").alias("agreement"),
    )


def grid_mismatches(meta: DataFrame, g: MasterGrid = GRID) -> DataFrame:
    """Header rows with the list of fields that break the grid contract."""

    def off(name: str, want: tuple[float, ...]) -> Column:
        lit = F.array(*[F.lit(float(v)) for v in want])
        return ~F.forall(F.zip_with(name, lit, lambda a, b: F.abs(a - b)), lambda e: e <= g.tolerance)

    found = F.array_compact(F.array(
        F.when(F.col("crs") != g.crs, "crs"),
        F.when((F.col("width") != g.width) | (F.col("height") != g.height), "shape"),
        F.when(off("affine", g.affine), "transform"),
        F.when(off("bounds", g.bounds), "bounds"),
        F.when(F.lit(g.check_dtype) & (F.col("dtype") != g.dtype), "dtype"),
    ))
    return meta.withColumn("mismatches", found)


def alignment_report(meta: DataFrame, g: MasterGrid = GRID, slack: float = 2.0) -> DataFrame:
    b = F.col("bounds")
    inside = (
        (F.get(b, 0) >= g.left - slack) & (F.get(b, 1) >= g.bottom - slack)
        & (F.get(b, 2) <= g.right + slack) & (F.get(b, 3) <= g.top + slack)
    )
    bad = F.count(F.when(F.size("mismatches") > 0, 1))
    out = F.count(F.when(~inside, 1))
    return grid_mismatches(meta, g).groupBy("family").agg(
        F.count(F.lit(1)).alias("checked"), bad.alias("mismatched"), out.alias("outside_grid"),
        F.when((bad == 0) & (out == 0), "ok").otherwise("needs_attention").alias("status"),
    )


def usable_sources(meta: DataFrame, g: MasterGrid = GRID) -> DataFrame:
    """Optional sources on the contract grid; the others are ignored."""
    return grid_mismatches(meta, g).where(F.size("mismatches") == 0).drop("mismatches")


def inside_ring(pixels: DataFrame, ring: Column) -> DataFrame:
    """Flag pixels whose centre lies in the ring; a bounding-box test goes first."""
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    xs, ys = F.transform("_ring", lambda p: p["x"]), F.transform("_ring", lambda p: p["y"])
    box = px.between(F.array_min(xs), F.array_max(xs)) & py.between(F.array_min(ys), F.array_max(ys))
    return pixels.withColumn("_ring", ring).withColumn(
        "in_aoi", F.when(box, point_in_ring(px, py, F.col("_ring"))).otherwise(False)
    ).drop("_ring")


def ring_cells(ring: DataFrame) -> DataFrame:
    """(y, x) of the unit cells whose inside the outline of a ring crosses, from rows (ring) of closed rings.

    Each edge is walked row by row: its part within a row spans an interval, and the cells of that
    interval and one more on either side are candidates. So there are as many rows as cells along the
    outline, not pixels times edges. A candidate is touched if the shares of the edge that lie between
    its columns and between its rows overlap; no share is computed from another, so corners are exact.
    """
    n = F.size("ring") - 1
    edge = F.explode(F.zip_with(F.slice("ring", 1, n), F.slice("ring", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    e = ring.select(edge.alias("e")).select(*[F.col(f"e.{p}.{c}").alias(f"{c}{p}") for p in "ab" for c in "xy"]).withColumns(
        {"dx": F.col("xb") - F.col("xa"), "dy": F.col("yb") - F.col("ya")})
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    rows = e.withColumn("y", F.explode(F.sequence(F.floor(low) - 1, F.ceil(high))))

    def x_at(y: Column) -> Column:
        share = F.coalesce((F.least(F.greatest(y, low), high) - F.col("ya")) / F.nullif(F.col("dy"), F.lit(0.0)), F.lit(0.0))
        return F.col("xa") + F.col("dx") * share

    ends = [x_at(F.col("y").cast("double")), x_at(F.col("y") + 1.0)]
    flat = [F.when(F.col("dy") == 0, F.col(c)) for c in ("xa", "xb")]
    cells = rows.withColumn("x", F.explode(F.sequence(F.floor(F.least(*ends, *flat)) - 1, F.ceil(F.greatest(*ends, *flat)))))

    def within(c: str) -> tuple[Column, Column, Column]:
        """First and last share of the edge between the two lines around a cell, and whether an edge along them lies inside."""
        at, d, cell = F.col(f"{c}a"), F.nullif(F.col(f"d{c}"), F.lit(0.0)), F.col(c)
        one, other = (cell - at) / d, (cell + 1 - at) / d
        inside = d.isNotNull() | ((at > cell) & (at < cell + 1))
        return F.coalesce(F.least(one, other), F.lit(0.0)), F.coalesce(F.greatest(one, other), F.lit(1.0)), inside

    (x_first, x_last, x_in), (y_first, y_last, y_in) = within("x"), within("y")
    first, last = F.greatest(x_first, y_first), F.least(x_last, y_last)
    return cells.where(x_in & y_in & (first < last) & (first < 1) & (last > 0)).select("y", "x").distinct()


def touched_by_ring(pixels: DataFrame, ring: DataFrame) -> DataFrame:
    """Pixels with `in_aoi` where the centre lies in the ring or its outline crosses the pixel."""
    inside = inside_ring(pixels, ring.scalar())
    cells = ring_cells(ring).select(F.col("y").cast(pixels.schema["y"].dataType), F.col("x").cast(pixels.schema["x"].dataType), F.lit(True).alias("_hit"))
    return inside.join(cells, ["y", "x"], "left").withColumn("in_aoi", F.col("in_aoi") | F.coalesce("_hit", F.lit(False))).drop("_hit")
