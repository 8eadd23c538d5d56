"""Grid, map projection, tile and plane-geometry expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from landshift.config import GRID, MasterGrid

HALF_WORLD = 20037508.342789244  # fixed value: half the Web Mercator circumference in metres


def pixel_to_map(row: Column, col: Column, g: MasterGrid = GRID, center: bool = True) -> tuple[Column, Column]:
    half = 0.5 if center else 0.0
    return g.left + (col + half) * g.resolution, g.top - (row + half) * g.resolution


def map_to_pixel(x: Column, y: Column, g: MasterGrid = GRID) -> tuple[Column, Column, Column]:
    """(row, col, inside) of a map point."""
    row = F.floor((g.top - y) / g.resolution)
    col = F.floor((x - g.left) / g.resolution)
    inside = (row >= 0) & (row < g.height) & (col >= 0) & (col < g.width)
    return row, col, inside


def segments(path: Column) -> Column:
    """Consecutive pairs of path points as struct(a, b)."""
    n = F.size(path) - 1
    return F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ray_crosses(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """A ray from a point along x crosses the segment; an odd number of a ring's segments is crossed from inside."""
    straddles = (ay > py) != (by > py)
    return F.when(straddles, px < (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax).otherwise(False)


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting over a closed ring of struct(x, y)."""
    return F.size(F.filter(segments(ring), lambda e: ray_crosses(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))) % 2 == 1


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(len2, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def line_distance(px: Column, py: Column, line: Column) -> Column:
    """Distance of a point to a polyline of struct(x, y)."""
    parts = F.zip_with(
        F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1),
        lambda a, b: segment_distance(px, py, a["x"], a["y"], b["x"], b["y"]),
    )
    return F.array_min(parts)


# --- transverse Mercator (Krueger series to n^4) ---------------------------------
# fixed values: WGS 84 ellipsoid and UTM constants
_A, _F, _K0, _E0, _N0_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_n = _F / (2 - _F)
_AA = _A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
_BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)
_DELTA = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
)


def utm_to_lonlat(x: Column, y: Column, zone: int = 35, south: bool = True) -> tuple[Column, Column]:
    lon0 = zone * 6 - 183
    xi = (y - (_N0_SOUTH if south else 0.0)) / (_K0 * _AA)
    eta = (x - _E0) / (_K0 * _AA)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, dj in enumerate(_DELTA, start=1):
        lat = lat + dj * F.sin(2 * j * chi)
    return lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def lonlat_to_utm(lon: Column, lat: Column, zone: int = 35, south: bool = True) -> tuple[Column, Column]:
    lon0 = zone * 6 - 183
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    e = 2 * math.sqrt(_n) / (1 + _n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi1 = F.atan2(t, F.cos(lam))
    eta1 = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, a in enumerate(_ALPHA, start=1):
        xi = xi + a * F.sin(2 * j * xi1) * F.cosh(2 * j * eta1)
        eta = eta + a * F.cos(2 * j * xi1) * F.sinh(2 * j * eta1)
    return _E0 + _K0 * _AA * eta, (_N0_SOUTH if south else 0.0) + _K0 * _AA * xi


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = HALF_WORLD / math.pi
    return r * F.radians(lon), r * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def mercator_to_tile(x: Column, y: Column, zoom: Column) -> tuple[Column, Column]:
    span = 2 * HALF_WORLD / F.pow(F.lit(2.0), zoom)
    last = F.pow(F.lit(2.0), zoom) - 1

    def clamp(v: Column) -> Column:
        return F.least(F.greatest(F.floor(v), F.lit(0)), last).cast("bigint")

    return clamp((x + HALF_WORLD) / span), clamp((HALF_WORLD - y) / span)


def ring_bbox_center(ring: Column) -> tuple[Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return (F.array_min(xs) + F.array_max(xs)) / 2, (F.array_min(ys) + F.array_max(ys)) / 2


# --- display --------------------------------------------------------------------
def stretch01(v: Column, low: Column, high: Column) -> Column:
    top = F.when(F.abs(high - low) < 1e-8, low + 1).otherwise(high)
    return F.when(v.isNotNull(), F.least(F.greatest((v - low) / (top - low), F.lit(0.0)), F.lit(1.0)))


def ramp_channel(v: Column, stops: tuple[int, ...]) -> Column:
    """Piecewise-linear colour channel over evenly spaced stops, truncated to an integer."""
    last = len(stops) - 1
    i = F.least(F.floor(v * last), F.lit(last - 1)).cast("int")
    arr = F.array(*[F.lit(float(s)) for s in stops])
    return F.floor(F.get(arr, i) + (F.get(arr, i + 1) - F.get(arr, i)) * (v * last - i)).cast("int")


# --- cells ----------------------------------------------------------------------
def segment_hits_cell(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Segment passes through the open unit cell whose lower corner is (cx, cy)."""

    def slab(a: Column, d: Column, low: Column) -> tuple[Column, Column, Column]:
        inv = F.nullif(d, F.lit(0.0))
        t1, t2 = (low - a) / inv, (low + 1 - a) / inv
        still = (a > low) & (a < low + 1)
        lo = F.when(d == 0, F.lit(0.0)).otherwise(F.least(t1, t2))
        hi = F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(t1, t2))
        return lo, hi, F.when(d == 0, still).otherwise(True)

    x_lo, x_hi, x_ok = slab(ax, bx - ax, cx)
    y_lo, y_hi, y_ok = slab(ay, by - ay, cy)
    enter, leave = F.greatest(x_lo, y_lo), F.least(x_hi, y_hi)
    return x_ok & y_ok & (enter < leave) & (enter < 1) & (leave > 0)


def corner_distances(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> list[Column]:
    """From a unit cell's corners to the segment and from its ends to the cell: the least is their distance where they do not meet."""

    def to_cell(px: Column, py: Column) -> Column:
        dx = F.greatest(cx - px, F.lit(0.0), px - (cx + 1))
        dy = F.greatest(cy - py, F.lit(0.0), py - (cy + 1))
        return F.sqrt(dx * dx + dy * dy)

    corners = [segment_distance(cx + i, cy + j, ax, ay, bx, by) for i in (0.0, 1.0) for j in (0.0, 1.0)]
    return [*corners, to_cell(ax, ay), to_cell(bx, by)]


def segment_cell_distance(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Distance between a segment and a unit cell, 0 when they meet."""
    return F.when(segment_hits_cell(ax, ay, bx, by, cx, cy), F.lit(0.0)).otherwise(F.least(*corner_distances(ax, ay, bx, by, cx, cy)))


def any_segment(path: Column, test) -> Column:
    """True when `test(a, b)` holds for some consecutive pair of path points."""
    return F.exists(segments(path), lambda s: test(s["a"], s["b"]))
