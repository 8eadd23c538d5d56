"""Terrain, registration, grid audit and area-of-interest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.operators import terrain as tr
from landshift.plans.registry import query, view
from landshift.session import cut_lineage
from landshift.sources import observations as obs

view("hol", "SELECT y, x, CASE WHEN (y + x) % 11 <> 0 THEN elevation END AS elevation FROM terrain")
view("ext", "SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM terrain")


def deriv_sql(t: str) -> str:
    return f"""
SELECT y, x, elevation, CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN degrees(atan(sqrt(gx*gx + gy*gy))) END AS slope,
  greatest(hi - elevation, elevation - lo) AS ruggedness, elevation - s / (k * 1000e0) AS tpi FROM (
  SELECT c.y, c.x, any_value(c.elevation) AS elevation, max(n.elevation) AS hi, min(n.elevation) AS lo,
    sum(CAST(round(n.elevation * 1000) AS BIGINT)) AS s, count(n.elevation) AS k,
    CASE WHEN c.x = 0 THEN (max(n.elevation) FILTER (o.dy = 0 AND o.dx = 1) - any_value(c.elevation)) / 10
         WHEN c.x = any_value(e.w) - 1 THEN (any_value(c.elevation) - max(n.elevation) FILTER (o.dy = 0 AND o.dx = -1)) / 10
         ELSE (max(n.elevation) FILTER (o.dy = 0 AND o.dx = 1) - max(n.elevation) FILTER (o.dy = 0 AND o.dx = -1)) / 20 END AS gx,
    CASE WHEN c.y = 0 THEN (max(n.elevation) FILTER (o.dx = 0 AND o.dy = 1) - any_value(c.elevation)) / 10
         WHEN c.y = any_value(e.h) - 1 THEN (any_value(c.elevation) - max(n.elevation) FILTER (o.dx = 0 AND o.dy = -1)) / 10
         ELSE (max(n.elevation) FILTER (o.dx = 0 AND o.dy = 1) - max(n.elevation) FILTER (o.dx = 0 AND o.dy = -1)) / 20 END AS gy
  FROM {t} c CROSS JOIN ext e CROSS JOIN (SELECT a.d AS dy, b.d AS dx FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d)) o
  JOIN {t} n ON n.y = greatest(0, least(e.h - 1, c.y + o.dy)) AND n.x = greatest(0, least(e.w - 1, c.x + o.dx))
  WHERE c.elevation IS NOT NULL GROUP BY c.y, c.x)"""


view("deriv", deriv_sql("terrain"))
view("deriv_h", deriv_sql("hol"))
DERIV = "SELECT y, x, elevation, round(slope, 6) AS slope, round(ruggedness, 6) AS ruggedness, round(tpi, 6) AS tpi FROM "


def extent(spark, d):
    h = obs.table(spark, d, "embeddings").agg(F.max("vec_id") + 1).scalar()
    return h, F.lit(64)


def derivatives(spark, d, holes=False):
    return tr.terrain_derivatives(obs.terrain(spark, d, holes), *extent(spark, d))


def _rounded(df):
    return df.select("y", "x", "elevation", *[F.round(c, 6).alias(c) for c in ("slope", "ruggedness", "tpi")])


@query("terrain_derivatives", DERIV + "deriv")
def terrain_derivatives(spark, d):
    return _rounded(derivatives(spark, d))


@query("terrain_derivatives_with_holes", DERIV + "deriv_h")
def terrain_derivatives_with_holes(spark, d):
    return _rounded(derivatives(spark, d, True))


@query("terrain_summary", """
SELECT count(*) AS cell_count, min(elevation) AS min_elevation, max(elevation) AS max_elevation,
  round(sum(CAST(round(elevation * 1e3) AS BIGINT)) / (count(elevation) * 1e3), 4) AS mean_elevation,
  round(sum(CAST(round(slope * 1e6) AS BIGINT)) / (count(slope) * 1e6), 4) AS mean_slope, round(quantile_cont(round(slope, 6), 0.95), 4) AS slope_p95 FROM deriv_h""")
def terrain_summary(spark, d):
    return tr.terrain_summary(derivatives(spark, d, True))


@query("stretch_limits", """
SELECT round(quantile_cont(nir, 0.02), 6) AS low, round(quantile_cont(nir, 0.98), 6) AS high FROM px""")
def stretch_limits(spark, d):
    return tr.stretch_limits(obs.pixels(spark, d), "nir").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


view("strd", """
SELECT y, x, elevation IS NOT NULL AS ok, coalesce(least(greatest((elevation - lo) / (hi - lo), 0e0), 1e0), 0e0) AS z
FROM hol, (SELECT quantile_cont(elevation, 0.02) AS lo, quantile_cont(elevation, 0.98) AS hi FROM hol)""")
view("grad", """
SELECT c.y, c.x, sqrt(gx * gx + gy * gy) AS gradient FROM (
  SELECT c.y, c.x, c.ok,
    CASE WHEN c.x = 0 THEN r.z - c.z WHEN c.x = e.w - 1 THEN c.z - l.z ELSE (r.z - l.z) / 2 END AS gx,
    CASE WHEN c.y = 0 THEN b.z - c.z WHEN c.y = e.h - 1 THEN c.z - u.z ELSE (b.z - u.z) / 2 END AS gy
  FROM strd c CROSS JOIN ext e LEFT JOIN strd l ON l.y = c.y AND l.x = c.x - 1 LEFT JOIN strd r ON r.y = c.y AND r.x = c.x + 1
  LEFT JOIN strd u ON u.x = c.x AND u.y = c.y - 1 LEFT JOIN strd b ON b.x = c.x AND b.y = c.y + 1) c WHERE ok""")


def gradient(spark, d):
    return tr.gradient_magnitude(obs.terrain(spark, d, True), "elevation", *extent(spark, d))


@query("image_gradient", "SELECT y, x, round(gradient, 6) AS gradient FROM grad")
def image_gradient(spark, d):
    return gradient(spark, d).select("y", "x", F.round("gradient", 6).alias("gradient"))


view("ref_blocks", "SELECT y // 4 AS y, x // 4 AS x, sum(CAST(round(round(gradient, 6) * 1e6) AS BIGINT)) / (count(*) * 1e6) AS v FROM grad GROUP BY ALL")
view("tgt_blocks", """
SELECT y // 4 AS y, x // 4 AS x, sum(CAST(round(round(gradient, 6) * 1e6) AS BIGINT)) / (count(*) * 1e6) AS v FROM (
  SELECT y + 4 AS y, x + 8 AS x, gradient FROM grad WHERE x + 8 < 64) GROUP BY ALL""")
view("shifts", """
SELECT dy, dx, count(*) AS samples, CASE WHEN count(*) >= 500 THEN round(corr(r.v, t.v), 8) END AS correlation
FROM (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest(range(-3, 4)) AS d) a, (SELECT unnest(range(-3, 4)) AS d) b) s
JOIN tgt_blocks t ON true JOIN ref_blocks r ON r.y = t.y + dy AND r.x = t.x + dx GROUP BY 1, 2""")


def shifts(spark, d):
    g = cut_lineage(gradient(spark, d).withColumn("gradient", F.round("gradient", 6)))
    moved = g.select((F.col("y") + 4).alias("y"), (F.col("x") + 8).alias("x"), "gradient").where("x < 64")
    return tr.shift_correlations(tr.block_mean(g, "gradient", 4, 1_000_000), tr.block_mean(moved, "gradient", 4, 1_000_000), "gradient")


@query("shift_correlations", "SELECT CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, samples, correlation FROM shifts")
def shift_correlations(spark, d):
    return shifts(spark, d)


@query("best_shift", """
SELECT CAST(dy * 4 AS INTEGER) AS dy_pixels, CAST(dx * 4 AS INTEGER) AS dx_pixels, correlation, samples,
  greatest(abs(dy), abs(dx)) * 40e0 AS shift_m, CASE WHEN greatest(abs(dy), abs(dx)) * 4 > 10 THEN 'warning' ELSE 'passed' END AS status,
  CASE WHEN correlation >= 0.45e0 THEN 'strong' ELSE 'weak' END AS agreement
FROM shifts WHERE correlation IS NOT NULL ORDER BY correlation DESC, dy, dx LIMIT 1""")
def best_shift(spark, d):
    return tr.best_shift(shifts(spark, d), 4)


view("meta", """
SELECT s_suppkey AS id, 'family_' || (s_nationkey % 7) AS family, s_suppkey % 11 = 5 AS bad_crs, s_suppkey % 13 = 6 AS bad_shape,
  s_suppkey % 10 IN (3, 7) AS bad_off, s_suppkey % 10 = 7 AS leaves FROM supplier""")


@query("grid_mismatches", """
SELECT id, family, concat_ws(',', CASE WHEN bad_crs THEN 'crs' END, CASE WHEN bad_shape THEN 'shape' END,
  CASE WHEN bad_off THEN 'transform' END, CASE WHEN bad_off THEN 'bounds' END) AS mismatches FROM meta""")
def grid_mismatches(spark, d):
    return tr.grid_mismatches(obs.raster_meta(spark, d)).select("id", "family", F.array_join("mismatches", ",").alias("mismatches"))


@query("alignment_report", """
SELECT family, count(*) AS checked, count(*) FILTER (bad_crs OR bad_shape OR bad_off) AS mismatched, count(*) FILTER (leaves) AS outside_grid,
  CASE WHEN count(*) FILTER (bad_crs OR bad_shape OR bad_off OR leaves) = 0 THEN 'ok' ELSE 'needs_attention' END AS status FROM meta GROUP BY family""")
def alignment_report(spark, d):
    return tr.alignment_report(obs.raster_meta(spark, d))


@query("usable_sources", "SELECT family, count(*) AS source_count FROM meta WHERE NOT (bad_crs OR bad_shape OR bad_off) GROUP BY family")
def usable_sources(spark, d):
    return tr.usable_sources(obs.raster_meta(spark, d)).groupBy("family").agg(F.count(F.lit(1)).alias("source_count"))


# area of interest: a pentagon as tall as the raster
view("aoi_ring", """
SELECT [{'x': 3e0, 'y': 0e0}, {'x': 50e0, 'y': h * 0.1e0}, {'x': 53e0, 'y': h * 0.8e0}, {'x': 30e0, 'y': h * 1e0}, {'x': 5e0, 'y': h * 0.6e0}, {'x': 3e0, 'y': 0e0}] AS ring
FROM (SELECT max(p_partkey) // 8 + 1 AS h FROM part)""")
view("aoi_px", """
SELECT p.*, (SELECT count(*) FROM (SELECT r.ring[i] AS a, r.ring[i + 1] AS b FROM aoi_ring r, (SELECT unnest(range(1, 6)) AS i))
   WHERE (a.y > p.y + 0.5e0) <> (b.y > p.y + 0.5e0) AND p.x + 0.5e0 < (b.x - a.x) * (p.y + 0.5e0 - a.y) / (b.y - a.y) + a.x) % 2 = 1 AS in_aoi
FROM (SELECT scene, y, x, s1, s2, s3, s4 FROM px) p""")


def aoi_rings(spark, d):
    """The ring in one row."""
    h = F.floor(F.max("p_partkey") / 8) + 1

    def p(x, f):
        return F.struct(F.lit(float(x)).alias("x"), (h * F.lit(f)).alias("y"))

    return obs.table(spark, d, "part").agg(F.array(p(3, 0.0), p(50, 0.1), p(53, 0.8), p(30, 1.0), p(5, 0.6), p(3, 0.0)).alias("ring"))


def aoi_ring(spark, d):
    return aoi_rings(spark, d).scalar()


@query("aoi_mask", "SELECT scene, y, x, in_aoi FROM aoi_px")
def aoi_mask(spark, d):
    return tr.inside_ring(obs.pixels(spark, d).select("scene", "y", "x"), aoi_ring(spark, d))


@query("outside_aoi_counts", """
SELECT 'source_' || i AS layer, count(*) FILTER (NOT in_aoi AND CASE i WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END > 0) AS labeled_outside,
  count(*) FILTER (in_aoi AND CASE i WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END > 0) AS labeled_inside FROM aoi_px, (SELECT unnest(range(1, 5)) AS i) GROUP BY i""")
def outside_aoi_counts(spark, d):
    px = tr.inside_ring(obs.pixels(spark, d), aoi_ring(spark, d))
    wide = px.agg(*[
        F.count(F.when((F.col("in_aoi") == v) & (F.col(f"s{i}") > 0), 1)).alias(f"n{i}_{int(v)}") for i in range(1, 5) for v in (True, False)
    ])
    rows = F.explode(F.array(*[
        F.struct(F.lit(f"source_{i}").alias("layer"), F.col(f"n{i}_0").alias("labeled_outside"), F.col(f"n{i}_1").alias("labeled_inside"))
        for i in range(1, 5)
    ]))
    return wide.select(rows.alias("r")).select("r.*")


view("aoi_hit", """
SELECT DISTINCT y, x FROM (
  SELECT y, x, CASE WHEN dx = 0 THEN 0e0 ELSE least((x - ax) / dx, (x + 1 - ax) / dx) END AS x_lo, CASE WHEN dx = 0 THEN 1e0 ELSE greatest((x - ax) / dx, (x + 1 - ax) / dx) END AS x_hi,
    CASE WHEN dy = 0 THEN 0e0 ELSE least((y - ay) / dy, (y + 1 - ay) / dy) END AS y_lo, CASE WHEN dy = 0 THEN 1e0 ELSE greatest((y - ay) / dy, (y + 1 - ay) / dy) END AS y_hi,
    dx <> 0 OR (ax > x AND ax < x + 1) AS x_ok, dy <> 0 OR (ay > y AND ay < y + 1) AS y_ok
  FROM (SELECT DISTINCT y, x FROM px) CROSS JOIN (
    SELECT a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM (SELECT r.ring[i] AS a, r.ring[i + 1] AS b FROM aoi_ring r, (SELECT unnest(range(1, 6)) AS i))))
WHERE x_ok AND y_ok AND greatest(x_lo, y_lo) < least(x_hi, y_hi) AND greatest(x_lo, y_lo) < 1 AND least(x_hi, y_hi) > 0""")


@query("aoi_mask_touched", """
SELECT scene, p.y, p.x, in_aoi OR h.y IS NOT NULL AS in_aoi FROM aoi_px p LEFT JOIN aoi_hit h ON h.y = p.y AND h.x = p.x""")
def aoi_mask_touched(spark, d):
    """The area of interest with every pixel that its outline crosses."""
    return tr.touched_by_ring(obs.pixels(spark, d).select("scene", "y", "x"), aoi_rings(spark, d)).select("scene", "y", "x", "in_aoi")
