"""Overlap mosaics, resampling, rasterising, tiles, projection and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.config import CLASS_COLORS, GRID, OPACITY, RAMPS
from landshift.functions import geo, labels as lb
from landshift.operators import classify, patches as pt, raster as rs, terrain as tr, votes
from landshift.operators.overlay import INDICES
from landshift.plans.labels import SOURCES, vector_shapes
from landshift.plans.patches import weights
from landshift.operators.quantiles import exact_quantiles_by
from landshift.plans.registry import query, view
from landshift.plans.terrain import aoi_ring, extent
from landshift.plans.twins import lonlat_ctes
from landshift.sources import observations as obs
from landshift.storage import store

WK = [f"((sum_supp * {k} + sum_ord + wrow + 2 * wcol) % 11 + 1)" for k in range(1, 6)]
SUMW = " + ".join(f"w{k}" for k in range(1, 6))
view("wpx", "SELECT *, " + ", ".join(f"{w} AS w{k}" for k, w in enumerate(WK, 1)) + """ FROM (
  SELECT scene, y, x, ndvi IS NOT NULL AND ratio IS NOT NULL AS ok, sum_supp, sum_ord, y // 8 - a AS wrow, x // 8 - b AS wcol
  FROM feat, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) WHERE y // 8 >= a AND x // 8 >= b)""")


def ent(e):
    return "-(" + " + ".join(f"least(greatest({e(k)}, 1e-7), 1e0) * ln(least(greatest({e(k)}, 1e-7), 1e0))" for k in range(1, 6)) + ") / ln(5e0)"


view("wout", f"""
SELECT scene, y, x, ok, wrow, wcol, w1, w2, w3, w4, w5, wt,
  CASE greatest(w1, w2, w3, w4, w5) WHEN w1 THEN 1 WHEN w2 THEN 2 WHEN w3 THEN 3 WHEN w4 THEN 4 ELSE 5 END AS cls,
  greatest(w1, w2, w3, w4, w5) / CAST(wt AS DOUBLE) AS confidence, round({ent(lambda k: f'w{k} / CAST(wt AS DOUBLE)')}, 9) AS entropy
FROM (SELECT *, {SUMW} AS wt FROM wpx)""")
view("vmos", """
SELECT scene, y, x, coverage, CASE m WHEN k1 THEN 1 WHEN k2 THEN 2 WHEN k3 THEN 3 WHEN k4 THEN 4 ELSE 5 END AS mosaic_class, confidence, entropy FROM (
  SELECT *, greatest(k1, k2, k3, k4, k5) AS m FROM (SELECT scene, y, x, count(*) AS coverage, """ + ", ".join(
    f"count(*) FILTER (cls = {k}) AS k{k}" for k in range(1, 6)) + """,
    sum(CAST(round(confidence * 1e9) AS BIGINT)) / (count(*) * 1e9) AS confidence, sum(CAST(round(entropy * 1e9) AS BIGINT)) / (count(*) * 1e9) AS entropy
  FROM wout GROUP BY 1, 2, 3))""")


def windows(spark, d):
    """Window predictions: every pixel seen by each 16 x 16 window (stride 8) that covers it."""
    from landshift.functions.model import predictive_entropy

    f = obs.features(spark, d).select("scene", "y", "x", "ndvi", "ratio", "sum_supp", "sum_ord")
    w = rs.covering_windows(f, 16, 8)
    raw = F.array(*[(F.col("sum_supp") * k + F.col("sum_ord") + F.col("wrow") + 2 * F.col("wcol")) % 11 + 1 for k in range(1, 6)])
    w = w.withColumn("_w", raw).withColumn("_t", F.aggregate("_w", F.lit(0).cast("bigint"), lambda a, v: a + v))
    return w.withColumns({"probs": F.transform("_w", lambda v: v / F.col("_t")), "window_class": lb.argmax_class(F.col("_w")),
                          "confidence": F.array_max("_w") / F.col("_t")}).withColumn("entropy", F.round(predictive_entropy(F.col("probs"), 5), 9)).drop("_w", "_t")


@query("overlap_mosaic", "SELECT scene, y, x, coverage, mosaic_class, round(confidence, 6) AS confidence, round(entropy, 6) AS entropy FROM vmos")
def overlap_mosaic(spark, d):
    return rs.vote_mosaic(windows(spark, d)).select(
        "scene", "y", "x", "coverage", "mosaic_class", F.round("confidence", 6).alias("confidence"), F.round("entropy", 6).alias("entropy"))


@query("coverage_summary", """
SELECT scene, count(*) AS covered_pixels, round(count(*) / CAST((SELECT (max(p_partkey) // 8 + 1) * 56 FROM part) AS DOUBLE), 6) AS coverage_fraction,
  max(coverage) AS max_coverage, round(sum(CAST(round(confidence * 1e6) AS BIGINT)) / (count(*) * 1e6), 5) AS mean_confidence FROM vmos GROUP BY scene""")
def coverage_summary(spark, d):
    area = obs.table(spark, d, "part").agg((F.floor(F.max("p_partkey") / 8) + 1) * 56).scalar()
    return rs.coverage_summary(rs.vote_mosaic(windows(spark, d)).withColumn("_a", area), F.col("_a"))


PM = ", ".join(f"round(sum(CAST(round(w{k} / CAST(wt AS DOUBLE) * 1e9) AS BIGINT)) / (count(*) * 1e9), 9) AS m{k}" for k in range(1, 6))


@query("probability_mosaic", f"""
SELECT scene, y, x, coverage, CASE greatest(m1, m2, m3, m4, m5) WHEN m1 THEN 1 WHEN m2 THEN 2 WHEN m3 THEN 3 WHEN m4 THEN 4 ELSE 5 END AS model_class,
  round(greatest(m1, m2, m3, m4, m5), 6) AS confidence, round({ent(lambda k: f'm{k}')}, 6) AS entropy
FROM (SELECT scene, y, x, count(*) AS coverage, {PM} FROM wout WHERE ok GROUP BY 1, 2, 3)""")
def probability_mosaic(spark, d):
    m = rs.probability_mosaic(windows(spark, d), F.col("ndvi").isNotNull() & F.col("ratio").isNotNull())
    return m.select("scene", "y", "x", "coverage", "model_class", F.round("confidence", 6).alias("confidence"), F.round("entropy", 6).alias("entropy"))


TARGETS = """tgt AS (SELECT ty, tx FROM ext e, (SELECT unnest(range(0, (SELECT CAST(ceil(h / 0.8e0) AS BIGINT) FROM ext))) AS ty), (SELECT unnest(range(0, 80)) AS tx))"""


@query("resample_nearest", f"""WITH {TARGETS}
SELECT ty, tx, elevation FROM tgt JOIN hol s ON s.y = floor((ty + 0.5e0) * 0.8e0) AND s.x = floor((tx + 0.5e0) * 0.8e0)""")
def resample_nearest(spark, d):
    return rs.resample_nearest(obs.terrain(spark, d, True), "elevation", 0.8, *extent(spark, d))


@query("resample_bilinear", f"""WITH {TARGETS},
c AS (SELECT ty, tx, s.elevation, CAST(round(greatest(0e0, 1 - abs((ty + 0.5e0) * 0.8e0 - 0.5e0 - s.y)) * greatest(0e0, 1 - abs((tx + 0.5e0) * 0.8e0 - 0.5e0 - s.x)) * 1e6) AS BIGINT) AS w
  FROM tgt JOIN hol s ON s.y BETWEEN floor((ty + 0.5e0) * 0.8e0 - 0.5e0) AND floor((ty + 0.5e0) * 0.8e0 - 0.5e0) + 1
   AND s.x BETWEEN floor((tx + 0.5e0) * 0.8e0 - 0.5e0) AND floor((tx + 0.5e0) * 0.8e0 - 0.5e0) + 1 WHERE s.elevation IS NOT NULL)
SELECT ty, tx, round(sum(w * CAST(round(elevation * 1000) AS BIGINT)) / (sum(w) * 1000e0), 5) AS elevation FROM c WHERE w > 0 GROUP BY 1, 2""")
def resample_bilinear(spark, d):
    return rs.resample_bilinear(obs.terrain(spark, d, True), "elevation", 0.8, *extent(spark, d)).select(
        "ty", "tx", F.round("elevation", 5).alias("elevation"))


CLASS_SQL = """CASE left(o_orderpriority, 1) WHEN '1' THEN 1 WHEN '2' THEN 1 WHEN '3' THEN CASE o_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 1 END END"""


@query("rasterized_polygons", f"""
SELECT y, x, arg_max(class_id, id) AS class_id, max(id) AS feature_id FROM (
  SELECT o_orderkey AS id, {CLASS_SQL} AS class_id, o_orderkey // 53 + unnest([0, 1]) AS y, x FROM (
    SELECT *, o_orderkey % 53 + unnest(range(0, o_custkey % 3 + 1)) AS x FROM orders WHERE o_orderkey % 5 > 2)) WHERE class_id IS NOT NULL GROUP BY y, x""")
def rasterized_polygons(spark, d):
    return rs.rasterize(vector_shapes(spark, d).where("shape = 'polygon'"), 0.8)


def corner_sql(i, j):
    t = f"least(greatest(((x + {i} - ax) * (ex - ax) + (y + {j} - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0e0), 1e0)"
    return f"sqrt(pow(x + {i} - ax - {t} * (ex - ax), 2) + pow(y + {j} - ay - {t} * (ey - ay), 2))"


def end_sql(px, py):
    return f"sqrt(pow(greatest(x - {px}, {px} - x - 1, 0), 2) + pow(greatest(y - {py}, {py} - y - 1, 0), 2))"


# a line that crosses a cell passes a corner ey less than the buffer, so corners and ends tell all
@query("rasterized_features", f"""
WITH seg AS (
  SELECT o_orderkey AS id, {CLASS_SQL} AS class_id, o_orderkey % 53 AS ax, o_orderkey // 53 AS ay, o_orderkey % 53 + o_custkey % 3 + 1 AS ex,
    o_orderkey // 53 + CASE o_orderkey % 5 WHEN 0 THEN 0.5e0 ELSE 0e0 END AS ey FROM orders WHERE o_orderkey % 5 IN (0, 2)),
near AS (
  SELECT id, class_id, y, x FROM (SELECT *, ax + unnest(range(-2, ex - ax + 2)) AS x FROM (SELECT *, ay + unnest(range(-2, 3)) AS y FROM seg))
  WHERE least({corner_sql(0, 0)}, {corner_sql(0, 1)}, {corner_sql(1, 0)}, {corner_sql(1, 1)}, {end_sql("ax", "ay")}, {end_sql("ex", "ey")}) <= 0.8e0),
filled AS (
  SELECT o_orderkey AS id, {CLASS_SQL} AS class_id, o_orderkey // 53 + unnest([0, 1]) AS y, x FROM (
    SELECT *, o_orderkey % 53 + unnest(range(0, o_custkey % 3 + 1)) AS x FROM orders WHERE o_orderkey % 5 > 2))
SELECT y, x, arg_max(class_id, id) AS class_id, max(id) AS feature_id FROM (SELECT * FROM near UNION ALL SELECT * FROM filled) WHERE class_id IS NOT NULL GROUP BY y, x""")
def rasterized_features(spark, d):
    """Polygons and lines buffered by 8 m on the 10 m grid."""
    return rs.rasterize(vector_shapes(spark, d), 0.8)


@query("element_centroids", """
SELECT o_orderkey AS id, o_orderkey % 53 + CASE o_orderkey % 5 WHEN 1 THEN 0e0 ELSE (o_custkey % 3 + 1) / 2e0 END AS cx,
  o_orderkey // 53 + CASE o_orderkey % 5 WHEN 0 THEN 0.25e0 WHEN 1 THEN 0e0 WHEN 2 THEN 0e0 ELSE 0.75e0 END AS cy FROM orders""")
def element_centroids(spark, d):
    e = vector_shapes(spark, d)
    cx, cy = geo.ring_bbox_center(F.col("points"))
    return e.select("id", F.round(cx, 9).alias("cx"), F.round(cy, 9).alias("cy"))


MX, MY = 3336000.0, -206000.0
TILE_SQL = """SELECT scene, z, CAST(floor((mx + hw) / span) AS BIGINT) AS tx, CAST(floor((hw - my) / span) AS BIGINT) AS ty,
  CAST(floor(((mx + hw) / span - floor((mx + hw) / span)) * 256) AS INTEGER) AS px, CAST(floor(((hw - my) / span - floor((hw - my) / span)) * 256) AS INTEGER) AS py, v
FROM (SELECT *, 2 * hw / pow(2e0, z) AS span FROM (SELECT scene, 3336000e0 + (x + 0.5e0) * 10 AS mx, -206000e0 - (y + 0.5e0) * 10 AS my, 20037508.342789244e0 AS hw, {v} AS v, unnest([12, 13, 14]) AS z FROM {t}))"""


def keyed(df):
    return rs.tile_keys(df, MX + (F.col("x") + 0.5) * 10, MY - (F.col("y") + 0.5) * 10, (12, 13, 14))


@query("index_tiles", f"""
SELECT scene, z, tx, ty, px, py, round(sum(CAST(round(v * 1e6) AS BIGINT)) / (count(v) * 1e6), 12) AS value FROM ({TILE_SQL.format(v='ndvi', t='feat')}) WHERE v IS NOT NULL GROUP BY ALL""")
def index_tiles(spark, d):
    return rs.continuous_tiles(keyed(obs.features(spark, d).select("scene", "y", "x", "ndvi")), "ndvi", ("scene",))


@query("class_tiles", f"""
SELECT scene, z, tx, ty, px, py, CAST(arg_max(v, n * 10 - v) AS INTEGER) AS value FROM (
  SELECT scene, z, tx, ty, px, py, v, count(*) AS n FROM ({TILE_SQL.format(v='model_class', t='model_out')}) GROUP BY ALL) GROUP BY ALL""")
def class_tiles(spark, d):
    return rs.categorical_tiles(keyed(obs.model_output(spark, d).select("scene", "y", "x", "model_class")), "model_class", ("scene",))


view("nlim", "SELECT " + ", ".join(f"quantile_cont({b}, 0.02) AS {b}_lo, quantile_cont({b}, 0.98) AS {b}_hi" for b in ("nir", "red", "green")) + " FROM px")


def stretch_sql(b):
    return f"CAST(floor(least(greatest(({b} - {b}_lo) / ({b}_hi - {b}_lo), 0e0), 1e0) * 255 + 1e-9) AS INTEGER)"


@query("false_color", f"SELECT scene, y, x, {stretch_sql('nir')} AS r, {stretch_sql('red')} AS g, {stretch_sql('green')} AS b FROM px CROSS JOIN nlim")
def false_color(spark, d):
    px = obs.pixels(spark, d)
    bands = {"nir": "r", "red": "g", "green": "b"}
    limits = exact_quantiles_by(px, list(bands), [0.02, 0.98]).agg(F.map_from_entries(F.collect_list(F.struct("name", "q")))).scalar()
    out = px.select("scene", "y", "x", *bands).withColumn("_l", limits)
    for band, name in bands.items():
        q = F.col("_l")[band]
        out = out.withColumn(name, F.floor(geo.stretch01(F.col(band), F.get(q, 0), F.get(q, 1)) * 255 + 1e-9).cast("int"))
    return out.select("scene", "y", "x", "r", "g", "b")


RAMP, ALPHA = RAMPS["ndvi"], round(255 * OPACITY)


def ramp_sql(ch):
    s = [c[ch] for c in RAMP]
    return f"CAST(floor(CASE CAST(least(floor(v * 3), 2) AS INTEGER) " + " ".join(
        f"WHEN {i} THEN {s[i]}e0 + ({s[i + 1]} - {s[i]}) * (v * 3 - {i})" for i in range(3)) + " END) AS INTEGER)"


@query("index_palette", f"""
SELECT scene, y, x, {ramp_sql(0)} AS r, {ramp_sql(1)} AS g, {ramp_sql(2)} AS b, CASE WHEN v IS NULL THEN 0 ELSE {ALPHA} END AS alpha
FROM (SELECT scene, y, x, least(greatest((ndvi - lo) / (hi - lo), 0e0), 1e0) AS v FROM feat CROSS JOIN
      (SELECT quantile_cont(ndvi, 0.02) AS lo, quantile_cont(ndvi, 0.98) AS hi FROM feat) WHERE ndvi IS NOT NULL)""")
def index_palette(spark, d):
    """Vegetation index stretched to its 2-98 percent range and coloured by its ramp."""
    f = obs.features(spark, d).where("ndvi IS NOT NULL")
    lim = tr.stretch_limits(f, "ndvi").select(F.struct("low", "high")).scalar()
    v = f.select("scene", "y", "x", "ndvi").withColumn("_l", lim).withColumn(
        "v", geo.stretch01(F.col("ndvi"), F.col("_l.low"), F.col("_l.high")))
    return v.select("scene", "y", "x", *[
        geo.ramp_channel(F.col("v"), tuple(c[i] for c in RAMP)).alias(n) for i, n in enumerate("rgb")],
        F.when(F.col("v").isNull(), 0).otherwise(ALPHA).alias("alpha"))


def color_sql(i):
    return "CASE model_class " + " ".join(f"WHEN {k} THEN {c[i]}" for k, c in CLASS_COLORS.items()) + " ELSE 0 END"


@query("class_palette", f"""
SELECT m.scene, m.y, m.x, {color_sql(0)} AS r, {color_sql(1)} AS g, {color_sql(2)} AS b, CASE WHEN model_class = 0 OR NOT in_aoi THEN 0 ELSE {ALPHA} END AS alpha
FROM model_out m JOIN aoi_px a ON m.scene = a.scene AND m.y = a.y AND m.x = a.x""")
def class_palette(spark, d):
    """Class colours; nodata and pixels outside the area of interest are transparent."""
    px = tr.inside_ring(obs.model_output(spark, d).select("scene", "y", "x", "model_class"), aoi_ring(spark, d))
    tables = [lb.int_map({k: c[i] for k, c in CLASS_COLORS.items()}) for i in range(3)]
    return px.select("scene", "y", "x", *[
        F.coalesce(F.try_element_at(t, F.col("model_class")), F.lit(0)).alias(n) for t, n in zip(tables, "rgb", strict=True)],
        F.when((F.col("model_class") == 0) | ~F.col("in_aoi"), 0).otherwise(ALPHA).alias("alpha"))


@query("pixel_positions", """
SELECT y, x, 830650e0 + (x + 0.5e0) * 10 AS map_x, 9794800e0 - (y + 0.5e0) * 10 AS map_y, y AS back_row, CAST(x AS BIGINT) AS back_col,
  y < 1997 AS inside FROM (SELECT DISTINCT y, x FROM px)""")
def pixel_positions(spark, d):
    p = obs.pixels(spark, d).select("y", "x").distinct()
    mx, my = geo.pixel_to_map(F.col("y"), F.col("x"))
    p = p.withColumns({"map_x": mx, "map_y": my})
    row, col, inside = geo.map_to_pixel(F.col("map_x"), F.col("map_y"))
    return p.select("y", "x", "map_x", "map_y", row.alias("back_row"), col.alias("back_col"), inside.alias("inside"))


@query("patch_footprints", f"""
WITH corner AS (
  SELECT prow, pcol, k, 830650e0 + (pcol + dc) * 80 AS mx, 9794800e0 - (prow + dr) * 80 AS my
  FROM (SELECT DISTINCT y // 8 AS prow, CAST(x // 8 AS BIGINT) AS pcol FROM px)
  CROSS JOIN (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 0, 0)) c(k, dr, dc)),
{lonlat_ctes("corner", "placed")}
SELECT prow, pcol, to_json(list([round(lon, 9), round(lat, 9)] ORDER BY k)) AS ring FROM placed GROUP BY 1, 2""")
def patch_footprints(spark, d):
    """Corner ring of every patch in longitude and latitude."""
    p = obs.pixels(spark, d).select(F.floor(F.col("y") / 8).alias("prow"), F.floor(F.col("x") / 8).alias("pcol")).distinct()

    def corner(dr, dc):
        x, y = geo.pixel_to_map((F.col("prow") + dr) * 8, (F.col("pcol") + dc) * 8, GRID, center=False)
        lon, lat = geo.utm_to_lonlat(x, y)
        return F.array(F.round(lon, 9), F.round(lat, 9))

    return p.select("prow", "pcol", F.to_json(F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))).alias("ring"))


@query("pixel_classifier")
def pixel_classifier(spark, d):
    """Class-weighted pixel classifier evaluated against the voted labels."""
    v = votes.majority_vote(obs.features(spark, d), SOURCES)
    m = pt.training_mask(v, INDICES).withColumn("truth", lb.harmonized_to_model(F.col("agreement")))
    # read by the fit, its summary and the prediction; what they do not read is not written
    m = store(m.select(*INDICES, "truth", "trainable"))
    predicted = classify.train_and_predict(m, INDICES, "truth", "trainable", weights(spark, d))
    return votes.class_metrics(predicted, "truth", "model_class")


@query("frozen_benchmark", """
SELECT * FROM reliability WHERE scene = (SELECT max(scene) FROM reliability) AND (SELECT count(*) FROM patch_rec WHERE year >= 2026 AND split <> 'test') = 0""")
def frozen_benchmark(spark, d):
    """Reliability of the frozen (latest) scene, only when no frozen record leaked."""
    from landshift.plans.labels import reliability_records

    rec = obs.patch_records(spark, d)
    leaks = pt.leakage_findings(rec, "label").where("finding = 'frozen_year_outside_test'").agg(F.count(F.lit(1))).scalar()
    r = reliability_records(spark, d)
    latest = obs.table(spark, d, "lineitem").agg(F.max(F.year("l_shipdate")) - obs.SCENE_EPOCH).scalar()
    return r.where((F.col("scene") == latest) & (leaks == 0))
