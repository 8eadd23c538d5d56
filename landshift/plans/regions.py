"""Change region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.config import GRID
from landshift.functions import geo
from landshift.operators import outlines, regions as rg
from landshift.operators.overlay import INDICES
from landshift.plans.change import STATE_SQL, detected, score
from landshift.plans.registry import query, view
from landshift.plans.twins import lonlat_ctes
from landshift.sources import observations as obs, sinks
from landshift.storage import store

MEANS = ["confidence"] + [f"{p}_{k}" for p in "bad" for k in INDICES]
PIXEL_AREA, MIN_AREA = 100.0, 300.0

view("cpx", "SELECT after_scene AS scene, change_class, y, x, y * 2097152 + x AS id FROM detected WHERE change_class > 0")
view("cedge", """
SELECT a.scene, a.id AS u, b.id AS v FROM cpx a JOIN cpx b ON a.scene = b.scene AND a.change_class = b.change_class AND a.y = b.y AND b.x = a.x + 1
UNION ALL SELECT a.scene, a.id, b.id FROM cpx a JOIN cpx b ON a.scene = b.scene AND a.change_class = b.change_class AND a.x = b.x AND b.y = a.y + 1""")
RECURSIVE = """WITH RECURSIVE sym AS MATERIALIZED (SELECT scene, u, v FROM cedge UNION ALL SELECT scene, v, u FROM cedge),
reach AS (SELECT scene, id AS node, id AS seen FROM cpx UNION SELECT r.scene, r.node, s.v FROM reach r JOIN sym s ON s.scene = r.scene AND s.u = r.seen),
member AS (SELECT scene, node, min(seen) AS region FROM reach GROUP BY 1, 2),
mem AS (SELECT m.region, t.*, t.x - row_number() OVER (PARTITION BY t.after_scene, t.y, t.change_class ORDER BY t.x) AS island
        FROM member m JOIN detected t ON t.after_scene = m.scene AND t.y * 2097152 + t.x = m.node AND t.change_class > 0),
runs AS (SELECT after_scene, region, y, island, count(*) AS n, min(x) AS x0 FROM mem GROUP BY ALL),
pt AS (SELECT after_scene, region, y AS point_y, x0 + (n - 1) // 2 AS point_x FROM runs
       QUALIFY row_number() OVER (PARTITION BY after_scene, region ORDER BY n DESC, y, x0) = 1),
"""
STATS = "stats AS (SELECT after_scene, region, change_class, count(*) AS pixel_count, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max, " + ", ".join(
    f"sum(CAST(round({m} * 1e6) AS BIGINT)) / (count({m}) * 1e6) AS {m}" for m in MEANS
) + """ FROM mem GROUP BY 1, 2, 3),
big AS (SELECT s.*, p.point_y, p.point_x FROM stats s JOIN pt p ON s.after_scene = p.after_scene AND s.region = p.region WHERE pixel_count * 100 >= 300),
described AS (SELECT *, CASE change_class WHEN 1 THEN 'vegetation' WHEN 2 THEN 'built_up' WHEN 3 THEN 'water_moisture'
     ELSE CASE WHEN before_state <> 'unknown' THEN before_state ELSE after_state END END AS monitored_land_cover,
     CASE change_class WHEN 1 THEN 'vegetation_loss' WHEN 2 THEN 'built_up_gain' WHEN 3 THEN 'moisture_change' ELSE 'radar_change' END AS change_type
  FROM (SELECT *, """ + STATE_SQL.format(p="b") + " AS before_state, " + STATE_SQL.format(p="a") + """ AS after_state,
     round(sqrt((d_ndvi*d_ndvi + d_ndbi*d_ndbi + d_ndwi*d_ndwi + d_ratio*d_ratio) / 4), 4) AS change_magnitude, round(confidence, 3) AS base_confidence FROM big))
"""


def labelled(spark, d, means=()):
    """Labelled runs of the change pixels."""
    px = detected(spark, d).where("change_class > 0").select("after_scene", "change_class", "y", "x", *means)
    return rg.label_runs(px, "after_scene", "change_class", means)


def regions(spark, d):
    stats = rg.zonal_statistics(labelled(spark, d, MEANS), "after_scene", "change_class", MEANS, PIXEL_AREA, MIN_AREA)
    return rg.describe_regions(stats)


@query("region_members", RECURSIVE + "x AS (SELECT 1) SELECT after_scene, region, change_class, y, x FROM mem")
def region_members(spark, d):
    px = detected(spark, d).where("change_class > 0").select("after_scene", "change_class", "y", "x")
    return rg.label_regions(px, "after_scene", "change_class").select("after_scene", "region", "change_class", "y", "x")


@query("region_runs", RECURSIVE + "z AS (SELECT 1) SELECT after_scene, region, y, x0, x0 + n - 1 AS x1 FROM runs")
def region_runs(spark, d):
    """Region geometry as pixel runs."""
    return labelled(spark, d).select("after_scene", "region", "y", "x0", "x1")


RUN_RING = "[" + ", ".join(f"[830650e0 + ({x}) * 10, 9794800e0 - ({y}) * 10]" for x, y in (("x0", "y"), ("x1 + 1", "y"), ("x1 + 1", "y + 1"), ("x0", "y + 1"), ("x0", "y"))) + "]"


@query("region_outlines", RECURSIVE + f"""
r AS (SELECT after_scene, region, y, x0, x0 + n - 1 AS x1 FROM runs)
SELECT after_scene, region, count(*) AS run_count, to_json(list({RUN_RING} ORDER BY y, x0)) AS rings FROM r GROUP BY 1, 2""")
def region_outlines(spark, d):
    """One multi-part outline per region in map coordinates: a ring around each of its runs.

    A region's rings are one value, as a feature needs them; they grow with its rows, not its pixels.
    """
    corners = [("x0", 0, "y", 0), ("x1", 1, "y", 0), ("x1", 1, "y", 1), ("x0", 0, "y", 1), ("x0", 0, "y", 0)]
    ring = F.array(*[F.array(*geo.pixel_to_map(F.col(y) + dy, F.col(x) + dx, GRID, center=False)) for x, dx, y, dy in corners])
    rings = F.sort_array(F.collect_list(F.struct("y", "x0", ring.alias("ring"))))
    return labelled(spark, d).groupBy("after_scene", "region").agg(
        F.count(F.lit(1)).alias("run_count"), F.to_json(F.transform(rings, lambda r: r["ring"])).alias("rings"))


# the twin walks unit sides: 0 above a pixel, eastward, then 1, 2, 3 clockwise; at a corner where two ways lead on, it turns left
RINGS = RECURSIVE + """
cell AS MATERIALIZED (SELECT after_scene AS scene, region, y, x FROM mem),
side AS (
  SELECT c.scene, c.region, k.d, c.x + k.sx AS sx, c.y + k.sy AS sy, c.x + k.ex AS ex, c.y + k.ey AS ey,
    CASE k.d WHEN 3 THEN (c.y * 2097152 + c.x) * 2 WHEN 1 THEN (c.y * 2097152 + c.x + 1) * 2 + 1 ELSE -1 - (c.y * 2097152 + c.x) * 4 - k.d END AS id
  FROM cell c CROSS JOIN (VALUES (0, 0, 0, 1, 0, -1, 0), (1, 1, 0, 1, 1, 0, 1), (2, 1, 1, 0, 1, 1, 0), (3, 0, 1, 0, 0, 0, -1)) k(d, sx, sy, ex, ey, ny, nx)
  ANTI JOIN cell o ON o.scene = c.scene AND o.region = c.region AND o.y = c.y + k.ny AND o.x = c.x + k.nx),
chain AS MATERIALIZED (
  SELECT a.scene, a.region, a.id, a.d, a.ex, a.ey, b.id AS next_id, b.d AS next_d
  FROM side a JOIN side b ON b.scene = a.scene AND b.region = a.region AND b.sx = a.ex AND b.sy = a.ey
  QUALIFY row_number() OVER (PARTITION BY a.scene, a.id ORDER BY CASE (b.d - a.d + 4) % 4 WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END) = 1),
walk AS (
  SELECT scene, region, id AS ring, 0 AS step, d, ex, ey, next_id, next_d FROM chain WHERE id >= 0
  UNION ALL
  SELECT w.scene, w.region, w.ring, w.step + 1, c.d, c.ex, c.ey, c.next_id, c.next_d
  FROM walk w JOIN chain c ON c.scene = w.scene AND c.id = w.next_id WHERE c.id < 0 OR c.id > w.ring),
closed AS (SELECT w.* FROM walk w JOIN (SELECT scene, ring FROM walk WHERE next_id = ring) r ON r.scene = w.scene AND r.ring = w.ring),
corner AS (SELECT scene, region, ring, step, 830650e0 + ex * 10 AS mx, 9794800e0 - ey * 10 AS my FROM closed WHERE next_d <> d),
""" + lonlat_ctes("corner", "placed") + """,
areas AS (SELECT scene, region, ring, CAST(sum(CASE d WHEN 0 THEN -ey WHEN 2 THEN ey ELSE 0 END) AS BIGINT) AS pixel_area FROM closed GROUP BY ALL),
lines AS (SELECT scene, region, ring, count(*) AS corner_count, list([round(lon, 7), round(lat, 7)] ORDER BY step DESC) AS points FROM placed GROUP BY ALL),
rings AS (SELECT scene AS after_scene, region, ring, pixel_area < 0 AS hole, corner_count, pixel_area, list_append(points, points[1]) AS coordinates
          FROM lines JOIN areas USING (scene, region, ring))
"""


def rings(spark, d):
    return outlines.region_rings(store(labelled(spark, d)), "after_scene")  # counted before they are swept


@query("region_rings", RINGS + """
SELECT after_scene, region, ring, hole, corner_count, pixel_area, to_json(coordinates) AS coordinates FROM rings""")
def region_rings(spark, d):
    """Outer rings and holes of the change regions in longitude and latitude."""
    return rings(spark, d).withColumn("coordinates", F.to_json("coordinates"))


@query("region_ring_areas", RECURSIVE + """z AS (SELECT 1)
SELECT after_scene, region, count(*) AS pixel_count FROM mem GROUP BY 1, 2""")
def region_ring_areas(spark, d):
    """The areas of a region's rings, holes taken off, are its pixels."""
    return rings(spark, d).groupBy("after_scene", "region").agg(F.sum("pixel_area").alias("pixel_count"))


@query("region_features", RINGS + """,
kinds AS (SELECT after_scene, region, count(*) AS pixel_count, CASE change_class WHEN 1 THEN 'vegetation_loss' WHEN 2 THEN 'built_up_gain'
            WHEN 3 THEN 'moisture_change' ELSE 'radar_change' END AS change_type FROM mem GROUP BY after_scene, region, change_class),
polygons AS (SELECT after_scene, region, list(coordinates ORDER BY hole, ring) AS polygon FROM rings GROUP BY 1, 2)
SELECT to_json({'type': 'Feature', 'geometry': {'type': 'Polygon', 'coordinates': polygon},
  'properties': {'after_scene': after_scene, 'region': region, 'change_type': change_type, 'pixel_count': pixel_count}}) AS value
FROM polygons JOIN kinds USING (after_scene, region) WHERE pixel_count * 100 >= 300""")
def region_features(spark, d):
    """GeoJSON feature text of every published change region."""
    px = detected(spark, d).where("change_class > 0").select("after_scene", "change_class", "y", "x", *MEANS)
    runs = store(rg.label_runs(px, "after_scene", "change_class", MEANS))
    described = rg.describe_regions(rg.zonal_statistics(runs, "after_scene", "change_class", MEANS, PIXEL_AREA, MIN_AREA))
    polygons = outlines.region_polygons(outlines.region_rings(runs, "after_scene"), "after_scene")
    return sinks.as_features(described.join(polygons, ["after_scene", "region"]), "polygon", ["after_scene", "region", "change_type", "pixel_count"])


@query("change_regions", RECURSIVE + STATS + """
SELECT after_scene, region, change_type, pixel_count, pixel_count * 100e0 AS area_m2, y_min, y_max, x_min, x_max, point_y, point_x, base_confidence,
  change_magnitude, before_state || '_to_' || after_state AS transition, monitored_land_cover, round(d_ndvi, 4) AS d_ndvi, round(d_ratio, 4) AS d_ratio FROM described""")
def change_regions(spark, d):
    return regions(spark, d).select(
        "after_scene", "region", "change_type", "pixel_count", "area_m2", "y_min", "y_max", "x_min", "x_max", "point_y", "point_x",
        "base_confidence", "change_magnitude", "transition", "monitored_land_cover",
        F.round("d_ndvi", 4).alias("d_ndvi"), F.round("d_ratio", 4).alias("d_ratio"))


@query("region_summary", RECURSIVE + STATS + """
SELECT after_scene, change_type, count(*) AS region_count, CAST(sum(pixel_count) AS BIGINT) AS pixels,
  round(sum(CAST(round(change_magnitude * 1e4) AS BIGINT)) / (count(*) * 1e4), 5) AS mean_magnitude FROM described GROUP BY 1, 2""")
def region_summary(spark, d):
    return regions(spark, d).groupBy("after_scene", "change_type").agg(
        F.count(F.lit(1)).alias("region_count"), F.sum("pixel_count").alias("pixels"),
        F.round(F.sum(F.round(F.col("change_magnitude") * 1e4).cast("bigint")) / (F.count(F.lit(1)) * 1e4), 5).alias("mean_magnitude"))


@query("scored_regions", RECURSIVE + STATS + """,
adj AS (SELECT *, least(greatest(base_confidence + CASE WHEN change_type = 'radar_change' THEN -0.12e0 ELSE 0e0 END
   + CASE WHEN monitored_land_cover = 'mixed' THEN -0.08e0 ELSE 0e0 END + CASE WHEN before_state = after_state THEN -0.05e0 ELSE 0e0 END
   + least(change_magnitude, 1e0) * 0.05e0, 0e0), 1e0) AS a FROM described)
SELECT after_scene, region, round(a, 3) AS final_confidence, CASE WHEN a >= 0.85e0 THEN 'high' WHEN a >= 0.65e0 THEN 'medium' ELSE 'low' END AS reliability,
  round(a, 3) >= 0.75e0 AS publish_ready FROM adj""")
def scored_regions(spark, d):
    r = regions(spark, d).drop("confidence")
    return score(r).select("after_scene", "region", F.col("confidence").alias("final_confidence"), "reliability", "publish_ready")


SAMPLES = RECURSIVE + STATS + """,
smp AS (SELECT d.after_scene, d.region, d.monitored_land_cover, m.model_class AS sampled FROM described d
        JOIN model_out m ON m.scene = d.after_scene AND m.y = d.point_y AND m.x = d.point_x WHERE m.model_class > 0)
"""


@query("region_samples", SAMPLES + "SELECT after_scene AS scene, region, sampled FROM smp")
def region_samples(spark, d):
    return samples(spark, d).select("scene", "region", "sampled")


def samples(spark, d):
    return rg.sample_at_points(regions(spark, d), obs.model_output(spark, d), "after_scene", "model_class")


@query("group_alignment", SAMPLES + """
SELECT monitored_land_cover, CAST(sum(n) AS BIGINT) AS region_count, arg_max(sampled, n * 10 - sampled) AS dominant_class,
  round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS dominant_share
FROM (SELECT monitored_land_cover, sampled, count(*) AS n FROM smp GROUP BY 1, 2) GROUP BY 1""")
def group_alignment(spark, d):
    return rg.alignment(samples(spark, d))
