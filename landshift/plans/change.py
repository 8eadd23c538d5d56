"""Band algebra, before/after comparison and change scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.functions import bands, change as ch
from landshift.operators import overlay
from landshift.plans.registry import query
from landshift.plans.twins import nd
from landshift.sources import observations as obs

R6 = lambda c: F.round(F.col(c), 6).alias(c)


def compared(spark: SparkSession, d: str) -> DataFrame:
    return overlay.compare_scenes(obs.features(spark, d), scene_pairs(spark, d))


def scene_pairs(spark: SparkSession, d: str) -> DataFrame:
    days = obs.table(spark, d, "lineitem").select((F.year("l_shipdate") - obs.SCENE_EPOCH).alias("scene"))
    return overlay.consecutive_pairs(days)


def detected(spark: SparkSession, d: str) -> DataFrame:
    return overlay.detect(compared(spark, d))


def scored_changes(spark: SparkSession, d: str) -> DataFrame:
    """Change records with final confidence, reliability and publish flag."""
    return score(obs.changes(spark, d))


def score(rows: DataFrame) -> DataFrame:
    c = F.col
    grouped = rows.withColumn(
        "monitored_land_cover",
        ch.monitored_land_cover(c("change_type"), c("before_state"), c("after_state")),
    )
    adj = ch.penalties(c("change_type"), c("monitored_land_cover"), c("before_state"), c("after_state"))
    return (
        grouped.withColumn("_adjusted", ch.adjusted_confidence(c("base_confidence"), adj, c("change_magnitude")))
        .withColumn("confidence", F.round("_adjusted", 3))
        .withColumn("reliability", ch.reliability_label(c("_adjusted")))
        .withColumn("publish_ready", c("confidence") >= 0.75)
        .drop("_adjusted")
    )


@query("band_indices", """
SELECT scene, y, x, round(ndvi, 6) AS ndvi, round(ndwi, 6) AS ndwi, round(ndbi, 6) AS ndbi, round(ratio, 6) AS ratio FROM feat""")
def band_indices(spark, d):
    return obs.features(spark, d).select("scene", "y", "x", R6("ndvi"), R6("ndwi"), R6("ndbi"), R6("ratio"))


@query("expanded_indices", f"""
SELECT scene, y, x,
  round(CASE WHEN abs(nir + 2.4e0*red + 1) > 1e-6 THEN 2.5e0*(nir-red)/(nir + 2.4e0*red + 1) END, 6) AS evi2,
  round(CASE WHEN abs(nir + red + 0.5e0) > 1e-6 THEN 1.5e0*(nir-red)/(nir + red + 0.5e0) END, 6) AS savi,
  round({nd('green', 'swir')}, 6) AS mndwi,
  round({nd('swir + red', 'nir + green')}, 6) AS bsi,
  round(CASE WHEN abs(vh) > 1e-6 AND vv / vh > 0 THEN ln(1 + vv / vh) END, 6) AS log_ratio
FROM px""")
def expanded_indices(spark, d):
    c = F.col
    return obs.pixels(spark, d).select(
        "scene", "y", "x",
        F.round(bands.evi2(c("nir"), c("red")), 6).alias("evi2"),
        F.round(bands.savi(c("nir"), c("red")), 6).alias("savi"),
        F.round(bands.mndwi(c("green"), c("swir")), 6).alias("mndwi"),
        F.round(bands.bsi(c("swir"), c("red"), c("nir"), c("green")), 6).alias("bsi"),
        F.round(bands.log_ratio(bands.safe_ratio(c("vv"), c("vh"))), 6).alias("log_ratio"),
    )


@query("band_scan", "SELECT scene, y, x, round(nir, 6) AS value FROM px WHERE scene = 3 AND x BETWEEN 8 AND 31")
def band_scan(spark, d):
    """The scene range reaches the scan as a ship-date predicate; the column window filters pixels after aggregation."""
    px = obs.pixels(spark, d, (3, 3))
    return overlay.scan_band(px, "nir", (0, 2**40, 8, 31), scene=3).withColumn("value", F.round("value", 6))


@query("feature_stack", """
SELECT f.scene, f.y, f.x, round(ndvi, 6) AS ndvi, round(ndwi, 6) AS ndwi, round(ndbi, 6) AS ndbi, round(ratio, 6) AS ratio,
       elevation, ndvi IS NOT NULL AND ndwi IS NOT NULL AND ndbi IS NOT NULL AND ratio IS NOT NULL
                  AND elevation IS NOT NULL AS valid
FROM feat f LEFT JOIN (SELECT y, x, CASE WHEN (y + x) % 11 <> 0 THEN elevation END AS elevation FROM terrain) t
  ON f.y = t.y AND f.x = t.x""")
def feature_stack(spark, d):
    names = ["ndvi", "ndwi", "ndbi", "ratio"]
    long = overlay.to_long(obs.features(spark, d), names)
    stack = overlay.add_static_bands(overlay.pivot_stack(long, names), obs.terrain(spark, d, holes=True))
    return overlay.with_valid(stack, names + ["elevation"]).select(
        "scene", "y", "x", *[R6(n) for n in names], "elevation", "valid"
    )


@query("scene_inventory", """
SELECT scene, count(*) AS pixel_count, scene = (SELECT max(scene) FROM px) AS is_latest FROM px GROUP BY scene""")
def scene_inventory(spark, d):
    return overlay.scene_inventory(obs.pixels(spark, d))


@query("consecutive_pairs", "SELECT before_scene, after_scene FROM pairs")
def consecutive_pairs(spark, d):
    return overlay.consecutive_pairs(
        obs.table(spark, d, "lineitem").select((F.year("l_shipdate") - obs.SCENE_EPOCH).alias("scene"))
    )


@query("pixel_deltas", """
SELECT before_scene, after_scene, y, x, round(d_ndvi, 6) AS d_ndvi, round(d_ndbi, 6) AS d_ndbi,
       round(d_ndwi, 6) AS d_ndwi, round(d_ratio, 6) AS d_ratio FROM delta""")
def pixel_deltas(spark, d):
    return compared(spark, d).select(
        "before_scene", "after_scene", "y", "x", *[R6(f"d_{k}") for k in overlay.INDICES]
    )


@query("change_pixels", """
SELECT before_scene, after_scene, y, x, change_class, round(confidence, 6) AS confidence FROM detected WHERE change_class > 0""")
def change_pixels(spark, d):
    return detected(spark, d).where("change_class > 0").select(
        "before_scene", "after_scene", "y", "x", "change_class", R6("confidence")
    )


@query("change_summary", """
SELECT before_scene, after_scene, count(*) AS compared_pixels, count(*) FILTER (change_class > 0) AS changed_pixels,
       count(*) FILTER (change_class = 1) AS vegetation_loss_pixels, count(*) FILTER (change_class = 2) AS built_up_gain_pixels,
       count(*) FILTER (change_class = 3) AS moisture_change_pixels, count(*) FILTER (change_class = 4) AS radar_change_pixels,
       round(avg(CASE WHEN change_class > 0 THEN round(confidence, 6) END), 4) AS mean_confidence
FROM detected GROUP BY 1, 2""")
def change_summary(spark, d):
    """Flagship: what changed between consecutive dates, by class."""
    return overlay.change_summary(detected(spark, d))


@query("landcover_states", """
SELECT scene, CASE WHEN ndvi IS NULL OR ndbi IS NULL OR ndwi IS NULL THEN 'unknown' WHEN ndwi >= 0.2e0 THEN 'water_moisture'
    WHEN ndvi >= 0.45e0 AND ndvi > ndbi THEN 'vegetation' WHEN ndbi >= 0.12e0 AND ndbi > ndvi THEN 'built_up'
    WHEN ndvi <= 0.2e0 AND ndbi <= 0.12e0 THEN 'bare_sparse' ELSE 'mixed' END AS state, count(*) AS pixel_count
FROM feat GROUP BY 1, 2""")
def landcover_states(spark, d):
    c = F.col
    f = obs.features(spark, d)
    return (
        f.withColumn("state", ch.landcover_state(c("ndvi"), c("ndbi"), c("ndwi")))
        .groupBy("scene", "state").agg(F.count(F.lit(1)).alias("pixel_count"))
    )


STATE_SQL = """CASE WHEN {p}_ndvi IS NULL OR {p}_ndbi IS NULL OR {p}_ndwi IS NULL THEN 'unknown' WHEN {p}_ndwi >= 0.2e0 THEN 'water_moisture'
    WHEN {p}_ndvi >= 0.45e0 AND {p}_ndvi > {p}_ndbi THEN 'vegetation' WHEN {p}_ndbi >= 0.12e0 AND {p}_ndbi > {p}_ndvi THEN 'built_up'
    WHEN {p}_ndvi <= 0.2e0 AND {p}_ndbi <= 0.12e0 THEN 'bare_sparse' ELSE 'mixed' END"""


@query("transition_magnitudes", f"""
WITH t AS (SELECT before_scene, change_class,
    {STATE_SQL.format(p='b')} AS before_state, {STATE_SQL.format(p='a')} AS after_state,
    round(sqrt((coalesce(d_ndvi*d_ndvi,0e0)+coalesce(d_ndbi*d_ndbi,0e0)+coalesce(d_ndwi*d_ndwi,0e0)+coalesce(d_ratio*d_ratio,0e0))
      / nullif((d_ndvi IS NOT NULL)::INT + (d_ndbi IS NOT NULL)::INT + (d_ndwi IS NOT NULL)::INT + (d_ratio IS NOT NULL)::INT, 0)), 4) AS magnitude
  FROM detected WHERE change_class > 0),
g AS (SELECT *, CASE change_class WHEN 1 THEN 'vegetation' WHEN 2 THEN 'built_up' WHEN 3 THEN 'water_moisture'
      ELSE CASE WHEN before_state <> 'unknown' THEN before_state ELSE after_state END END AS monitored_land_cover FROM t)
SELECT before_scene, monitored_land_cover, before_state || '_to_' || after_state AS transition,
       before_state AS from_state, after_state AS to_state, count(*) AS pixel_count,
       round(sum(CAST(round(magnitude * 10000) AS BIGINT)) / (count(*) * 10000e0), 6) AS mean_magnitude
FROM g GROUP BY ALL""")
def transition_magnitudes(spark, d):
    c = F.col
    t = (
        detected(spark, d).where("change_class > 0")
        .withColumn("before_state", ch.landcover_state(c("b_ndvi"), c("b_ndbi"), c("b_ndwi")))
        .withColumn("after_state", ch.landcover_state(c("a_ndvi"), c("a_ndbi"), c("a_ndwi")))
        .withColumn("transition", ch.transition_label(c("before_state"), c("after_state")))
        .withColumn("magnitude", F.round(ch.change_magnitude(*[c(f"d_{k}") for k in overlay.INDICES]), 4))
        .withColumn("monitored_land_cover", ch.monitored_land_cover(
            ch.change_type(c("change_class")), c("before_state"), c("after_state")))
    )
    return t.groupBy("before_scene", "monitored_land_cover", "transition").agg(
        F.count(F.lit(1)).alias("pixel_count"),
        F.round(F.sum(F.round(c("magnitude") * 10000).cast("bigint")) / (F.count(F.lit(1)) * 10000.0), 6).alias("mean_magnitude"),
    ).select(
        "before_scene", "monitored_land_cover", "transition",
        ch.transition_before(c("transition")).alias("from_state"),
        ch.transition_after(c("transition")).alias("to_state"),
        "pixel_count", "mean_magnitude",
    )


@query("scored_changes", """
SELECT id, change_type, monitored_land_cover, confidence, reliability, publish_ready,
       CASE WHEN publish_ready THEN 'meets_publish_threshold' ELSE 'below_publish_threshold' END AS review_reason FROM changes""")
def scored_changes_query(spark, d):
    return scored_changes(spark, d).select(
        "id", "change_type", "monitored_land_cover", "confidence", "reliability", "publish_ready",
        ch.review_reason(F.col("publish_ready")).alias("review_reason"),
    )
