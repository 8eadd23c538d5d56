"""Roll-ups, listings and publishing of change records."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.functions.change import reliability_label  # noqa: F401
from landshift.operators import rollup
from landshift.plans.change import scored_changes
from landshift.plans.registry import query, view
from landshift.sources import sinks

view("published", "SELECT * FROM changes WHERE publish_ready")


def published(spark, d):
    return scored_changes(spark, d).where("publish_ready")


@query("scored_summary", """
SELECT 'all' AS dimension, 'all' AS key, count(*) AS total, count(*) FILTER (publish_ready) AS publish_ready_count FROM changes
UNION ALL SELECT 'reliability', reliability, count(*), count(*) FILTER (publish_ready) FROM changes GROUP BY reliability
UNION ALL SELECT 'monitored_land_cover', monitored_land_cover, count(*), count(*) FILTER (publish_ready) FROM changes GROUP BY monitored_land_cover""")
def scored_summary(spark, d):
    return rollup.scored_summary(scored_changes(spark, d))


@query("dashboard_summary", """
SELECT count(*) AS total, round(sum(CAST(round(confidence * 1000) AS BIGINT)) / (count(*) * 1000e0), 6) AS mean_confidence,
       400e6 AS aoi_area_m2, coalesce(sum(area_m2), 0e0) AS changed_area_m2,
       greatest(400e6 - coalesce(sum(area_m2), 0e0), 0e0) AS no_change_area_m2,
       round(coalesce(sum(area_m2), 0e0) / 400e6 * 100, 6) AS changed_percent,
       round(greatest(400e6 - coalesce(sum(area_m2), 0e0), 0e0) / 400e6 * 100, 6) AS no_change_percent FROM published""")
def dashboard_summary(spark, d):
    return rollup.dashboard(published(spark, d))


@query("grouped_rollup", """
SELECT 'monitored_land_cover' AS dimension, coalesce(nullif(monitored_land_cover, ''), 'unknown') AS key,
       count(*) AS change_count, sum(area_m2) AS area_m2 FROM published GROUP BY 2
UNION ALL SELECT 'reliability', coalesce(nullif(reliability, ''), 'unknown'), count(*), sum(area_m2) FROM published GROUP BY 2""")
def grouped_rollup(spark, d):
    return rollup.grouped_rollup(published(spark, d))


TRANSITIONS = """SELECT coalesce(before_state, 'unknown') || '_to_' || coalesce(after_state, 'unknown') AS transition,
  sum(area_m2) AS area_m2 FROM published GROUP BY 1"""


@query("transition_areas", TRANSITIONS)
def transition_areas(spark, d):
    return rollup.transition_areas(published(spark, d))


@query("top_transition", TRANSITIONS + " ORDER BY 2 DESC, 1 LIMIT 1")
def top_transition(spark, d):
    return rollup.top_transition(published(spark, d))


@query("latest_changes", """
SELECT id, change_type, confidence, CAST(after_date AS VARCHAR) AS after_date FROM published
ORDER BY published.after_date DESC, id LIMIT 500""")
def latest_changes(spark, d):
    return rollup.latest_changes(published(spark, d)).select(
        "id", "change_type", "confidence", F.col("after_date").cast("string").alias("after_date"))


@query("map_changes", """
SELECT id, confidence, area_m2, monitored_land_cover FROM published
WHERE confidence >= 0.8e0 AND monitored_land_cover = 'built_up' ORDER BY confidence DESC, area_m2 DESC, id LIMIT 1000""")
def map_changes(spark, d):
    return rollup.map_query(published(spark, d), 0.8, "built_up").select(
        "id", "confidence", "area_m2", "monitored_land_cover")


@query("top_changes", "SELECT id, confidence, area_m2 FROM published ORDER BY confidence DESC, area_m2 DESC, id LIMIT 8")
def top_changes(spark, d):
    return rollup.map_query(published(spark, d), 0.0, "all", 8).select("id", "confidence", "area_m2")


@query("visible_rollup", """
SELECT count(*) AS visible_count, coalesce(sum(area_m2), 0e0) AS visible_changed_area_m2,
       greatest(400e6 - coalesce(sum(area_m2), 0e0), 0e0) AS visible_no_change_area_m2,
       coalesce(sum(area_m2) FILTER (reliability = 'high'), 0e0) AS reliable_area_m2,
       count(*) FILTER (reliability <> 'high') AS needs_review_count
FROM changes WHERE publish_ready IS NOT FALSE AND confidence >= 0.8e0""")
def visible_rollup(spark, d):
    """Dashboards drop only rows flagged false explicitly."""
    rows = scored_changes(spark, d).where(~F.col("publish_ready").eqNullSafe(False) & (F.col("confidence") >= 0.8))
    return rollup.visible_rollup(rows)


@query("publish_rows", """
SELECT md5('run-1|' || id) AS publish_id, 'run-1' AS run_id, id, change_type, confidence, area_m2,
  CAST(to_json({'before_state': before_state, 'after_state': after_state, 'change_magnitude': change_magnitude,
    'before_date': CAST(before_date AS VARCHAR), 'after_date': CAST(after_date AS VARCHAR),
    'monitored_land_cover': monitored_land_cover, 'reliability': reliability, 'publish_ready': publish_ready}) AS VARCHAR) AS properties
FROM (SELECT * REPLACE (round(change_magnitude, 3) AS change_magnitude) FROM published)""")
def publish_rows(spark, d):
    rows = scored_changes(spark, d).withColumn("change_magnitude", F.round("change_magnitude", 3))
    return sinks.publish_rows(rows, "run-1")


@query("published_property_counts", """
SELECT monitored_land_cover AS land_cover, reliability AS rel, count(*) AS n FROM published GROUP BY 1, 2""")
def published_property_counts(spark, d):
    """Keys read back out of the JSON document of the published table."""
    rows = sinks.publish_rows(scored_changes(spark, d), "run-1")
    doc = F.parse_json("properties")
    return rows.groupBy(
        F.coalesce(F.try_variant_get(doc, "$.monitored_land_cover", "string"), F.lit("unknown")).alias("land_cover"),
        F.coalesce(F.try_variant_get(doc, "$.reliability", "string"), F.lit("unknown")).alias("rel"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("constraint_audit", """
SELECT count(*) AS row_count, count(*) FILTER (id IS NULL OR change_type IS NULL) AS missing_key,
       count(*) FILTER (NOT coalesce(confidence BETWEEN 0 AND 1, false)) AS confidence_out_of_range,
       count(*) FILTER (NOT coalesce(area_m2 >= 0, false)) AS negative_area,
       count(*) FILTER (after_state IS NULL) AS missing_after_state,
       count(*) FILTER (NOT coalesce(after_date > before_date, false)) AS date_order FROM changes""")
def constraint_audit(spark, d):
    return rollup.constraint_audit(scored_changes(spark, d))
