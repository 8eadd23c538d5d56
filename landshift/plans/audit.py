"""Gate, comparison, uncertainty and packaging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.operators import audit as au, terrain as tr, votes
from landshift.plans import embed as pe, labels as pl, patches as pp, scenes as ps, terrain as pter
from landshift.plans.registry import query, view
from landshift.session import cut_lineage
from landshift.sources import observations as obs

REL = """SELECT round(avg(compatible_fraction), 4) AS mean_compatible_fraction, round(avg(review_fraction), 4) AS mean_review_fraction,
  round(avg(mean_confidence), 4) AS mean_confidence FROM reliability"""
view("rel_sum", REL)
view("cons_sum", """SELECT count(*) FILTER (valid_count > 0) AS valid_pixel_count, round(sum(CAST(round(consensus * 1e6) AS BIGINT)) / (count(consensus) * 1e6), 6) AS mean_consensus,
  count(*) FILTER (consensus < 0.6e0) AS unstable_pixel_count,
  round(count(*) FILTER (consensus < 0.6e0) / CAST(count(*) FILTER (valid_count > 0) AS DOUBLE), 6) AS unstable_fraction FROM consensus""")


def stored_evidence(spark, d):
    """Evidence pixels written once for the reports that read them several times."""
    return cut_lineage(pl.evidence(spark, d).select(
        "scene", "y", "x", "model_class", "confidence", "entropy", "source_count", "agreement", "disagreement", "consensus", "is_compatible"))


def consensus_report(ev):
    return votes.consensus_summary(votes.temporal_consensus(ev))


def reliability_means(ev):
    return votes.reliability_records(ev).agg(
        F.round(F.avg("compatible_fraction"), 4).alias("mean_compatible_fraction"),
        F.round(F.avg("review_fraction"), 4).alias("mean_review_fraction"), F.round(F.avg("mean_confidence"), 4).alias("mean_confidence"))


@query("publish_gate", """
SELECT co AS coregistration_status, t AS temporal_status, r AS reliability_status, mean_consensus, unstable_fraction,
  CASE WHEN co NOT IN ('passed', 'warning') THEN 'hold_for_processing' WHEN t = 'passed' AND r = 'passed' THEN 'publish_supported_candidates' ELSE 'publish_with_review_required' END AS recommendation
FROM (SELECT (SELECT CASE WHEN greatest(abs(dy), abs(dx)) * 4 > 10 THEN 'warning' ELSE 'passed' END FROM shifts WHERE correlation IS NOT NULL ORDER BY correlation DESC, dy, dx LIMIT 1) AS co,
  CASE WHEN mean_consensus < 0.75e0 OR unstable_fraction > 0.25e0 THEN 'warning' ELSE 'passed' END AS t,
  (SELECT CASE WHEN mean_confidence >= 0.7e0 AND mean_compatible_fraction >= 0.7e0 AND mean_review_fraction <= 0.5e0 THEN 'passed' ELSE 'warning' END FROM rel_sum) AS r,
  mean_consensus, unstable_fraction FROM cons_sum)""")
def publish_gate(spark, d):
    ev = stored_evidence(spark, d)
    return au.publish_gate(pter.best_shift(spark, d).select("status"), consensus_report(ev), reliability_means(ev))


TRACK = """SELECT count(*) AS patch_count, round(sum(CAST(round(fraction * 1e6) AS BIGINT)) / (count(*) * 1e6), 6) AS weak_compatibility,
  round(count(*) FILTER (fraction < 0.65e0 OR anomaly >= 0.9e0) / CAST(count(*) AS DOUBLE), 6) AS review_burden,
  round(count(*) FILTER (anomaly >= 0.9e0) / CAST(count(*) AS DOUBLE), 6) AS high_anomaly_fraction,
  (SELECT round(avg(mix_entropy), 5) FROM profile) AS mean_ambiguity,
  (SELECT round(count(*) FILTER (dominant_share >= 0.65e0) / CAST(count(*) AS DOUBLE), 6) FROM profile) AS coherent_fraction FROM layer"""
view("track", TRACK)


def unpivot_sql(view_name, label, cols):
    return " UNION ALL ".join(f"SELECT '{label}' AS report, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {view_name}" for c in cols)


view("all_reports", unpivot_sql("rel_sum", "supervised", ["mean_compatible_fraction", "mean_review_fraction", "mean_confidence"]) + " UNION ALL "
     + unpivot_sql("cons_sum", "temporal", ["valid_pixel_count", "mean_consensus", "unstable_pixel_count", "unstable_fraction"]) + " UNION ALL "
     + unpivot_sql("track", "label_free", ["patch_count", "weak_compatibility", "review_burden", "high_anomaly_fraction", "mean_ambiguity", "coherent_fraction"]))


def all_reports(spark, d):
    ev = stored_evidence(spark, d)
    return (
        au.report_values(reliability_means(ev), "supervised")
        .unionByName(au.report_values(consensus_report(ev), "temporal"))
        .unionByName(au.report_values(pe.track_metrics(spark, d), "label_free"))
    )


@query("track_comparison", "SELECT * FROM all_reports")
def track_comparison(spark, d):
    return all_reports(spark, d)


WANTED = (("supervised", "mean_confidence"), ("temporal", "mean_consensus"), ("label_free", "review_burden"), ("label_free", "silhouette"))


@query("reports_with_defaults", "SELECT w.report, w.metric, coalesce(value, -1e0) AS value, CASE WHEN value IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (VALUES "
       + ", ".join(f"('{a}', '{b}')" for a, b in WANTED) + ") w(report, metric) LEFT JOIN all_reports r ON w.report = r.report AND w.metric = r.metric")
def reports_with_defaults(spark, d):
    return au.reports_with_defaults(spark.createDataFrame(list(WANTED), "report string, metric string"), all_reports(spark, d), -1.0)


def _m(c, side):
    return f"(sum(CASE WHEN {side} THEN CAST(round({c} * 1e6) AS BIGINT) END) / (count(*) FILTER ({side}) * 1e6))"


V, Z = "scene < latest", "scene = latest"
view("drivers", f"""
SELECT round({_m('mean_confidence', V)} - {_m('mean_confidence', Z)}, 5) AS confidence_gap, round({_m('mean_entropy', Z)} - {_m('mean_entropy', V)}, 5) AS entropy_gap,
  round({_m('review_fraction', Z)} - {_m('review_fraction', V)}, 5) AS review_gap, round({_m('compatible_fraction', V)} - {_m('compatible_fraction', Z)}, 5) AS compatibility_gap,
  round(sum(low_confidence_pixels) FILTER ({Z}) / CAST(sum(valid_pixels) FILTER ({Z}) AS DOUBLE), 5) AS low_confidence_fraction,
  round(sum(high_entropy_pixels) FILTER ({Z}) / CAST(sum(valid_pixels) FILTER ({Z}) AS DOUBLE), 5) AS high_entropy_fraction,
  round(sum(disagreement_pixels) FILTER ({Z}) / CAST(sum(valid_pixels) FILTER ({Z}) AS DOUBLE), 5) AS disagreement_fraction,
  round(sum(agreement_zone_pixels) FILTER ({Z}) / CAST(sum(valid_pixels) FILTER ({Z}) AS DOUBLE), 5) AS agreement_zone_fraction,
  (SELECT round(count(*) FILTER (strict) / CAST(count(*) FILTER (model_class > 0) AS DOUBLE), 5) FROM refined
   WHERE scene < (SELECT max(scene) FROM reliability)) AS strict_pseudo_label_fraction,
  (SELECT round(mean_consensus, 5) FROM cons_sum) AS mean_consensus, (SELECT round(unstable_fraction, 5) FROM cons_sum) AS unstable_fraction,
  (SELECT round(round(avg(round(abs(midpoint - support_rate), 6)), 5), 5) FROM calibration) AS calibration_gap,
  (SELECT round(quantile_cont(round(slope, 6), 0.95), 4) FROM deriv_h) AS slope_p95,
  (SELECT round(sum(class_3 + class_4 + class_5) / CAST(sum(class_1 + class_2 + class_3 + class_4 + class_5) AS DOUBLE), 5) FROM patch_seq) AS rare_class_fraction
FROM reliability CROSS JOIN (SELECT max(scene) AS latest FROM reliability)""")


def drivers(spark, d):
    ev = stored_evidence(spark, d)
    latest = ev.agg(F.max("scene")).scalar()
    refined = votes.refined_summary(votes.refine(ev)).withColumn("_latest", latest)
    return au.uncertainty_drivers(
        votes.reliability_records(ev).withColumn("_latest", latest), F.col("scene") == F.col("_latest"), consensus_report(ev), votes.calibration_gap(votes.calibration_bins(ev)),
        pter.terrain_summary(spark, d), pp.input_class_totals(spark, d), (3, 4, 5), refined)


@query("uncertainty_drivers", "SELECT * FROM drivers")
def uncertainty_drivers(spark, d):
    return drivers(spark, d)


def level_sql(c, low, high, inverse):
    return (f"CASE WHEN {c} >= {high} THEN 'low' WHEN {c} >= {low} THEN 'moderate' ELSE 'high' END" if inverse
            else f"CASE WHEN {c} <= {low} THEN 'low' WHEN {c} <= {high} THEN 'moderate' ELSE 'high' END")


@query("risk_report", " UNION ALL ".join(f"SELECT '{c}' AS driver, {c} AS value, {level_sql(c, *lim)} AS risk_level FROM drivers" for c, lim in au.RISK_LIMITS.items()))
def risk_report(spark, d):
    return au.risk_report(drivers(spark, d))


@query("asset_inventory", """
SELECT lang AS suffix, count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS total_bytes, count(*) FILTER (n_chars > 5000) AS oversized_count,
  lang IN ('en', 'fr') AS allowed FROM documents GROUP BY lang""")
def asset_inventory(spark, d):
    return au.asset_inventory(obs.assets(spark, d), 5000, ("en", "fr"))


@query("disallowed_assets", "SELECT source || '/' || doc_id AS path, lang AS suffix, n_chars AS length FROM documents WHERE n_chars > 5000 OR lang NOT IN ('en', 'fr')")
def disallowed_assets(spark, d):
    return obs.assets(spark, d).where((F.col("length") > 5000) | ~F.col("suffix").isin("en", "fr"))


@query("output_completeness", """
SELECT w.family, coalesce(n, 0) AS rasters, coalesce(b, 0) AS mismatched, CASE WHEN n IS NULL THEN 'missing' WHEN b > 0 THEN 'needs_attention' ELSE 'ok' END AS status
FROM (SELECT 'family_' || unnest(range(0, 9)) AS family) w LEFT JOIN (
  SELECT family, count(*) AS n, count(*) FILTER (bad_crs OR bad_shape OR bad_off) AS b FROM meta GROUP BY 1) m ON w.family = m.family""")
def output_completeness(spark, d):
    required = spark.range(9).select(F.concat(F.lit("family_"), "id").alias("family"))
    return au.output_completeness(required, tr.grid_mismatches(obs.raster_meta(spark, d)))


@query("test_readiness", """
SELECT count(*) FILTER (split = 'test') AS test_patches, count(*) AS patches, (SELECT count(*) FILTER (period = 4) FROM scene_pairs) AS test_pairs,
  CASE WHEN count(*) FILTER (split = 'test') > 0 AND (SELECT count(*) FILTER (period = 4) FROM scene_pairs) > 0 THEN 'ready' ELSE 'not_ready' END AS status FROM patch_seq""")
def test_readiness(spark, d):
    return au.readiness_counts(pp.sequenced(spark, d), ps.training_pairs(spark, d))


@query("benchmark_package", """
SELECT *, CASE WHEN blockers = '' THEN 'ready' ELSE 'blocked' END AS status FROM (
  SELECT CAST(day AS VARCHAR) AS day, round(mean_cloud, 3) AS mean_cloud, max_cloud, 'slope' AS missing_features,
    concat_ws(',', CASE WHEN (SELECT count(*) FROM leak_findings WHERE finding = 'frozen_year_outside_test') > 0 THEN 'leakage' END,
      CASE WHEN (SELECT count(*) FROM meta WHERE bad_crs OR bad_shape OR bad_off) > 0 THEN 'weak_sources' END, 'features',
      CASE WHEN (SELECT count(*) FROM groups_strict WHERE tiles = 2) = 0 THEN 'relaxed_cloud' END) AS blockers
  FROM groups_all WHERE tiles = 2 ORDER BY max_cloud, groups_all.mean_cloud, groups_all.day LIMIT 1)""")
def benchmark_package(spark, d):
    f = obs.pixels(spark, d)
    present = spark.createDataFrame([(c,) for c in f.columns], "feature string")
    leaks = pp.leakage(spark, d).where("finding = 'frozen_year_outside_test'").agg(F.count(F.lit(1))).scalar()
    off = tr.grid_mismatches(obs.raster_meta(spark, d)).where(F.size("mismatches") > 0).agg(F.count(F.lit(1))).scalar()
    strict = ps.sc.optical_groups(ps.optical(spark, d).where(F.col("cloud_cover") < 12), ps.SEARCH.required_tiles).where("complete").agg(F.count(F.lit(1))).scalar()
    return au.benchmark_package(ps.best_candidate(spark, d), present, ["nir", "red", "vv", "vh", "slope"], leaks, off, strict)
