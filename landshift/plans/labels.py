"""Weak labels, votes, consensus, pseudo-labels and reliability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.config import LABEL_COLLECTION_CODES, WORLD_COVER_CODES
from landshift.functions import change as ch, labels as lb
from landshift.functions.bands import all_valid
from landshift.operators import overlay, votes
from landshift.plans.change import STATE_SQL, scene_pairs
from landshift.plans.registry import query, view
from landshift.plans.twins import H2M
from landshift.session import cut_lineage
from landshift.sources import observations as obs

SOURCES = ("s1", "s2", "s3", "s4")


def evidence(spark, d):
    return votes.with_evidence(obs.model_output(spark, d), SOURCES)


def ramp(v: str, c: float, s: float) -> str:
    return f"least(greatest((({v}) - {c}e0) / {s}e0, 0e0), 1e0)"


view("soft_scores", f"""
SELECT scene, y, x,
  {ramp('ndbi', 0.08, 0.28)} * (1 - {ramp('ndwi', 0.15, 0.4)}) AS q1,
  {ramp('ndvi', 0.18, 0.5)} * (1 - {ramp('ndwi', 0.25, 0.4)}) * 0.45e0 AS q2,
  {ramp('ndvi', 0.18, 0.5)} * (1 - {ramp('ndwi', 0.25, 0.4)}) * 0.55e0 AS q3,
  (1 - {ramp('ndvi', 0.15, 0.45)}) * (1 - {ramp('ndwi', 0.12, 0.4)}) * (1 - {ramp('ndbi', 0.18, 0.3)}) AS q4,
  {ramp('ndwi', 0.12, 0.35)} AS q5, 0.12e0 + {ramp('abs(ratio)', 1.2, 3.5)} * 0.2e0 AS q6,
  ndvi IS NOT NULL AND ndwi IS NOT NULL AND ndbi IS NOT NULL AND ratio IS NOT NULL AS ok FROM feat""")
view("soft", """
SELECT scene, y, x, p, list_max(p) AS max_p, coalesce(list_position(p, list_max(p)), 0) AS dominant,
       list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2] AS gap
FROM (SELECT scene, y, x, CASE WHEN ok THEN [q1/t, q2/t, q3/t, q4/t, q5/t, q6/t] END AS p
      FROM (SELECT *, 0e0 + q1 + q2 + q3 + q4 + q5 + q6 AS t FROM soft_scores))""")


def soft(f):
    c = F.col
    p, inputs = c("probs"), [c(k) for k in ("ndvi", "ndwi", "ndbi", "ratio")]
    # scores and their sum are columns of their own, so that each is computed once per pixel
    scored = f.withColumn("_scores", lb.soft_scores(*inputs)).withColumn("_total", lb.score_total(c("_scores")))
    return scored.withColumn("probs", F.when(all_valid(*inputs), lb.shares(c("_scores"), c("_total")))).drop("_scores", "_total").withColumns({
        "dominant": lb.argmax_class(p), "max_probability": F.array_max(p), "gap": lb.probability_gap(p)})


@query("soft_labels", """
SELECT scene, y, x, round(p[1], 6) AS p_built, round(p[2], 6) AS p_managed, round(p[3], 6) AS p_natural, round(p[4], 6) AS p_bare,
       round(p[5], 6) AS p_water, round(p[6], 6) AS p_mixed, CAST(dominant AS INTEGER) AS dominant,
       round(1 - max_p, 6) AS uncertainty, round(gap, 6) AS gap FROM soft""")
def soft_labels(spark, d):
    names = ("built", "managed", "natural", "bare", "water", "mixed")
    return soft(obs.features(spark, d)).select(
        "scene", "y", "x", *[F.round(F.get("probs", i), 6).alias(f"p_{n}") for i, n in enumerate(names)],
        "dominant", F.round(1 - F.col("max_probability"), 6).alias("uncertainty"), F.round("gap", 6).alias("gap"),
    )


GROUP_SQL = f"""CASE change_class WHEN 1 THEN 'vegetation' WHEN 2 THEN 'built_up' WHEN 3 THEN 'water_moisture' ELSE
  CASE WHEN ({STATE_SQL.format(p='b')}) <> 'unknown' THEN ({STATE_SQL.format(p='b')}) ELSE ({STATE_SQL.format(p='a')}) END END"""
view("touching", f"""
SELECT scene, y, x, max(confidence) AS change_confidence, arg_max(grp, after_scene) AS grp FROM (
  SELECT before_scene AS scene, after_scene, y, x, confidence, {GROUP_SQL} AS grp FROM detected WHERE change_class > 0
  UNION ALL SELECT after_scene, after_scene, y, x, confidence, {GROUP_SQL} FROM detected WHERE change_class > 0)
GROUP BY 1, 2, 3""")
view("weak_raw", """
SELECT s.scene, s.y, s.x, s.max_p, s.gap, s.dominant, coalesce(t.change_confidence, 0e0) AS cc,
       CASE WHEN t.grp IS NULL THEN 0 WHEN grp = 'built_up' THEN 1 WHEN grp = 'bare_sparse' THEN 4 WHEN grp = 'water_moisture' THEN 5
            WHEN grp = 'vegetation' AND p[2] >= p[3] THEN 2 WHEN grp = 'vegetation' THEN 3 ELSE 6 END AS monitoring
FROM soft s LEFT JOIN touching t ON s.scene = t.scene AND s.y = t.y AND s.x = t.x""")
view("weak", """
SELECT *, CASE WHEN max_p >= 0.55e0 AND conf >= 0.65e0 AND gap >= 0.15e0 THEN dominant ELSE 0 END AS hard_label FROM (
  SELECT *, 0.55e0 * max_p + 0.25e0 * CASE WHEN monitoring = dominant AND monitoring > 0 THEN 1e0 ELSE 0e0 END
          + 0.2e0 * least(greatest(cc, 0e0), 1e0) AS conf FROM weak_raw)""")


def touched(spark, d):
    """Features with the changes that touch their scene."""
    return overlay.with_touching(obs.features(spark, d), scene_pairs(spark, d))


def weak(spark, d):
    c = F.col
    # written once: the label rules use the group many times, and inlined they would make one huge expression
    j = soft(cut_lineage(touched(spark, d).select("scene", "y", "x", *overlay.INDICES, "change_confidence", "group")))
    monitoring = F.when(c("group").isNull(), 0).otherwise(
        lb.monitored_group_class(c("group"), F.get("probs", 1), F.get("probs", 2)))
    j = j.withColumn("monitoring", monitoring)
    agrees = (c("monitoring") == c("dominant")) & (c("monitoring") > 0)
    j = j.withColumn("label_confidence", lb.label_confidence(c("max_probability"), agrees, c("change_confidence")))
    return j.withColumn("hard_label", lb.hard_label(c("dominant"), c("max_probability"), c("label_confidence"), c("gap")))


@query("weak_hard_labels", """
SELECT scene, y, x, CAST(monitoring AS INTEGER) AS monitoring, CAST(hard_label AS INTEGER) AS hard_label, round(conf, 6) AS label_confidence
FROM weak WHERE hard_label > 0""")
def weak_hard_labels(spark, d):
    hard = overlay.keep_where(weak(spark, d), F.col("hard_label") > 0, ["scene", "y", "x", "monitoring", "hard_label", "label_confidence"])
    return hard.withColumn("label_confidence", F.round("label_confidence", 6))


@query("weak_label_summary", """
SELECT scene, count(*) AS total_pixels, count(*) FILTER (hard_label > 0) AS labeled_pixels,
       round(count(*) FILTER (hard_label > 0) * 100 / 1e6, 6) AS labeled_area_km2,
       """ + ", ".join(f"count(*) FILTER (hard_label = {k}) AS class_{k}_pixels" for k in range(1, 7)) + """,
       round(coalesce(sum(CASE WHEN hard_label > 0 THEN CAST(round(conf * 1e6) AS BIGINT) END) / nullif(count(*) FILTER (hard_label > 0) * 1e6, 0), 0), 4) AS mean_confidence,
       round(coalesce(sum(CASE WHEN hard_label > 0 THEN CAST(round((1 - max_p) * 1e6) AS BIGINT) END) / nullif(count(*) FILTER (hard_label > 0) * 1e6, 0), 0), 4) AS mean_uncertainty
FROM weak GROUP BY scene""")
def weak_label_summary(spark, d):
    on = F.col("hard_label") > 0
    n = F.count(F.when(on, 1))

    def mean(v):
        return F.round(F.coalesce(F.sum(F.when(on, F.round(v * 1e6).cast("bigint"))) / F.nullif(n * 1e6, F.lit(0.0)), F.lit(0.0)), 4)

    return weak(spark, d).groupBy("scene").agg(
        F.count(F.lit(1)).alias("total_pixels"), n.alias("labeled_pixels"), F.round(n * 100 / 1e6, 6).alias("labeled_area_km2"),
        *[F.count(F.when(F.col("hard_label") == k, 1)).alias(f"class_{k}_pixels") for k in range(1, 7)],
        mean(F.col("label_confidence")).alias("mean_confidence"), mean(1 - F.col("max_probability")).alias("mean_uncertainty"),
    )


def case_map(col: str, m: dict[int, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN {v}" for k, v in m.items()) + " ELSE 0 END"


@query("remapped_sources", f"""
SELECT scene, {case_map('s1 * 20', WORLD_COVER_CODES)} AS world_cover, {case_map('s2 + 3', LABEL_COLLECTION_CODES)} AS collection,
       count(*) AS pixel_count FROM px GROUP BY ALL""")
def remapped_sources(spark, d):
    """Codes of two external products brought to the shared classes; unmapped codes become 0."""
    return obs.pixels(spark, d).groupBy(
        "scene", lb.remap(F.col("s1") * 20, WORLD_COVER_CODES).alias("world_cover"),
        lb.remap(F.col("s2") + 3, LABEL_COLLECTION_CODES).alias("collection"),
    ).agg(F.count(F.lit(1)).alias("pixel_count"))


@query("majority_vote", "SELECT scene, y, x, source_count, mode_count, mode_label, agreement, disagreement FROM votes")
def majority_vote(spark, d):
    return votes.majority_vote(obs.pixels(spark, d), SOURCES).select(
        "scene", "y", "x", "source_count", "mode_count", "mode_label", "agreement", "disagreement")


@query("temporal_consensus", "SELECT y, x, valid_count, mode_class, round(consensus, 6) AS consensus, consensus < 0.6e0 AS unstable FROM consensus")
def temporal_consensus(spark, d):
    return votes.temporal_consensus(obs.model_output(spark, d)).select(
        "y", "x", "valid_count", "mode_class", F.round("consensus", 6).alias("consensus"),
        (F.col("consensus") < 0.6).alias("unstable"))


@query("consensus_summary", """
SELECT count(*) FILTER (valid_count > 0) AS valid_pixel_count,
       round(sum(CAST(round(consensus * 1e6) AS BIGINT)) / (count(consensus) * 1e6), 6) AS mean_consensus,
       count(*) FILTER (consensus < 0.6e0) AS unstable_pixel_count,
       round(count(*) FILTER (consensus < 0.6e0) / CAST(count(*) FILTER (valid_count > 0) AS DOUBLE), 6) AS unstable_fraction FROM consensus""")
def consensus_summary(spark, d):
    return votes.consensus_summary(votes.temporal_consensus(obs.model_output(spark, d)))


@query("modal_label", """
SELECT y, x, label, n AS votes, image_count FROM (
  SELECT y, x, label, n, CAST(sum(n) OVER (PARTITION BY y, x) AS BIGINT) AS image_count,
         row_number() OVER (PARTITION BY y, x ORDER BY n DESC, label) AS rn
  FROM (SELECT l_partkey // 8 AS y, CAST((l_partkey % 8) * 7 + l_linenumber - 1 AS INTEGER) AS x, CAST(l_suppkey % 9 AS INTEGER) AS label, count(*) AS n
        FROM lineitem WHERE l_shipdate >= DATE '1996-03-01' AND l_shipdate < DATE '1999-03-01' GROUP BY ALL)) WHERE rn = 1""")
def modal_label(spark, d):
    li = obs.table(spark, d, "lineitem").select(
        F.expr("l_partkey div 8").alias("y"),
        ((F.col("l_partkey") % 8) * 7 + F.col("l_linenumber") - 1).cast("int").alias("x"),
        (F.col("l_suppkey") % 9).cast("int").alias("label"), F.to_date("l_shipdate").alias("day"))
    return votes.modal_label(li, "1996-03-01", "1999-03-01")


@query("evidence_pixels", """
SELECT scene, y, x, model_class, round(confidence, 6) AS confidence, entropy, source_count, agreement, disagreement,
       round(consensus, 6) AS consensus, is_compatible FROM evidence""")
def evidence_pixels(spark, d):
    return evidence(spark, d).select(
        "scene", "y", "x", "model_class", F.round("confidence", 6).alias("confidence"), "entropy", "source_count", "agreement",
        "disagreement", F.round("consensus", 6).alias("consensus"), "is_compatible")


ZONES = """SELECT *, model_class > 0 AS valid, model_class > 0 AND agreement > 0 AND source_count >= 2 AND NOT disagreement AS ag,
  model_class > 0 AND disagreement AS dis, model_class > 0 AND entropy >= 0.65e0 AS ent, model_class > 0 AND confidence < 0.6e0 AS low FROM evidence"""
view("zones", ZONES)
view("reliability", """
SELECT scene, count(*) FILTER (valid) AS valid_pixels, count(*) FILTER (ag) AS agreement_zone_pixels,
  count(*) FILTER (ag AND is_compatible) AS compatible_pixels,
  round(coalesce(count(*) FILTER (ag) / nullif(CAST(count(*) FILTER (valid) AS DOUBLE), 0), 0), 6) AS agreement_zone_fraction,
  round(coalesce(count(*) FILTER (ag AND is_compatible) / nullif(CAST(count(*) FILTER (ag) AS DOUBLE), 0), 0), 6) AS compatible_fraction,
  count(*) FILTER (dis) AS disagreement_pixels, count(*) FILTER (ent) AS high_entropy_pixels, count(*) FILTER (low) AS low_confidence_pixels,
  count(*) FILTER (dis OR ent OR low) AS review_pixels,
  round(coalesce(count(*) FILTER (dis OR ent OR low) / nullif(CAST(count(*) FILTER (valid) AS DOUBLE), 0), 0), 6) AS review_fraction,
  round(sum(CAST(round(confidence * 1e6) AS BIGINT)) / (count(*) * 1e6), 6) AS mean_confidence,
  round(sum(CAST(round(entropy * 1e6) AS BIGINT)) / (count(*) * 1e6), 6) AS mean_entropy
FROM zones GROUP BY scene""")


@query("reliability_records", "SELECT * FROM reliability")
def reliability_records(spark, d):
    return votes.reliability_records(evidence(spark, d))


@query("reliability_summary", """
SELECT count(*) AS scene_count, round(avg(compatible_fraction), 4) AS mean_compatible_fraction, round(avg(review_fraction), 4) AS mean_review_fraction,
  (SELECT scene FROM reliability ORDER BY review_fraction DESC, scene LIMIT 1) AS highest_priority_scene FROM reliability""")
def reliability_summary(spark, d):
    return votes.reliability_summary(reliability_records(spark, d))


@query("review_tasks", """
SELECT row_number() OVER (ORDER BY review_fraction DESC, scene) AS priority, scene, review_fraction, compatible_fraction
FROM reliability ORDER BY 1 LIMIT 5""")
def review_tasks(spark, d):
    return votes.review_tasks(reliability_records(spark, d), 5)


@query("review_zones", """
SELECT scene, CASE WHEN confidence IS NULL THEN 0 WHEN disagreement THEN 3 WHEN entropy >= 0.65e0 THEN 2 WHEN confidence < 0.6e0 THEN 1 ELSE 0 END AS zone,
       count(*) AS pixel_count FROM evidence GROUP BY 1, 2""")
def review_zones(spark, d):
    return votes.review_zones(evidence(spark, d))


view("refined", f"""
SELECT *, CASE WHEN strict THEN model_class WHEN external THEN ({H2M}) ELSE 0 END AS refined_label,
  CASE WHEN strict THEN least(confidence, 1 - entropy, consensus) WHEN external THEN least(source_count / 4e0, 1e0) END AS refined_confidence FROM (
  SELECT *, model_class > 0 AND confidence >= 0.8e0 AND entropy <= 0.35e0 AND consensus >= 0.7e0 AND agreement > 0 AND source_count >= 2
            AND NOT disagreement AND is_compatible AS strict,
         ({H2M}) > 0 AND agreement > 0 AND source_count >= 2 AND NOT disagreement AS external FROM evidence)""")


@query("refined_labels", """
SELECT scene, y, x, refined_label, strict, external, round(refined_confidence, 6) AS refined_confidence FROM refined WHERE strict OR external""")
def refined_labels(spark, d):
    return votes.refine(evidence(spark, d)).where("refined_mask").select(
        "scene", "y", "x", "refined_label", "strict", "external", F.round("refined_confidence", 6).alias("refined_confidence"))


@query("refined_summary", """
SELECT scene, count(*) FILTER (strict OR external) AS selected_pixels, count(*) FILTER (model_class > 0) AS valid_pixels,
       round(count(*) FILTER (strict OR external) / CAST(count(*) FILTER (model_class > 0) AS DOUBLE), 6) AS selected_fraction,
       count(*) FILTER (strict) AS strict_pixels, count(*) FILTER (external) AS external_pixels,
       """ + ", ".join(f"count(*) FILTER (refined_label = {k}) AS class_{k}_pixels" for k in range(1, 6)) + " FROM refined GROUP BY scene")
def refined_summary(spark, d):
    return votes.refined_summary(votes.refine(evidence(spark, d)))


view("calibration", """
SELECT CAST(b AS INTEGER) AS bin, round(b / 10e0, 3) AS confidence_low, round((b + 1) / 10e0, 3) AS confidence_high, round((b + 0.5e0) / 10e0, 3) AS midpoint,
       coalesce(n, 0) AS pixel_count, round(s / CAST(n AS DOUBLE), 6) AS support_rate
FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (
  SELECT CAST(least(floor(round(confidence, 6) * 10), 9) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (agreement > 0 AND source_count >= 2 AND NOT disagreement) AS s
  FROM evidence WHERE model_class > 0 GROUP BY 1) ON b = bin""")


@query("calibration_bins", "SELECT * FROM calibration")
def calibration_bins(spark, d):
    return votes.calibration_bins(evidence(spark, d))


@query("calibration_gap", "SELECT count(support_rate) AS usable_bins, round(avg(round(abs(midpoint - support_rate), 6)), 5) AS mean_abs_gap FROM calibration")
def calibration_gap(spark, d):
    return votes.calibration_gap(calibration_bins(spark, d))


@query("class_metrics", f"""
WITH e AS (SELECT ({H2M}) AS t, model_class AS p FROM evidence WHERE ({H2M}) > 0),
k AS (SELECT DISTINCT t AS class_id FROM e UNION SELECT DISTINCT p FROM e),
m AS (SELECT class_id, count(*) FILTER (t = class_id) AS true_pixels, count(*) FILTER (p = class_id) AS predicted_pixels,
      count(*) FILTER (t = class_id AND p = class_id) AS intersection FROM k CROSS JOIN e WHERE class_id > 0 GROUP BY class_id)
SELECT CAST(class_id AS INTEGER) AS class_id, true_pixels, predicted_pixels, intersection,
  round(intersection / nullif(CAST(true_pixels + predicted_pixels - intersection AS DOUBLE), 0), 6) AS iou,
  round(2 * intersection / nullif(CAST(true_pixels + predicted_pixels AS DOUBLE), 0), 6) AS dice,
  round(intersection / nullif(CAST(true_pixels AS DOUBLE), 0), 6) AS recall FROM m""")
def class_metrics(spark, d):
    v = votes.majority_vote(obs.model_output(spark, d), SOURCES)
    return votes.class_metrics(v.withColumn("truth", lb.harmonized_to_model(F.col("agreement"))), "truth", "model_class")


@query("high_confidence_pixels", """
SELECT f.scene, f.y, f.x, round(f.ndvi, 6) AS ndvi FROM feat f WHERE EXISTS (SELECT 1 FROM detected t WHERE t.confidence >= 0.9e0
  AND t.y = f.y AND t.x = f.x AND (t.before_scene = f.scene OR t.after_scene = f.scene))""")
def high_confidence_pixels(spark, d):
    """Feature rows under a strong change of any comparison that touches their scene."""
    strong = overlay.keep_where(touched(spark, d), F.col("change_confidence") >= 0.9, ["scene", "y", "x", "ndvi"])
    return strong.withColumn("ndvi", F.round("ndvi", 6))


@query("first_valid_mosaic", """
SELECT y, x, price, suppkey, orderkey FROM (
  SELECT l_partkey // 8 AS y, CAST((l_partkey % 8) * 7 + l_linenumber - 1 AS INTEGER) AS x, l_suppkey AS suppkey, l_orderkey AS orderkey,
         CASE WHEN l_discount > 0.03 THEN l_extendedprice END AS price FROM lineitem) WHERE price IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY suppkey, orderkey) = 1""")
def first_valid_mosaic(spark, d):
    """Line items as overlapping tiles of sources in supplier order; low discounts are nodata."""
    t = obs.table(spark, d, "lineitem").select(
        F.expr("l_partkey div 8").alias("y"),
        ((F.col("l_partkey") % 8) * 7 + F.col("l_linenumber") - 1).cast("int").alias("x"),
        F.struct(F.col("l_suppkey").alias("suppkey"), F.col("l_orderkey").alias("orderkey")).alias("seq"),
        F.when(F.col("l_discount") > 0.03, F.col("l_extendedprice")).alias("price"))
    return votes.first_valid_mosaic(t, "price", "seq").select("y", "x", "price", "seq.*")


@query("latest_per_split", """
SELECT doc_id AS tag, CASE WHEN lang = 'es' THEN 'validation' ELSE 'train' END AS split FROM documents ORDER BY (lang = 'es') DESC, doc_id DESC LIMIT 1""")
def latest_per_split(spark, d):
    docs = obs.table(spark, d, "documents").select(
        F.col("doc_id").alias("tag"), F.when(F.col("lang") == "es", "validation").otherwise("train").alias("split"))
    return votes.latest_per_split(docs, "split", "validation", "tag")


ELEMENTS = """
SELECT id, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 5 END AS n_points, class_id, k FROM (
  SELECT o_orderkey AS id, o_orderkey % 5 AS k, CASE left(o_orderpriority, 1) WHEN '1' THEN 1 WHEN '2' THEN 1
    WHEN '3' THEN CASE o_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 1 END END AS class_id FROM orders)"""


@query("vector_features", f"""
SELECT CASE WHEN n_points < 2 OR class_id IS NULL THEN 'skipped' WHEN k > 2 THEN 'polygon' ELSE 'line' END AS shape,
       class_id, count(*) AS element_count FROM ({ELEMENTS}) GROUP BY 1, 2""")
def vector_features(spark, d):
    """Tagged elements to classed polygons and lines; the rest is counted as skipped."""
    return vector_shapes(spark, d).groupBy("shape", "class_id").agg(F.count(F.lit(1)).alias("element_count"))


def vector_shapes(spark, d):
    e = obs.vector_elements(spark, d).withColumn("class_id", lb.tag_class(F.col("tags")))
    closed = (F.size("points") >= 4) & (F.element_at("points", 1) == F.element_at("points", -1))
    shape = F.when((F.size("points") < 2) | F.col("class_id").isNull(), "skipped").when(closed, "polygon").otherwise("line")
    return e.withColumn("shape", shape)
