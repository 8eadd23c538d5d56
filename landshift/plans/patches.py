"""Patch dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.config import PatchPolicy
from landshift.functions import model as md
from landshift.operators import patches as pt, votes
from landshift.operators.overlay import INDICES
from landshift.plans.labels import SOURCES
from landshift.plans.registry import query, view
from landshift.session import cut_lineage
from landshift.sources import observations as obs

POLICY = PatchPolicy(size=8, min_agreement_fraction=0.05, min_valid_fraction=0.4, min_training_pixels=2,
                     balance_limit=2, balance_multiplier=0.1)
MINORITY = (5,)

view("masked", """
SELECT v.*, f.ndvi IS NOT NULL AND f.ndbi IS NOT NULL AND f.ndwi IS NOT NULL AND f.ratio IS NOT NULL AS valid
FROM votes v JOIN feat f ON v.scene = f.scene AND v.y = f.y AND v.x = f.x""")
view("patch_stats", """
SELECT *, agreement_fraction >= 0.05e0 AND valid_fraction >= 0.4e0 AND training_pixels >= 2 AS accepted FROM (
  SELECT scene, y // 8 AS prow, x // 8 AS pcol, round(count(*) FILTER (agreement > 0) / 64e0, 6) AS agreement_fraction,
    round(count(*) FILTER (valid) / 64e0, 6) AS valid_fraction,
    count(*) FILTER (agreement > 0 AND NOT disagreement AND valid AND least(source_count / 3e0, 1e0) >= 0.65e0) AS training_pixels,
    count(*) FILTER (disagreement) AS disagreement_pixels,
    count(*) FILTER (agreement = 1) AS class_1, count(*) FILTER (agreement IN (2, 3)) AS class_2, count(*) FILTER (agreement = 4) AS class_3,
    count(*) FILTER (agreement = 5) AS class_4, count(*) FILTER (agreement = 6) AS class_5
  FROM masked WHERE y < (SELECT (max(p_partkey) // 8 + 1) // 8 * 8 FROM part) AND x < 56 GROUP BY ALL)""")
view("patch_seq", """
SELECT *, printf('s%d_r%03d_c%03d_%05d', scene, prow, pcol, seq) AS block_id,
       CASE WHEN seq % 10 <= 5 THEN 'train' WHEN seq % 10 <= 7 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY prow, pcol) - 1 AS seq FROM patch_stats WHERE accepted)""")
view("balanced", """
SELECT * EXCLUDE (major, m, rk) FROM (
  SELECT *, count(*) FILTER (split = 'train' AND NOT major) OVER (PARTITION BY scene) AS m,
    row_number() OVER (PARTITION BY scene, major ORDER BY training_pixels DESC, block_id) AS rk
  FROM (SELECT *, split = 'train' AND class_5 = 0 AS major FROM patch_seq))
WHERE NOT major OR rk <= greatest(2, round_even(m * 0.1e0, 0))""")
view("class_totals", """
SELECT unnest([1, 2, 3, 4, 5]) AS class_id, unnest([sum(class_1), sum(class_2), sum(class_3), sum(class_4), sum(class_5)])::BIGINT AS pixels
FROM balanced WHERE split = 'train'""")
view("class_weights", """
SELECT class_id, pixels, greatest(least(CASE WHEN w > 0 THEN round(w / (SELECT avg(w) FROM cw WHERE w > 0), 6) ELSE 0e0 END, 3e0),
       CASE WHEN class_id = 4 THEN 1.25e0 ELSE 0e0 END) AS weight FROM cw""")
view("cw", "SELECT *, CASE WHEN pixels > 0 THEN (1 - 0.999e0) / (1 - pow(0.999e0, pixels)) ELSE 0e0 END AS w FROM class_totals")
view("weighted", """
SELECT b.scene, b.block_id, max(CASE WHEN (w.class_id = 1 AND class_1 > 0) OR (w.class_id = 2 AND class_2 > 0) OR (w.class_id = 3 AND class_3 > 0)
   OR (w.class_id = 4 AND class_4 > 0) OR (w.class_id = 5 AND class_5 > 0) THEN 1 + 1.5e0 * w.weight ELSE 1e0 END) AS sampling_weight
FROM balanced b CROSS JOIN class_weights w WHERE b.split = 'train' GROUP BY 1, 2""")


def height_of(spark, d):
    return obs.table(spark, d, "part").agg(F.floor(F.max("p_partkey") / 8) + 1).scalar()


def stats(spark, d):
    v = votes.majority_vote(obs.features(spark, d), SOURCES)
    return pt.patch_statistics(pt.training_mask(v, INDICES), POLICY, height_of(spark, d), F.lit(obs.RASTER_WIDTH))


def sequenced(spark, d, scenes=None):
    """Patches numbered per scene, so a choice of scenes goes below the numbering and reaches the scan."""
    s = stats(spark, d)
    return pt.sequenced_patches(s if scenes is None else s.where(F.col("scene").isin(*scenes)), POLICY)


def balanced(spark, d):
    return pt.balance(sequenced(spark, d), POLICY, MINORITY)


def weights(spark, d, patches=None):
    b = (patches if patches is not None else balanced(spark, d)).where("split = 'train'")
    return pt.class_weights(pt.class_totals(b), 0.999, 3.0, {4: 1.25})


def grids(spark, d):
    """Grids of many sizes, one per part."""
    return obs.table(spark, d, "part").select(
        F.col("p_partkey").alias("grid_id"), (F.col("p_size") + 20).cast("int").alias("height"),
        (F.col("p_partkey") % 40 + 10).cast("int").alias("width"))


GRIDS = "SELECT p_partkey AS grid_id, CAST(p_size + 20 AS INTEGER) AS height, CAST(p_partkey % 40 + 10 AS INTEGER) AS width FROM part"


@query("patch_windows", f"""
SELECT grid_id, height, width, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM (
  SELECT *, unnest(range(0, width - 16 + 1, 8)) AS c FROM (SELECT *, unnest(range(0, height - 16 + 1, 8)) AS r FROM ({GRIDS})))""")
def patch_windows(spark, d):
    return pt.patch_windows(grids(spark, d), 16, 8)


@query("coverage_windows", f"""
SELECT DISTINCT grid_id, height, width, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM (
  SELECT *, unnest(list_append(range(0, greatest(width - 16, 0) + 1, 12), greatest(width - 16, 0))) AS c FROM (
    SELECT *, unnest(list_append(range(0, greatest(height - 16, 0) + 1, 12), greatest(height - 16, 0))) AS r FROM ({GRIDS})))""")
def coverage_windows(spark, d):
    return pt.coverage_windows(grids(spark, d), 16, 12)


@query("patch_statistics", "SELECT * FROM patch_stats")
def patch_statistics(spark, d):
    return stats(spark, d)


@query("sequenced_patches", "SELECT scene, prow, pcol, seq, block_id, split, training_pixels FROM patch_seq")
def sequenced_patches(spark, d):
    return sequenced(spark, d).select("scene", "prow", "pcol", "seq", "block_id", "split", "training_pixels")


@query("filtered_patches", """
SELECT scene, block_id, training_pixels FROM patch_seq WHERE split = 'validation' AND scene IN (2, 3) ORDER BY scene, seq LIMIT 50""")
def filtered_patches(spark, d):
    """Split and date filters, then the first records in sequence order."""
    return sequenced(spark, d, (2, 3)).where("split = 'validation'").orderBy("scene", "seq").limit(50).select(
        "scene", "block_id", "training_pixels")


@query("balanced_patches", "SELECT scene, block_id, split, training_pixels, class_5 FROM balanced")
def balanced_patches(spark, d):
    """Ordering (split, scene, block id) is left to the sink."""
    return balanced(spark, d).select("scene", "block_id", "split", "training_pixels", "class_5")


@query("balance_report", """
SELECT (SELECT count(*) FROM patch_seq) AS input_count, count(*) AS output_count, (SELECT count(*) FROM patch_seq) - count(*) AS dropped_count,
  count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM balanced""")
def balance_report(spark, d):
    seq = cut_lineage(sequenced(spark, d))
    n_in = seq.agg(F.count(F.lit(1))).scalar()
    out = pt.balance(seq, POLICY, MINORITY)
    return out.agg(F.count(F.lit(1)).alias("output_count"), *[
        F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "validation", "test")
    ]).select(n_in.alias("input_count"), "output_count", (n_in - F.col("output_count")).alias("dropped_count"), "train", "validation", "test")


@query("class_totals", "SELECT * FROM class_totals")
def class_totals(spark, d):
    return pt.class_totals(balanced(spark, d).where("split = 'train'"))


def input_class_totals(spark, d):
    """Labelled pixels per class of all patches, before any balancing."""
    return pt.class_totals(sequenced(spark, d))


@query("class_weights", "SELECT class_id, pixels, weight FROM class_weights")
def class_weights(spark, d):
    return weights(spark, d)


@query("patch_sampling_weights", "SELECT scene, block_id, round(sampling_weight, 6) AS sampling_weight FROM weighted")
def patch_sampling_weights(spark, d):
    b = cut_lineage(balanced(spark, d))
    return pt.sampling_weights(b.where("split = 'train'"), weights(spark, d, b), 1.5).select(
        "scene", "block_id", F.round("sampling_weight", 6).alias("sampling_weight"))


@query("oversampled_patches", """
WITH t AS (SELECT sum(CAST(round(sampling_weight * 1e6) AS BIGINT)) AS w, round_even(count(*) * 1.5e0, 0) AS n FROM weighted),
s AS (SELECT block_id, round(t.n * CAST(round(sampling_weight * 1e6) AS BIGINT) / CAST(t.w AS DOUBLE), 9) AS share,
      CAST('0x' || substr(md5(block_id || '-7'), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM weighted, t)
SELECT block_id, CAST(floor(share) + CASE WHEN u < share - floor(share) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM s""")
def oversampled_patches(spark, d):
    b = cut_lineage(balanced(spark, d))
    w = pt.sampling_weights(b.where("split = 'train'"), weights(spark, d, b), 1.5)
    return pt.oversample(w, "block_id", "sampling_weight", 1.5, 7).select("block_id", "copies")


@query("window_coverage", """
SELECT count(*) AS window_count, count(*) FILTER (n > 1) AS multi_date_windows,
  CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'ready_for_temporal_transformer' ELSE 'insufficient_exact_repeated_windows_for_temporal_transformer' END AS status
FROM (SELECT prow, pcol, count(DISTINCT scene) AS n FROM patch_stats WHERE accepted GROUP BY ALL)""")
def window_coverage(spark, d):
    return pt.window_coverage(stats(spark, d).where("accepted"))


@query("training_preflight", """
SELECT count(*) AS patch_count, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'validation') AS validation_count,
  CAST(coalesce(sum(training_pixels), 0) AS BIGINT) AS training_pixels, true AS has_required_channels,
  count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'validation') > 0 AS has_train_and_validation,
  coalesce(sum(training_pixels), 0) >= 100 AS has_enough_pixels,
  CASE WHEN count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'validation') > 0 AND sum(training_pixels) >= 100 THEN 'ready' ELSE 'blocked' END AS status
FROM patch_seq""")
def training_preflight(spark, d):
    return pt.preflight(sequenced(spark, d), len(INDICES), 4, 100)


view("patch_rec", """
SELECT vec_id AS patch_id, CAST(2023 + vec_id % 4 AS INTEGER) AS year, label, embedding,
  CASE WHEN vec_id % 4 <= 1 THEN 'train' WHEN vec_id % 4 = 2 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN vec_id % 23 <> 0 THEN vec_id % 17 * 8 + 1 ELSE 0 END AS na, CASE WHEN vec_id % 23 <> 0 THEN vec_id % 29 ELSE 0 END AS nb,
  CASE WHEN vec_id % 23 <> 0 THEN 3 ELSE 0 END AS nc, label % 5 + 1 AS ca, (label + 1) % 5 + 1 AS cb, (label + 2) % 5 + 1 AS cc FROM embeddings""")
view("patch_dom", """
SELECT patch_id, year, split, CAST(coalesce(CASE WHEN na + nb + nc > 0 THEN least(CASE WHEN na = mx THEN ca ELSE 9 END, CASE WHEN nb = mx THEN cb ELSE 9 END,
         CASE WHEN nc = mx THEN cc ELSE 9 END) END, 0) AS INTEGER) AS class_id,
  CASE WHEN na + nb + nc > 0 THEN round(mx / CAST(na + nb + nc AS DOUBLE), 6) ELSE 0e0 END AS fraction, na, nb, nc
FROM (SELECT *, greatest(na, nb, nc) AS mx FROM patch_rec)""")


def dominant(spark, d):
    p = obs.patch_records(spark, d)
    hist = F.coalesce(F.col("class_hist"), F.create_map().cast("map<int,bigint>"))
    best = md.dominant_entry(hist)
    total = F.aggregate(F.map_values(hist), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return p.withColumns({
        "class_id": best["class_id"],
        "fraction": F.round(md.fraction(best["count"], total, 0.0), 6),
        "mix_entropy": F.round(md.histogram_entropy(F.map_values(hist)), 6),
    })


def plogp(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {n} / CAST(na + nb + nc AS DOUBLE) * ln({n} / CAST(na + nb + nc AS DOUBLE)) ELSE 0e0 END"


@query("dominant_labels", f"""
SELECT patch_id, class_id, fraction, round(CASE WHEN (na > 0)::INT + (nb > 0)::INT + (nc > 0)::INT > 1 THEN
  -({plogp('na')} + {plogp('nb')} + {plogp('nc')}) / ln((na > 0)::INT + (nb > 0)::INT + (nc > 0)::INT) ELSE 0e0 END, 6) AS mix_entropy FROM patch_dom""")
def dominant_labels(spark, d):
    return dominant(spark, d).select("patch_id", "class_id", "fraction", "mix_entropy")


view("leak_rec", "SELECT patch_id, year, label, CASE WHEN patch_id % 97 = 3 THEN 'train' ELSE split END AS split FROM patch_rec")
view("leak_findings", """
SELECT 'frozen_year_outside_test' AS finding, CAST(patch_id AS VARCHAR) AS subject, split AS detail FROM leak_rec WHERE year >= 2026 AND split <> 'test'
UNION ALL SELECT 'tag_in_several_splits', CAST(label AS VARCHAR), string_agg(DISTINCT split, ',' ORDER BY split) FROM leak_rec GROUP BY label HAVING count(DISTINCT split) > 1""")


def leakage(spark, d):
    p = obs.patch_records(spark, d).withColumn(
        "split", F.when(F.col("patch_id") % 97 == 3, "train").otherwise(F.col("split")))
    return pt.leakage_findings(p, "label")


@query("leakage_findings", "SELECT * FROM leak_findings")
def leakage_findings(spark, d):
    return leakage(spark, d)


@query("leakage_status", "SELECT count(*) AS violation_count, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status FROM leak_findings")
def leakage_status(spark, d):
    return pt.leakage_status(leakage(spark, d))


@query("patch_payload", """
SELECT scene, y // 8 AS prow, x // 8 AS pcol, string_agg(CAST(y % 8 * 8 + x % 8 AS VARCHAR), ',' ORDER BY y % 8 * 8 + x % 8) AS positions,
  string_agg(CAST(CAST(round(nir * 1e4) AS BIGINT) AS VARCHAR), ',' ORDER BY y % 8 * 8 + x % 8) AS nir FROM px GROUP BY ALL""")
def patch_payload(spark, d):
    p = pt.patch_payload(obs.pixels(spark, d), ["nir"], 8)
    return p.select("scene", "prow", "pcol", F.array_join(F.col("pos").cast("array<string>"), ",").alias("positions"),
                    F.array_join(F.transform("nir", lambda v: F.round(v * 1e4).cast("bigint").cast("string")), ",").alias("nir"))
