"""Label-free track: descriptors, clusters, anomaly, review sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.functions import model as md
from landshift.operators import embed as em, experiments as ex, fits, overlay, review as rv, votes
from landshift.operators.ranking import hash_sample
from landshift.plans.change import detected
from landshift.plans.labels import evidence
from landshift.plans.patches import dominant
from landshift.plans.registry import query, view
from landshift.plans.twins import axes_sql, lloyd_sql, squared
from landshift.sources import observations as obs
from landshift.storage import store

DIMS, CODE, WIDE, K, K_WIDE = 20, 4, 6, 5, 4  # descriptor width, axes of the code and of the wide code, clusters of codes and of descriptors
STEPS, SEED = 10, 42
PIXEL_CENTROIDS = [[0.6, -0.7, 0.0], [-0.3, 0.2, 0.3], [0.2, -0.2, -0.3], [0.8, -0.9, -0.6]]
STATS = ["mean", "std", "p10", "p50", "p90"]


def values(spark, d):
    """Patch pixels in long form with the training mask."""
    p = obs.patch_records(spark, d)
    return p.select("patch_id", "year", "split", F.posexplode("vector").alias("pos", "value")).select(
        "*", F.floor(F.col("pos") / 16).cast("int").alias("channel"),
        (((F.col("patch_id") + F.col("pos")) % 3 != 0) & (F.col("patch_id") % 19 != 0)).alias("mask"))


view("pvals", """
SELECT patch_id, year, split, pos, v AS value, CAST(pos // 16 AS INTEGER) AS channel, (patch_id + pos) % 3 <> 0 AND patch_id % 19 <> 0 AS mask
FROM (SELECT patch_id, year, split, CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS v
      FROM (SELECT *, unnest(range(1, 65)) AS i FROM patch_rec))""")


def desc_sql(probs):
    q = ", ".join(f"quantile_cont(value, {p}) AS p{round(p * 100):02d}" for p in probs)
    return f"SELECT patch_id, channel, avg(value) AS mean, stddev_pop(value) AS std, {q} FROM (" \
           "SELECT * FROM (SELECT *, bool_or(mask) OVER (PARTITION BY patch_id, channel) AS any_mask FROM pvals) WHERE mask OR NOT any_mask) GROUP BY 1, 2"


view("descs", desc_sql([0.1, 0.5, 0.9]))


def _r(df, names, k=10):
    return df.select("patch_id", "channel", *[F.round(n, k).alias(n) for n in names])


@query("patch_descriptors", "SELECT patch_id, channel, " + ", ".join(f"round({n}, 10) AS {n}" for n in STATS) + " FROM descs")
def patch_descriptors(spark, d):
    return _r(em.descriptors(values(spark, d), [0.1, 0.5, 0.9]), STATS)


@query("patch_descriptors_quartiles", "SELECT patch_id, channel, " + ", ".join(f"round({n}, 10) AS {n}" for n in ["mean", "std", "p05", "p25", "p50", "p75"])
       + f" FROM ({desc_sql([0.05, 0.25, 0.5, 0.75])})")
def patch_descriptors_quartiles(spark, d):
    return _r(em.descriptors(values(spark, d), [0.05, 0.25, 0.5, 0.75]), ["mean", "std", "p05", "p25", "p50", "p75"])


@query("grid_descriptors", """
SELECT patch_id, CAST(pos // 8 // 2 * 4 + pos % 8 // 2 AS INTEGER) AS cell, round(avg(value), 10) AS mean, round(stddev_pop(value), 10) AS std FROM pvals GROUP BY 1, 2""")
def grid_descriptors(spark, d):
    return em.grid_descriptor(values(spark, d), 8, 4).select("patch_id", "cell", F.round("mean", 10).alias("mean"), F.round("std", 10).alias("std"))


@query("channel_moments", """
SELECT channel, count(*) AS n, round(avg(value), 6) AS mean, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 1e-6)), 6) AS std
FROM pvals WHERE split = 'train' GROUP BY 1""")
def channel_moments(spark, d):
    return em.channel_moments(values(spark, d)).select("channel", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


view("dlong", """
SELECT patch_id, channel * 5 + k AS dim, CASE k WHEN 0 THEN mean WHEN 1 THEN std WHEN 2 THEN p10 WHEN 3 THEN p50 ELSE p90 END AS v
FROM descs, (SELECT unnest(range(5)) AS k)""")
view("scaled", """
SELECT l.patch_id, l.dim, p.year, p.split, (v - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM dlong l JOIN patch_rec p USING (patch_id)
JOIN (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM dlong JOIN patch_rec USING (patch_id) WHERE split = 'train' GROUP BY dim) f USING (dim)
WHERE p.year < 2026""")


def scaled(spark, d):
    vec = em.descriptor_vectors(em.descriptors(values(spark, d), [0.1, 0.5, 0.9]), STATS)
    meta = em.without_frozen(dominant(spark, d)).select("patch_id", "year", "split", "class_id", "fraction", "label")
    return em.standard_scale(meta.join(vec, "patch_id"), DIMS)


@query("scaled_descriptors", "SELECT patch_id, CAST(dim AS INTEGER) AS dim, round(z, 5) AS z FROM scaled")
def scaled_descriptors(spark, d):
    return scaled(spark, d).select("patch_id", F.posexplode("scaled").alias("dim", "z")).withColumn("z", F.round("z", 5))


view("scaled_cov", """
SELECT '' AS key, a.dim AS i, b.dim AS j, avg(a.z * b.z) - avg(a.z) * avg(b.z) AS v FROM scaled a JOIN scaled b USING (patch_id) WHERE a.split = 'train' GROUP BY 2, 3""")
view("axes", axes_sql("scaled_cov", DIMS, WIDE), stored=True)
view("codes", f"""
SELECT patch_id, any_value(split) AS split, r AS j, sum(z * axis[dim + 1]) AS h FROM scaled CROSS JOIN axes WHERE r < {CODE} GROUP BY patch_id, r""")
view("errors", f"""
SELECT patch_id, avg((z - r) * (z - r)) AS error FROM (
  SELECT s.patch_id, s.dim, any_value(s.z) AS z, sum(c.h * a.axis[s.dim + 1]) AS r
  FROM scaled s JOIN codes c ON s.patch_id = c.patch_id JOIN axes a ON a.r = c.j GROUP BY 1, 2) GROUP BY 1""")


def spread(source: str, dims: int, value: str, at: str) -> str:
    """Rows (space, id, split, f1...) from one row per patch and component."""
    columns = ", ".join(f"max({value}) FILTER ({at} = {i}) AS f{i + 1}" for i in range(dims))
    return f"SELECT '' AS space, patch_id AS id, any_value(split) AS split, {columns} FROM {source} GROUP BY patch_id"


def centres_sql(points: str, dims: int, k: int) -> str:
    columns = ", ".join(f"f{i} AS c{i}" for i in range(1, dims + 1))
    return f"""SELECT '' AS config, space, row_number() OVER (ORDER BY md5(id || '-{SEED}'), CAST(id AS VARCHAR)) - 1 AS place, {columns}
FROM {points} QUALIFY row_number() OVER (ORDER BY md5(id || '-{SEED}'), CAST(id AS VARCHAR)) <= {k}"""


def assigned_sql(points: str, centroids: str, dims: int) -> str:
    return f"""
SELECT id AS patch_id, CAST(place + 1 AS INTEGER) AS cluster, sqrt({squared(dims)}) AS dist FROM {points} p JOIN {centroids} c ON c.space = p.space
QUALIFY row_number() OVER (PARTITION BY id ORDER BY {squared(dims)}, place) = 1"""


view("code_points", spread("codes", CODE, "h", "j"))
view("code_train", "SELECT * FROM code_points WHERE split = 'train'")
view("code_centres", centres_sql("code_train", CODE, K))
view("code_centroids", lloyd_sql("code_train", "code_centres", CODE, STEPS))
view("assigned", assigned_sql("code_points", "code_centroids", CODE))
view("scaled_points", spread("scaled", DIMS, "z", "dim"))
view("scaled_train", "SELECT * FROM scaled_points WHERE split = 'train'")
view("scaled_centres", centres_sql("scaled_train", DIMS, K_WIDE))
view("scaled_centroids", lloyd_sql("scaled_train", "scaled_centres", DIMS, STEPS))
view("anomalies", """
SELECT patch_id, cluster, least(greatest((raw - lo) / (hi - lo + 1e-9), 0e0), 1e0) AS anomaly FROM
  (SELECT patch_id, cluster, round(0.5e0 * error + 0.5e0 * dist, 9) AS raw FROM assigned JOIN errors USING (patch_id)),
  (SELECT quantile_cont(round(0.5e0 * error + 0.5e0 * dist, 9), 0.05) AS lo, quantile_cont(round(0.5e0 * error + 0.5e0 * dist, 9), 0.95) AS hi
   FROM assigned JOIN errors USING (patch_id))""")


def fitted_axes(s, k):
    """Axes fitted to the train patches (k x dims numbers) and the share of variance they hold."""
    r = fits.principal_axes(s.where("split = 'train'"), "scaled", DIMS, k).first()
    return ([], None) if r is None else (r.axes, r.explained)


def fitted_centroids(s, vector, k):
    """Centroids fitted to the train patches."""
    train = s.where("split = 'train'").select(F.lit("").alias("space"), "patch_id", F.col(vector).alias("v"))
    first = fits.first_centres(train, "space", F.col("patch_id").cast("string"), "v", k, SEED)
    run = fits.Configuration("", k, first[""])
    fits.lloyd(train, [run], STEPS)
    return run.centroids.tolist()


def coded(spark, d):
    s = store(scaled(spark, d))
    return store(em.linear_autoencode(s, "scaled", fitted_axes(s, CODE)[0]))


def encoded(spark, d):
    c = coded(spark, d)
    return em.assign_clusters(c, "code", fitted_centroids(c, "code", K))


def anomalies(spark, d):
    return em.anomaly_scores(encoded(spark, d)).withColumn("anomaly", F.round("anomaly", 6))


@query("encoded_patches", "SELECT patch_id, CAST(j AS INTEGER) AS unit, round(h, 5) AS h FROM codes")
def encoded_patches(spark, d):
    return coded(spark, d).select("patch_id", F.posexplode("code").alias("unit", "h")).withColumn("h", F.round("h", 5))


@query("cluster_assignment", "SELECT patch_id, cluster, round(dist, 5) AS center_distance FROM assigned")
def cluster_assignment(spark, d):
    return encoded(spark, d).select("patch_id", "cluster", F.round("center_distance", 5).alias("center_distance"))


@query("anomaly_scores", "SELECT patch_id, round(anomaly, 5) AS anomaly FROM anomalies")
def anomaly_scores(spark, d):
    return em.anomaly_scores(encoded(spark, d)).select("patch_id", F.round("anomaly", 5).alias("anomaly"))


view("layer", """
SELECT a.patch_id, cluster, round(anomaly, 6) AS anomaly, p.year, p.class_id, p.fraction,
  CASE WHEN round(anomaly, 6) >= 0.9e0 THEN 'high_anomaly' WHEN fraction < 0.65e0 THEN 'weak_support_review' ELSE 'embedding_supported' END AS priority
FROM anomalies a JOIN patch_dom p USING (patch_id)""")
view("profile", """
SELECT m.cluster, CAST(sum(n) AS BIGINT) AS patch_count, arg_max(class_id, n * 100 - class_id) AS dominant_class, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS dominant_share,
  string_agg(class_id || ':' || n, ',' ORDER BY class_id) AS label_mix,
  round(CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) ELSE 0e0 END, 6) AS mix_entropy
FROM (SELECT cluster, class_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY cluster) AS DOUBLE) AS t FROM layer GROUP BY 1, 2) m GROUP BY 1""")


@query("cluster_profile", """
SELECT p.*, l.mean_fraction, l.mean_anomaly, y.year_mix, e.examples FROM profile p
JOIN (SELECT cluster, round(sum(CAST(round(fraction * 1e6) AS BIGINT)) / (count(*) * 1e6), 6) AS mean_fraction,
             round(sum(CAST(round(anomaly * 1e6) AS BIGINT)) / (count(*) * 1e6), 5) AS mean_anomaly FROM layer GROUP BY 1) l USING (cluster)
JOIN (SELECT cluster, string_agg(year || ':' || n, ',' ORDER BY year) AS year_mix FROM (SELECT cluster, year, count(*) AS n FROM layer GROUP BY 1, 2) GROUP BY 1) y USING (cluster)
JOIN (SELECT cluster, string_agg(CAST(patch_id AS VARCHAR), ',' ORDER BY patch_id) AS examples FROM (
        SELECT cluster, patch_id FROM layer QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY patch_id) <= 5) GROUP BY 1) e USING (cluster)""")
def cluster_profile(spark, d):
    return em.cluster_profile(anomalies(spark, d))


@query("track_metrics", """
SELECT count(*) AS patch_count, round(sum(CAST(round(fraction * 1e6) AS BIGINT)) / (count(*) * 1e6), 6) AS weak_compatibility,
  round(count(*) FILTER (fraction < 0.65e0 OR anomaly >= 0.9e0) / CAST(count(*) AS DOUBLE), 6) AS review_burden,
  round(count(*) FILTER (anomaly >= 0.9e0) / CAST(count(*) AS DOUBLE), 6) AS high_anomaly_fraction,
  (SELECT round(avg(mix_entropy), 5) FROM profile) AS mean_ambiguity,
  (SELECT round(count(*) FILTER (dominant_share >= 0.65e0) / CAST(count(*) AS DOUBLE), 6) FROM profile) AS coherent_fraction FROM layer""")
def track_metrics(spark, d):
    a = anomalies(spark, d)
    return em.track_metrics(a, em.cluster_profile(a))


@query("review_layer", "SELECT patch_id, priority, cluster FROM layer")
def review_layer(spark, d):
    return rv.with_priority(anomalies(spark, d)).select("patch_id", "priority", "cluster")


@query("priority_areas", "SELECT priority, count(*) AS patch_count, count(*) * 6400e0 AS area_m2 FROM layer GROUP BY 1")
def priority_areas(spark, d):
    return rv.priority_areas(rv.with_priority(anomalies(spark, d)), 8, 100.0)


@query("review_samples", """
SELECT patch_id, priority, class_id, year, review_score, row_number() OVER (ORDER BY review_score DESC, anomaly DESC, patch_id) AS sample_rank,
  CASE WHEN priority = 'embedding_supported' THEN 'control_after_review' ELSE 'candidate_review' END AS sampling_role,
  CASE priority """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rv.ACTIONS.items()) + """ END AS recommended_action
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY priority, class_id, year ORDER BY review_score DESC, anomaly DESC, patch_id) AS s FROM (
  SELECT *, round(0.5e0 * anomaly + 0.35e0 * greatest(0e0, 1 - fraction)
    + 0.15e0 * CASE priority WHEN 'high_anomaly' THEN 1e0 WHEN 'weak_support_review' THEN 0.75e0 ELSE 0.15e0 END, 6) AS review_score FROM layer)) WHERE s <= 3)
ORDER BY sample_rank LIMIT 40""")
def review_samples(spark, d):
    return rv.review_samples(rv.with_priority(anomalies(spark, d)), 40, 3).select(
        "patch_id", "priority", "class_id", "year", "review_score", "sample_rank", "sampling_role", "recommended_action")


@query("hash_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '-11'), doc_id LIMIT 200")
def sampled_documents(spark, d):
    return hash_sample(obs.table(spark, d, "documents"), "doc_id", 200, 11).select("doc_id")


@query("quota_sample", """
WITH t AS (SELECT patch_id, split FROM patch_rec WHERE split = 'train' AND year < 2026 ORDER BY md5(patch_id || '-5'), patch_id LIMIT 78),
o AS (SELECT patch_id, split FROM patch_rec WHERE split <> 'train' AND year < 2026 QUALIFY row_number() OVER (ORDER BY md5(patch_id || '-5'), patch_id) <= 120 - (SELECT count(*) FROM t))
SELECT * FROM t UNION ALL SELECT * FROM o""")
def quota_sample(spark, d):
    return em.quota_sample(em.without_frozen(obs.patch_records(spark, d)), "patch_id", 120, 5).select("patch_id", "split")


@query("silhouette", """
WITH s AS (SELECT patch_id, cluster FROM assigned ORDER BY md5(patch_id || '-42'), patch_id LIMIT 300),
d AS (SELECT a.patch_id, sa.cluster AS own, sb.cluster AS other, sqrt(sum((a.h - b.h) * (a.h - b.h))) AS dist
      FROM s sa JOIN codes a ON a.patch_id = sa.patch_id JOIN codes b ON b.j = a.j JOIN s sb ON sb.patch_id = b.patch_id GROUP BY a.patch_id, b.patch_id, sa.cluster, sb.cluster),
m AS (SELECT patch_id, own, other, sum(dist) / CASE WHEN own = other THEN greatest(count(*) - 1, 1) ELSE count(*) END AS avg_d, count(*) AS n FROM d GROUP BY 1, 2, 3),
p AS (SELECT patch_id, max(avg_d) FILTER (own = other) AS a, min(avg_d) FILTER (own <> other) AS b, max(n) FILTER (own = other) AS n FROM m GROUP BY 1)
SELECT CAST(count(*) AS INTEGER) AS sample_size, CAST((SELECT count(DISTINCT cluster) FROM s) AS INTEGER) AS cluster_count,
  round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS silhouette FROM p""")
def silhouette(spark, d):
    return em.silhouette(encoded(spark, d), "patch_id", "code", "cluster", 300, 42)


@query("silhouette_all", """
WITH p AS (SELECT patch_id, cluster, list(h ORDER BY j) AS v, sum(h * h) AS sq FROM codes JOIN assigned USING (patch_id) GROUP BY 1, 2),
c AS (SELECT cluster, j, sum(h) AS s FROM codes JOIN assigned USING (patch_id) GROUP BY 1, 2),
k AS (SELECT cluster, count(*) AS n, sum(sq) AS sq FROM p GROUP BY 1),
d AS (SELECT p.patch_id, p.cluster AS own, k.cluster AS other, k.n,
        k.n * p.sq + k.sq - 2 * (SELECT sum(p.v[c.j + 1] * c.s) FROM c WHERE c.cluster = k.cluster) AS total FROM p CROSS JOIN k),
m AS (SELECT patch_id, max(total / greatest(n - 1, 1)) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b, max(n) FILTER (own = other) AS n FROM d GROUP BY 1)
SELECT count(*) AS row_count, (SELECT count(*) FROM k) AS cluster_count,
  round(avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS silhouette FROM m""")
def silhouette_all(spark, d):
    """Squared-distance silhouette of every patch, from one sum per cluster."""
    return em.silhouette_all(encoded(spark, d), "code", "cluster", CODE)


PIXEL_CLUSTER_SQL = """
SELECT scene, y, x, CAST(k AS INTEGER) AS cluster FROM (
  SELECT scene, y, x, k, row_number() OVER (PARTITION BY scene, y, x ORDER BY sqrt((ndvi - c[1]) * (ndvi - c[1]) + (ndwi - c[2]) * (ndwi - c[2]) + (ndbi - c[3]) * (ndbi - c[3])), k) AS rn
  FROM feat, (SELECT unnest([1, 2, 3, 4]) AS k, unnest([[0.6e0, -0.7e0, 0e0], [-0.3e0, 0.2e0, 0.3e0], [0.2e0, -0.2e0, -0.3e0], [0.8e0, -0.9e0, -0.6e0]]) AS c)
  WHERE ndvi IS NOT NULL AND ndwi IS NOT NULL AND ndbi IS NOT NULL) WHERE rn = 1
UNION ALL SELECT scene, y, x, 0 FROM feat WHERE ndvi IS NULL OR ndwi IS NULL OR ndbi IS NULL"""


@query("pixel_clusters", PIXEL_CLUSTER_SQL)
def pixel_clusters(spark, d):
    """Cluster raster: the nearest centroid of every pixel, 0 where an index is missing."""
    f = obs.features(spark, d).withColumn("v", F.when(
        F.col("ndvi").isNotNull() & F.col("ndwi").isNotNull() & F.col("ndbi").isNotNull(), F.array("ndvi", "ndwi", "ndbi")))
    return em.assign_clusters(f, "v", PIXEL_CENTROIDS).select("scene", "y", "x", "cluster")


@query("pixel_cluster_profile", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY scene, y, x ORDER BY dist, k) AS rn FROM (
  SELECT scene, y, x, ndvi, ndwi, ndbi, k, sqrt((ndvi - c[1]) * (ndvi - c[1]) + (ndwi - c[2]) * (ndwi - c[2]) + (ndbi - c[3]) * (ndbi - c[3])) AS dist
  FROM feat, (SELECT unnest([1, 2, 3, 4]) AS k, unnest([[0.6e0, -0.7e0, 0e0], [-0.3e0, 0.2e0, 0.3e0], [0.2e0, -0.2e0, -0.3e0], [0.8e0, -0.9e0, -0.6e0]]) AS c)
  WHERE ndvi IS NOT NULL AND ndwi IS NOT NULL AND ndbi IS NOT NULL)),
g AS (SELECT k AS cluster, count(*) AS pixel_count, count(*) * 100e0 AS area_m2, """ + ", ".join(
    f"round(sum(CAST(round({f} * 1e6) AS BIGINT)) / (count({f}) * 1e6), 5) AS {f}" for f in ("ndvi", "ndwi", "ndbi")) + """ FROM a WHERE rn = 1 GROUP BY k)
SELECT *, CASE WHEN ndwi >= 0.2e0 THEN 'water_moisture' WHEN ndvi >= 0.45e0 AND ndvi > ndbi THEN 'vegetation' WHEN ndbi >= 0.12e0 AND ndbi > ndvi THEN 'built_up'
  WHEN ndvi <= 0.2e0 AND ndbi <= 0.12e0 THEN 'bare_sparse' ELSE 'mixed' END AS state FROM g""")
def pixel_cluster_profile(spark, d):
    f = obs.features(spark, d).withColumn("v", F.when(
        F.col("ndvi").isNotNull() & F.col("ndwi").isNotNull() & F.col("ndbi").isNotNull(), F.array("ndvi", "ndwi", "ndbi")))
    return em.pixel_cluster_profile(em.assign_clusters(f, "v", PIXEL_CENTROIDS), ["ndvi", "ndwi", "ndbi"], 100.0)


@query("kmeans_clusters", f"""
SELECT cluster, count(*) AS patch_count FROM ({assigned_sql("scaled_points", "scaled_centroids", DIMS)}) GROUP BY cluster""")
def kmeans_clusters(spark, d):
    s = store(scaled(spark, d))
    return em.assign_clusters(s, "scaled", fitted_centroids(s, "scaled", K_WIDE)).groupBy("cluster").agg(F.count(F.lit(1)).alias("patch_count"))


@query("linear_autoencoder", f"""
SELECT patch_id, round(avg((z - r) * (z - r)), 6) AS error, (SELECT round(any_value(explained), 6) FROM axes) AS explained_variance FROM (
  SELECT s.patch_id, s.dim, any_value(s.z) AS z, sum(c.h * a.axis[s.dim + 1]) AS r
  FROM scaled s JOIN (SELECT patch_id, r AS j, sum(z * axis[dim + 1]) AS h FROM scaled CROSS JOIN axes GROUP BY 1, 2) c ON s.patch_id = c.patch_id
  JOIN axes a ON a.r = c.j GROUP BY 1, 2) GROUP BY 1""")
def linear_autoencoder(spark, d):
    s = store(scaled(spark, d))
    axes, explained = fitted_axes(s, WIDE)
    return em.linear_autoencode(s, "scaled", axes).select(
        "patch_id", F.round("error", 6).alias("error"), F.round(F.lit(explained), 6).alias("explained_variance"))


@query("principal_axes", "SELECT r, i AS dim, round(axis[i + 1], 5) AS weight FROM axes, (SELECT unnest(range(20)) AS i)")
def principal_axes(spark, d):
    axes = fits.principal_axes(scaled(spark, d).where("split = 'train'"), "scaled", DIMS, WIDE)
    return axes.select(F.posexplode("axes").alias("r", "axis")).select(F.col("r").cast("bigint"), F.posexplode("axis").alias("dim", "w")).select(
        "r", F.col("dim").cast("bigint"), F.round("w", 5).alias("weight"))


# clustering experiments over the first and the last scene
SETS = {"sentinel2": ("ndvi", "ndwi", "ndbi"), "fusion": ("ndvi", "ndwi", "ndbi", "vv", "vh", "ratio")}
KS = (4, 5, 6, 8, 10)
GRID_STEPS, D = 6, 6
F6 = [f"f{i}" for i in range(1, D + 1)]
view("xhigh", """
SELECT DISTINCT scene, y, x FROM (SELECT before_scene AS scene, y, x, confidence FROM detected UNION ALL SELECT after_scene, y, x, confidence FROM detected)
WHERE confidence >= 0.75e0""")
view("xraw", """
SELECT f.scene || '|' || s || '|' || m AS space, f.scene || '_' || f.y || '_' || f.x AS id, f.y, f.x, ndvi AS f1, ndwi AS f2, ndbi AS f3,
  CASE s WHEN 'fusion' THEN vv ELSE 0e0 END AS f4, CASE s WHEN 'fusion' THEN vh ELSE 0e0 END AS f5, CASE s WHEN 'fusion' THEN ratio ELSE 0e0 END AS f6
FROM feat f LEFT JOIN xhigh h ON h.scene = f.scene AND h.y = f.y AND h.x = f.x,
  (SELECT unnest(['sentinel2', 'fusion']) AS s), (SELECT unnest(['all', 'high_confidence_change']) AS m)
WHERE f.scene IN (SELECT unnest([min(scene), max(scene)]) FROM px) AND (m = 'all' OR h.scene IS NOT NULL)
  AND ndvi IS NOT NULL AND ndwi IS NOT NULL AND ndbi IS NOT NULL AND (s = 'sentinel2' OR (vv IS NOT NULL AND vh IS NOT NULL AND ratio IS NOT NULL))""")
view("xscaled", "SELECT space, id, y, x, " + ", ".join(f"({f} - m{f}) / CASE WHEN d{f} > 0 THEN d{f} ELSE 1 END AS {f}" for f in F6) + " FROM xraw JOIN (SELECT space, "
     + ", ".join(f"avg({f}) AS m{f}, stddev_pop({f}) AS d{f}" for f in F6) + " FROM xraw GROUP BY space) USING (space)")
view("xcov", f"""
SELECT space AS key, i, j, avg(f[i] * f[j]) - avg(f[i]) * avg(f[j]) AS v FROM (SELECT space, [{', '.join(F6)}] AS f FROM xscaled),
  (SELECT unnest(range(1, {D + 1})) AS i), (SELECT unnest(range(1, {D + 1})) AS j) GROUP BY 1, 2, 3""")
view("xaxes", axes_sql("xcov", D, 3), stored=True)
view("xpoints", "SELECT space || '|none' AS space, id, y, x, " + ", ".join(F6) + " FROM xscaled UNION ALL SELECT space || '|pca', id, y, x, "
     + ", ".join(" + ".join(f"{f} * a{r}[{i}]" for i, f in enumerate(F6, 1)) for r in range(3))
     + ", 0e0, 0e0, 0e0 FROM xscaled JOIN (SELECT key, " + ", ".join(f"any_value(axis) FILTER (r = {r}) AS a{r}" for r in range(3)) + " FROM xaxes GROUP BY key) ON key = space",
     stored=True)
view("xcentres", f"""
SELECT space || '|' || k AS config, space, place - 1 AS place, {", ".join(f"{f} AS c{f[1:]}" for f in F6)}
FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY md5(id || '-{SEED}'), id) AS place FROM xpoints), (SELECT unnest({list(KS)}) AS k) WHERE place <= k""")
view("xcent", lloyd_sql("xpoints", "xcentres", D, GRID_STEPS), stored=True)
view("xown", f"""
SELECT config, p.space, id, y, x, place, {", ".join(F6)} FROM xpoints p JOIN xcent c ON c.space = p.space
QUALIFY row_number() OVER (PARTITION BY config, id ORDER BY {squared(D)}, place) = 1""", stored=True)
SQUARE = " + ".join(f"{f} * {f}" for f in F6)
view("xscore", f"""
SELECT config, CASE WHEN max(clusters) > 1 THEN avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) END AS silhouette FROM (
  SELECT o.config, o.id, count(*) AS clusters, max(CASE WHEN o.place = c.place THEN total / greatest(n - 1, 1) END) AS a,
    min(CASE WHEN o.place <> c.place THEN total / n END) AS b, max(CASE WHEN o.place = c.place THEN n END) AS n
  FROM xown o JOIN (SELECT config, place, count(*) AS n, sum({SQUARE}) AS sq, {", ".join(f"sum({f}) AS s{f[1:]}" for f in F6)} FROM xown GROUP BY 1, 2) c
    ON c.config = o.config, LATERAL (SELECT n * ({SQUARE}) + sq - 2 * ({" + ".join(f"{f} * s{f[1:]}" for f in F6)}) AS total) GROUP BY 1, 2) GROUP BY config""")
view("xruns", f"""
SELECT scene, feature_set, reduction, mask_mode, k, CASE WHEN n IS NULL THEN 'skipped' ELSE 'ok' END AS status,
  CASE WHEN n IS NULL THEN 'no valid pixels' END AS reason, coalesce(n, 0) AS pixel_count,
  CASE WHEN reduction = 'pca' THEN round(explained, 4) END AS explained_variance, round(silhouette, 4) AS silhouette
FROM (SELECT CAST(unnest([min(scene), max(scene)]) AS INTEGER) AS scene FROM px), (SELECT unnest(['sentinel2', 'fusion']) AS feature_set),
  (SELECT unnest(['none', 'pca']) AS reduction), (SELECT unnest(['all', 'high_confidence_change']) AS mask_mode), (SELECT unnest({list(KS)}) AS k)
LEFT JOIN (SELECT space, count(*) AS n FROM xraw GROUP BY 1) q ON q.space = scene || '|' || feature_set || '|' || mask_mode
LEFT JOIN (SELECT key, any_value(explained) AS explained FROM xaxes GROUP BY 1) e ON e.key = scene || '|' || feature_set || '|' || mask_mode
LEFT JOIN xscore s ON s.config = scene || '|' || feature_set || '|' || mask_mode || '|' || reduction || '|' || k""")
view("xranked", """
SELECT *, CAST(row_number() OVER (ORDER BY status <> 'ok', silhouette DESC NULLS LAST, scene, feature_set, reduction, mask_mode, k) AS INTEGER) AS rank FROM xruns""")


def experiment_grid(spark, d):
    ends = overlay.consecutive_pairs(obs.table(spark, d, "lineitem").select((F.year("l_shipdate") - obs.SCENE_EPOCH).alias("scene"))).agg(
        F.min("before_scene"), F.max("after_scene")).first()
    change = detected(spark, d).where("confidence >= 0.75")
    confident = change.select(F.explode(F.array("before_scene", "after_scene")).alias("scene"), "y", "x").distinct().withColumn("high", F.lit(True))
    px = obs.features(spark, d).where(F.col("scene").isin(*ends)).join(confident, ["scene", "y", "x"], "left").withColumn("high", F.coalesce("high", F.lit(False)))
    points, axes = ex.feature_spaces(px, SETS, "high")
    found, runs = ex.run_experiments(spark, points, axes, list(ends), list(SETS), KS, SEED, GRID_STEPS)
    return points, ex.ranked_experiments(found), runs


@query("clustering_experiments", "SELECT * FROM xranked")
def clustering_experiments(spark, d):
    """Silhouette of every scene, feature set, reduction, mask and cluster count."""
    return experiment_grid(spark, d)[1]


@query("best_experiment_clusters", """
SELECT r.scene, y, x, CAST(place + 1 AS INTEGER) AS cluster FROM xown o JOIN xranked r
  ON o.config = r.scene || '|' || feature_set || '|' || mask_mode || '|' || reduction || '|' || k WHERE rank = 1""")
def best_experiment_clusters(spark, d):
    """Cluster raster of the best experiment."""
    return ex.best_clusters(*experiment_grid(spark, d))


@query("expert_sample", """
WITH k AS (SELECT scene || '_' || y || '_' || x AS px_id, CASE WHEN agreement > 0 AND source_count >= 2 AND NOT disagreement AND confidence >= 0.6e0 AND entropy < 0.65e0 THEN 'reliable_prediction'
  WHEN model_class IN (3, 4, 5) AND entropy < 0.65e0 THEN 'minority_classes' WHEN disagreement OR entropy >= 0.65e0 OR confidence < 0.6e0 THEN 'review_zone' END AS stratum FROM evidence)
SELECT px_id, stratum FROM k WHERE stratum IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(px_id || '-150'), px_id) <= CASE stratum WHEN 'minority_classes' THEN 45 WHEN 'reliable_prediction' THEN 53 ELSE 52 END""")
def expert_sample(spark, d):
    z = votes.with_zones(evidence(spark, d))
    s = F.when(F.col("agreement_zone") & (F.col("confidence") >= 0.6) & (F.col("entropy") < 0.65), "reliable_prediction").when(
        F.col("model_class").isin(3, 4, 5) & (F.col("entropy") < 0.65), "minority_classes").when(F.col("review_zone"), "review_zone")
    keyed = z.select(F.concat_ws("_", "scene", "y", "x").alias("px_id"), s.alias("stratum"))
    return rv.expert_sample(keyed, "px_id", 150, 150)
