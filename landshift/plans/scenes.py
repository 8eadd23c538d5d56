"""Scene catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.config import SceneSearch
from landshift.operators import scenes as sc
from landshift.plans.registry import query, view
from landshift.session import cut_lineage
from landshift.sources import observations as obs
from landshift.sources.sinks import upsert_scenes

SEARCH = SceneSearch(required_tiles=("T0", "T1"), preferred_cloud=12.0, fallback_cloud=60.0, max_groups=4,
                     max_pairs=3, radar_days=2, max_gap_hours=20.0)
REQUIRED, OPTIONAL = (1, 2, 3), (4, 5, 6)
TRAIN, VALIDATION, TEST = (1, 2), (3,), (4,)


def optical(spark, d):
    return obs.scenes(spark, d).where("collection = 'optical'")


def radar(spark, d):
    return obs.scenes(spark, d).where("collection = 'radar'")


def reduced(spark, d):
    """The cleanest tiles and the radar items that can match, written once: one scan of the events each."""
    return cut_lineage(sc.cleanest_tiles(optical(spark, d), SEARCH)), cut_lineage(sc.radar_by_day(radar(spark, d), SEARCH))


def pairs(spark, d):
    return sc.two_tier_pairs(*reduced(spark, d), SEARCH)


view("tile_best", """
SELECT period, day, tile, id, cloud FROM (
  SELECT period, day, tile, id, coalesce(cloud_cover, 100e0) AS cloud,
         row_number() OVER (PARTITION BY day, tile ORDER BY coalesce(cloud_cover, 100e0), id) AS rn
  FROM scene_rows WHERE collection = 'optical') WHERE rn = 1""")
GROUPS = """
SELECT period, day, count(*) AS tiles, sum(CAST(round(cloud * 100) AS BIGINT)) / (count(*) * 100e0) AS mean_cloud,
       max(cloud) AS max_cloud, string_agg(CAST(id AS VARCHAR), ',' ORDER BY tile) AS ids FROM (
  SELECT period, day, tile, id, cloud_cover AS cloud,
         row_number() OVER (PARTITION BY day, tile ORDER BY cloud_cover, id) AS rn
  FROM scene_rows WHERE collection = 'optical' AND cloud_cover < {limit}) WHERE rn = 1 GROUP BY period, day"""
view("groups_all", GROUPS.format(limit="1e9"))
view("groups_strict", GROUPS.format(limit="12"))
view("groups_loose", GROUPS.format(limit="60"))
view("radar_match", """
SELECT day, radar_id, radar_at, orbit_rank, round(gap / 3.6e9, 1) AS gap_hours FROM (
  SELECT o.day, r.id AS radar_id, r.acquired_at AS radar_at,
         CASE WHEN r.orbit = 'ascending' THEN 'ascending' ELSE 'other' END AS orbit_rank,
         abs(epoch_us(r.acquired_at) - epoch_us(CAST(o.day AS TIMESTAMP))) AS gap,
         row_number() OVER (PARTITION BY o.day ORDER BY CASE WHEN r.orbit = 'ascending' THEN 0 ELSE 1 END,
           abs(epoch_us(r.acquired_at) - epoch_us(CAST(o.day AS TIMESTAMP))), abs(r.day - o.day), r.day - o.day, r.id) AS rn
  FROM (SELECT DISTINCT day FROM groups_all) o JOIN scene_rows r
    ON r.collection = 'radar' AND r.has_both AND abs(r.day - o.day) <= 2
   AND abs(epoch_us(r.acquired_at) - epoch_us(CAST(o.day AS TIMESTAMP))) <= 20 * 3600000000)
WHERE rn = 1""")
PAIRS = """
SELECT *, row_number() OVER (PARTITION BY period ORDER BY rank) AS pair_seq FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY mean_cloud, day) AS rank
                 FROM {groups} WHERE tiles = 2) g WHERE rank <= 4) JOIN radar_match USING (day)
QUALIFY pair_seq <= 3"""
view("pairs_strict", PAIRS.format(groups="groups_strict"))
view("pairs_loose", PAIRS.format(groups="groups_loose"))
view("scene_pairs", """
SELECT *, 'preferred' AS cloud_tier, 12e0 AS cloud_limit FROM pairs_strict
UNION ALL SELECT *, 'fallback', 60e0 FROM pairs_loose WHERE period NOT IN (SELECT period FROM pairs_strict)""")


@query("scene_search", """
SELECT id, tile, cloud_cover FROM scene_rows WHERE collection = 'optical' AND x0 <= 80 AND x0 + 10 >= 20 AND y0 <= 70 AND y0 + 10 >= 15
  AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND cloud_cover < 30""")
def scene_search(spark, d):
    return sc.search(obs.scenes(spark, d), "optical", (20, 15, 80, 70), "2024-01-05", "2024-01-20", 30.0).select(
        "id", "tile", "cloud_cover")


@query("flatten_scenes", """
SELECT id, collection, CAST(epoch_us(acquired_at) AS BIGINT) AS acquired_us, cloud_cover, tile, 'r/' || id AS red_href,
       CASE WHEN has_nir THEN 'n/' || id END AS nir_href, CAST(properties->>'$.k' AS INTEGER) AS k FROM scene_rows""")
def flatten_scenes(spark, d):
    s = obs.scenes(spark, d)
    raw = s.select(F.to_json(F.struct(
        "id", "collection",
        F.transform_values("assets", lambda _, v: F.struct(v.alias("href"))).alias("assets"),
        F.struct(F.col("acquired_at").alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover"),
                 F.col("tile").alias("s2:mgrs_tile"), F.col("properties").alias("extra")).alias("properties"),
    ), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("item"))
    f = sc.flatten_items(raw)
    return f.select(
        "id", "collection", F.unix_micros(F.col("acquired_at").cast("timestamp")).alias("acquired_us"), "cloud_cover", "tile",
        F.try_element_at("assets", F.lit("red")).alias("red_href"),
        F.try_element_at("assets", F.lit("nir")).alias("nir_href"),
        F.get_json_object(F.get_json_object("properties", "$.extra"), "$.k").cast("int").alias("k"),
    )


@query("upsert_scenes", """
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.tile ELSE n.tile END AS tile,
       CASE WHEN n.id IS NOT NULL THEN n.cloud_cover ELSE o.cloud_cover END AS cloud_cover
FROM (SELECT * FROM scene_rows WHERE day <= DATE '2024-01-20') o
FULL OUTER JOIN (SELECT id, 'NEW' AS tile, CASE WHEN cloud_cover > 50 THEN NULL ELSE cloud_cover / 2 END AS cloud_cover
                 FROM scene_rows WHERE day >= DATE '2024-01-15') n ON o.id = n.id""")
def upsert(spark, d):
    s = obs.scenes(spark, d)
    old = s.where(F.col("day") <= F.lit("2024-01-20").cast("date"))
    new = s.where(F.col("day") >= F.lit("2024-01-15").cast("date")).withColumns({
        "tile": F.lit("NEW"), "cloud_cover": F.when(F.col("cloud_cover") <= 50, F.col("cloud_cover") / 2)})
    return upsert_scenes(old, new).select("id", "tile", "cloud_cover")


@query("best_item_per_tile", "SELECT CAST(day AS VARCHAR) AS day, tile, cloud, id FROM tile_best")
def best_item_per_tile(spark, d):
    return sc.best_per_tile(optical(spark, d)).select(F.col("day").cast("string").alias("day"), "tile", "cloud", "id")


@query("optical_groups", """
SELECT CAST(day AS VARCHAR) AS day, period, ids, round(mean_cloud, 3) AS mean_cloud, max_cloud, tiles = 2 AS complete
FROM groups_strict""")
def optical_groups(spark, d):
    g = sc.optical_groups(optical(spark, d).where(F.col("cloud_cover") < 12), SEARCH.required_tiles, ("period",))
    return g.select(
        F.col("day").cast("string").alias("day"), "period",
        F.array_join(F.transform("items", lambda i: i["id"].cast("string")), ",").alias("ids"),
        F.round("mean_cloud", 3).alias("mean_cloud"), "max_cloud", "complete",
    )


@query("nearest_radar", """
SELECT CAST(day AS VARCHAR) AS day, radar_id, epoch_us(radar_at) AS radar_us, orbit_rank, gap_hours FROM radar_match""")
def nearest_radar(spark, d):
    return sc.nearest_radar(optical(spark, d), radar(spark, d), SEARCH, SEARCH.max_gap_hours).select(
        F.col("day").cast("string").alias("day"), "radar_id",
        F.unix_micros(F.col("radar_at").cast("timestamp")).alias("radar_us"), "orbit_rank", "gap_hours")


@query("training_pairs", """
SELECT 'training_' || period || '_' || strftime(day, '%Y%m%d') || '_' || strftime(radar_at, '%Y%m%d') AS tag,
       period, pair_seq, cloud_tier, cloud_limit, ids AS scene_ids, radar_id, gap_hours, round(mean_cloud, 3) AS mean_cloud,
       CASE WHEN period IN (1, 2) THEN 'train' WHEN period = 3 THEN 'validation' WHEN period = 4 THEN 'test' ELSE 'unused' END AS split
FROM scene_pairs""")
def training_pairs(spark, d):
    return pairs(spark, d).select(
        sc.pair_tag("training", F.col("period"), F.col("day"), F.col("radar_at")).alias("tag"),
        "period", F.col("pair_seq"), "cloud_tier", "cloud_limit",
        F.array_join(F.transform("items", lambda i: i["id"].cast("string")), ",").alias("scene_ids"),
        "radar_id", "gap_hours", F.round("mean_cloud", 3).alias("mean_cloud"),
        sc.split_for(F.col("period"), TRAIN, VALIDATION, TEST).alias("split"),
    )


@query("period_status", """
WITH w AS (SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, false), (5, false), (6, false)) t(period, required)),
f AS (SELECT period, count(*) AS n, bool_or(cloud_tier = 'preferred') AS strict FROM scene_pairs GROUP BY period),
a AS (SELECT period, least(count(*), 4) AS n FROM groups_strict WHERE tiles = 2 GROUP BY period),
b AS (SELECT period, least(count(*), 4) AS n FROM groups_loose WHERE tiles = 2 GROUP BY period)
SELECT w.period, required, CASE WHEN coalesce(strict, false) THEN 'preferred' ELSE 'fallback' END AS cloud_tier,
       CASE WHEN coalesce(strict, false) THEN 12e0 ELSE 60e0 END AS cloud_limit,
       coalesce(CASE WHEN coalesce(strict, false) THEN a.n ELSE b.n END, 0) AS candidate_groups,
       coalesce(f.n, 0) AS matched_pairs,
       CASE WHEN coalesce(f.n, 0) > 0 THEN 'ok' WHEN required THEN 'missing_required' ELSE 'optional_missing' END AS status
FROM w LEFT JOIN f USING (period) LEFT JOIN a USING (period) LEFT JOIN b USING (period)""")
def period_status(spark, d):
    best, per_day = reduced(spark, d)
    return sc.period_status(best, sc.two_tier_pairs(best, per_day, SEARCH), SEARCH, REQUIRED, OPTIONAL)


view("requested", "SELECT doc_id AS position, doc_id * 11 AS id FROM documents")


def requested(spark, d):
    return obs.table(spark, d, "documents").select(F.col("doc_id").alias("position"), (F.col("doc_id") * 11).alias("id"))


@query("ordered_scene_lookup", """
SELECT position, r.id AS id, collection, tile, collection IS NOT NULL AS found FROM requested r LEFT JOIN scene_rows s ON r.id = s.id""")
def ordered_scene_lookup(spark, d):
    return sc.ordered_lookup(requested(spark, d), obs.scenes(spark, d))


@query("missing_scene_ids", "SELECT id, position FROM requested WHERE id NOT IN (SELECT id FROM scene_rows)")
def missing_scene_ids(spark, d):
    return sc.missing_ids(requested(spark, d), obs.scenes(spark, d))


@query("selected_scenes", "SELECT id, tile FROM scene_rows WHERE id IN (SELECT id FROM requested)")
def selected_scenes(spark, d):
    return sc.selected_scenes(requested(spark, d), obs.scenes(spark, d)).select("id", "tile")


view("pair_scenes", """
SELECT t.day, t.id, true AS optical FROM tile_best t JOIN (SELECT day FROM groups_all WHERE tiles = 2) g ON t.day = g.day
UNION ALL SELECT day, radar_id, false FROM radar_match WHERE day IN (SELECT day FROM groups_all WHERE tiles = 2)""")
view("readiness", """
SELECT p.day AS day, count(*) AS scene_count,
  coalesce(string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id) FILTER (c.id IS NULL), '') AS missing_scenes,
  coalesce(string_agg(p.id || ':nir', ',' ORDER BY p.id || ':nir') FILTER (c.id IS NOT NULL AND p.optical AND NOT c.has_nir), '') AS missing_assets,
  count(*) FILTER (c.id IS NULL) = 0 AND count(*) FILTER (c.id IS NOT NULL AND p.optical AND NOT c.has_nir) = 0 AS ready
FROM pair_scenes p LEFT JOIN scene_rows c ON p.id = c.id GROUP BY p.day""")


def readiness(spark, d):
    g = sc.optical_groups(optical(spark, d), SEARCH.required_tiles).where("complete")
    ids = g.select(F.col("day").alias("pair"), F.explode(F.transform("items", lambda i: i["id"])).alias("id"), F.lit(True).alias("optical"))
    r = sc.nearest_radar(g, radar(spark, d), SEARCH, SEARCH.max_gap_hours).select(F.col("day").alias("pair"), F.col("radar_id").alias("id"), F.lit(False).alias("optical"))
    return sc.pair_readiness(ids.unionByName(r), obs.scenes(spark, d), ("red", "nir"))


@query("pair_readiness", "SELECT CAST(day AS VARCHAR) AS day, scene_count, missing_scenes, missing_assets, ready FROM readiness")
def pair_readiness(spark, d):
    return readiness(spark, d).select(
        F.col("pair").cast("string").alias("day"), "scene_count",
        F.array_join(F.transform("missing_scenes", lambda i: i.cast("string")), ",").alias("missing_scenes"),
        F.array_join("missing_assets", ",").alias("missing_assets"), "ready",
    )


@query("stack_manifest", """
SELECT count(*) AS pair_count, count(*) FILTER (ready) AS ready_count,
       count(*) FILTER (period IN (1, 2)) AS train_count, count(*) FILTER (period = 3) AS validation_count,
       count(*) FILTER (period NOT IN (1, 2, 3)) AS test_count,
       CASE WHEN count(*) > 0 AND count(*) = count(*) FILTER (ready) THEN 'ready' ELSE 'needs_attention' END AS status
FROM (SELECT r.*, weekofyear(r.day) AS period FROM readiness r)""")
def stack_manifest(spark, d):
    r = readiness(spark, d).withColumn("split", sc.split_for(F.weekofyear("pair"), TRAIN, VALIDATION, ()))
    n = F.count(F.lit(1))
    ready = F.count(F.when(F.col("ready"), 1))
    return r.agg(
        n.alias("pair_count"), ready.alias("ready_count"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train_count"),
        F.count(F.when(F.col("split") == "validation", 1)).alias("validation_count"),
        F.count(F.when(F.col("split") == "unused", 1)).alias("test_count"),
        F.when((n > 0) & (n == ready), "ready").otherwise("needs_attention").alias("status"),
    )


CANDIDATES = """SELECT CAST(day AS VARCHAR) AS day, round(mean_cloud, 3) AS mean_cloud, max_cloud
FROM groups_all WHERE tiles = 2 ORDER BY max_cloud, groups_all.mean_cloud, groups_all.day LIMIT {k}"""


@query("benchmark_candidates", CANDIDATES.format(k=12))
def benchmark_candidates(spark, d, k: int = 12):
    g = sc.optical_groups(optical(spark, d), SEARCH.required_tiles).where("complete")
    return g.orderBy("max_cloud", "mean_cloud", "day").limit(k).select(
        F.col("day").cast("string").alias("day"), F.round("mean_cloud", 3).alias("mean_cloud"), "max_cloud")


@query("best_candidate", CANDIDATES.format(k=1))
def best_candidate(spark, d):
    return benchmark_candidates(spark, d, 1)


@query("incomplete_dates", """
SELECT CAST(day AS VARCHAR) AS day, CASE WHEN has0 THEN 'T1' ELSE 'T0' END AS missing_tiles FROM (
  SELECT day, bool_or(tile = 'T0') AS has0, bool_or(tile = 'T1') AS has1 FROM scene_rows
  WHERE collection = 'optical' AND cloud_cover < 12 GROUP BY day)
WHERE NOT (has0 AND has1) ORDER BY day LIMIT 20""")
def incomplete_dates(spark, d):
    g = sc.optical_groups(optical(spark, d).where(F.col("cloud_cover") < SEARCH.preferred_cloud), SEARCH.required_tiles)
    return g.where(~F.col("complete")).orderBy("day").limit(20).select(
        F.col("day").cast("string").alias("day"), F.array_join("missing_tiles", ",").alias("missing_tiles"))


@query("tag_roundtrip", """
SELECT id, 'scene_' || strftime(day, '%Y%m%d') || '_' || tile AS tag, CAST(day AS VARCHAR) AS parsed_day, CAST(NULL AS VARCHAR) AS bad_day,
       replace('scene_' || tile, '_', ' ') AS label, split_part(printf('r%03d_c%03d_%05d', x0, id % 997, id), '_', 3) AS block_seq
FROM scene_rows""")
def tag_roundtrip(spark, d):
    s = obs.scenes(spark, d).withColumn(
        "tag", F.concat_ws("_", F.lit("scene"), F.date_format("day", "yyyyMMdd"), "tile"))
    block = F.format_string("r%03d_c%03d_%05d", F.col("x0"), F.col("id") % 997, F.col("id"))
    return s.select(
        "id", "tag", sc.tag_day(F.col("tag"), 1).cast("string").alias("parsed_day"),
        sc.tag_day(F.col("tag"), 2).cast("string").alias("bad_day"),
        F.replace(F.concat(F.lit("scene_"), F.col("tile")), F.lit("_"), F.lit(" ")).alias("label"),
        F.regexp_extract(block, r"_(\d+)$", 1).alias("block_seq"),
    )
