"""Scene catalogue: search, cleanest item per tile, nearest radar, pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.config import SceneSearch

FOOTPRINT = 10.0  # side of a footprint in box units
MISSING_CLOUD = 100.0  # fixed value: cloud cover assumed when the item has none

ITEM_SCHEMA = (
    "id bigint, collection string, assets map<string, struct<href: string>>,"
    " properties struct<datetime: timestamp_ntz, `eo:cloud_cover`: double, `s2:mgrs_tile`: string>"
)


def flatten_items(raw: DataFrame, column: str = "item") -> DataFrame:
    """Nested catalogue items (JSON text) to flat scene rows; the raw properties stay as text."""
    parsed = raw.select(F.from_json(column, ITEM_SCHEMA).alias("i"), F.col(column).alias("_raw"))
    return parsed.select(
        F.col("i.id").alias("id"),
        F.col("i.collection").alias("collection"),
        F.col("i.properties.datetime").alias("acquired_at"),
        F.col("i.properties.`eo:cloud_cover`").alias("cloud_cover"),
        F.col("i.properties.`s2:mgrs_tile`").alias("tile"),
        F.transform_values("i.assets", lambda _, v: v["href"]).alias("assets"),
        F.get_json_object("_raw", "$.properties").alias("properties"),
    )


def search(scenes: DataFrame, collection: str, box: tuple[float, float, float, float], start: str, end: str,
           max_cloud: float | None = None) -> DataFrame:
    """Footprints touching the box (x and y from, x and y to), dates inclusive, cloud strictly below the limit."""
    out = scenes.where(
        (F.col("collection") == collection)
        & (F.col("x0") <= box[2]) & (F.col("x0") + FOOTPRINT >= box[0])
        & (F.col("y0") <= box[3]) & (F.col("y0") + FOOTPRINT >= box[1])
        & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    return out if max_cloud is None else out.where(F.col("cloud_cover") < max_cloud)


def best_per_tile(optical: DataFrame, keys: Sequence[str] = ("day", "tile")) -> DataFrame:
    """Cleanest item of a tile on a date; combines before the shuffle."""
    best = F.min(F.struct(F.coalesce("cloud_cover", F.lit(MISSING_CLOUD)).alias("cloud"), F.col("id")))
    return optical.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.cloud").alias("cloud"), F.col("_b.id").alias("id")
    )


def optical_groups(optical: DataFrame, required: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per date with its tiles, cloud statistics and missing required tiles."""
    return tile_groups(best_per_tile(optical.where(F.col("tile").isin(*required)), (*extra, "day", "tile")), required, extra)


def tile_groups(best: DataFrame, required: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """`optical_groups` from the cleanest item of each tile and date.

    An item that is cleanest of all is also the cleanest below any limit it meets,
    so one table of them serves every cloud limit.
    """
    need = F.array(*[F.lit(t) for t in sorted(required)])
    return (
        best.groupBy(*extra, "day")
        .agg(
            F.sort_array(F.collect_list(F.struct("tile", "id", "cloud"))).alias("items"),
            (F.sum(F.round(F.col("cloud") * 100).cast("bigint")) / (F.count(F.lit(1)) * 100.0)).alias("mean_cloud"),
            F.max("cloud").alias("max_cloud"),
        )
        .withColumn("missing_tiles", F.array_except(need, F.transform("items", lambda i: i["tile"])))
        .withColumn("complete", F.size("missing_tiles") == 0)
    )


def nearest_radar(days: DataFrame, radar: DataFrame, s: SceneSearch, max_gap_hours: float | None = None) -> DataFrame:
    """Best radar item per optical date: preferred orbit, then smallest gap to midnight UTC.

    Radar is first reduced to its earliest and latest item per day and orbit
    rank, which is all a date can ever pick, so the day join stays tiny even
    when one day holds most of the catalogue.
    """
    return match_radar(days, radar_by_day(radar, s), s, max_gap_hours)


def radar_by_day(radar: DataFrame, s: SceneSearch) -> DataFrame:
    """Earliest and latest usable item of each day and orbit rank."""
    usable = radar.where(F.array_contains("polarizations", "VV") & F.array_contains("polarizations", "VH"))
    return (
        usable.withColumn("penalty", F.when(F.col("orbit") == s.preferred_orbit, 0).otherwise(1))
        .groupBy(F.col("day").alias("radar_day"), "penalty")
        .agg(
            F.min(F.struct(F.col("acquired_at").alias("t"), F.col("id").alias("k"))).alias("first"),
            F.max(F.struct(F.col("acquired_at").alias("t"), (-F.col("id")).alias("k"))).alias("last"),
        )
    )


def match_radar(days: DataFrame, per_day: DataFrame, s: SceneSearch, max_gap_hours: float | None = None) -> DataFrame:
    """`nearest_radar` from the items that `radar_by_day` keeps."""
    offsets = F.sequence(F.lit(-s.radar_days), F.lit(s.radar_days))
    keyed = days.select("day").distinct().withColumn("offset", F.explode(offsets)).withColumn(
        "radar_day", F.date_add("day", F.col("offset"))
    )
    before = F.col("offset") < 0
    t = F.when(before, F.col("last.t")).otherwise(F.col("first.t"))
    micros = F.abs(
        F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.col("day").cast("timestamp_ntz").cast("timestamp"))
    )
    cand = keyed.join(per_day, "radar_day").select(
        "day",
        F.struct(
            F.col("penalty"), micros.alias("gap_micros"), F.abs("offset").alias("far"), F.col("offset"),
            F.when(before, -F.col("last.k")).otherwise(F.col("first.k")).alias("radar_id"),
            t.alias("radar_at"),
        ).alias("c"),
    )
    if max_gap_hours is not None:
        cand = cand.where(F.col("c.gap_micros") <= int(max_gap_hours * 3_600_000_000))
    return cand.groupBy("day").agg(F.min("c").alias("c")).select(
        "day", F.col("c.radar_id").alias("radar_id"), F.col("c.radar_at").alias("radar_at"),
        F.when(F.col("c.penalty") == 0, s.preferred_orbit).otherwise("other").alias("orbit_rank"),
        F.round(F.col("c.gap_micros") / 3.6e9, 1).alias("gap_hours"),
    )


def ranked_groups(groups: DataFrame, keep: int, key: str = "period") -> DataFrame:
    """First `keep` complete dates per period by (mean cloud, date)."""
    w = Window.partitionBy(key).orderBy("mean_cloud", "day")
    return groups.where("complete").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def split_for(period: Column, train: Sequence[int], validation: Sequence[int], test: Sequence[int]) -> Column:
    return (
        F.when(period.isin(*train), "train").when(period.isin(*validation), "validation")
        .when(period.isin(*test), "test").otherwise("unused")
    )


def cleanest_tiles(optical: DataFrame, s: SceneSearch) -> DataFrame:
    """Cleanest item per period, date and required tile, below the relaxed limit."""
    usable = optical.where(F.col("tile").isin(*s.required_tiles) & (F.col("cloud_cover") < s.fallback_cloud))
    return best_per_tile(usable, ("period", "day", "tile"))


def training_pairs(best: DataFrame, per_day: DataFrame, s: SceneSearch, cloud: float) -> DataFrame:
    """Matched optical/radar pairs of every period at one cloud limit, from the reduced tables of `two_tier_pairs`."""
    groups = ranked_groups(tile_groups(best.where(F.col("cloud") < cloud), s.required_tiles, ("period",)), s.max_groups)
    matched = groups.join(match_radar(groups, per_day, s, s.max_gap_hours), "day")
    w = Window.partitionBy("period").orderBy("rank")
    out = matched.withColumn("pair_seq", F.row_number().over(w)).where(F.col("pair_seq") <= s.max_pairs)
    return out.withColumn("cloud_limit", F.lit(float(cloud)))


def two_tier_pairs(best: DataFrame, per_day: DataFrame, s: SceneSearch) -> DataFrame:
    """Strict pairs; a period without any falls back to the relaxed limit.

    `best` (`cleanest_tiles`) and `per_day` (`radar_by_day`) have a row per date and tile
    or orbit; store them, as every tier reads them.
    """
    strict = training_pairs(best, per_day, s, s.preferred_cloud).withColumn("cloud_tier", F.lit("preferred"))
    relaxed = training_pairs(best, per_day, s, s.fallback_cloud).withColumn("cloud_tier", F.lit("fallback"))
    return strict.unionByName(relaxed.join(strict.select("period").distinct(), "period", "left_anti"))


def pair_tag(prefix: str, period: Column, optical_day: Column, radar_day: Column) -> Column:
    return F.concat_ws(
        "_", F.lit(prefix), period.cast("string"), F.date_format(optical_day, "yyyyMMdd"), F.date_format(radar_day, "yyyyMMdd")
    )


def tag_day(tag: Column, position: int) -> Column:
    """Date part of a tag, NULL when the part is not eight digits."""
    part = F.get(F.split(tag, "_"), position)
    return F.when(part.rlike("^[0-9]{8}$"), F.try_to_timestamp(part, F.lit("yyyyMMdd")).cast("date"))


def period_status(best: DataFrame, pairs: DataFrame, s: SceneSearch, required: Sequence[int], optional: Sequence[int]) -> DataFrame:
    """Per wanted period: tier used, candidate groups, pairs and status; absent periods stay visible."""
    spark = best.sparkSession
    wanted = spark.createDataFrame(
        [(p, True) for p in required] + [(p, False) for p in optional], "period int, required boolean"
    )

    def groups_at(limit: float, name: str) -> DataFrame:
        g = tile_groups(best.where(F.col("cloud") < limit), s.required_tiles, ("period",))
        return g.where("complete").groupBy("period").agg(F.least(F.count(F.lit(1)), F.lit(s.max_groups)).alias(name))

    found = pairs.groupBy("period").agg(
        F.count(F.lit(1)).alias("matched_pairs"), F.max(F.col("cloud_tier") == "preferred").alias("strict")
    )
    out = (
        wanted.join(found, "period", "left")
        .join(groups_at(s.preferred_cloud, "_p"), "period", "left")
        .join(groups_at(s.fallback_cloud, "_f"), "period", "left")
    )
    strict = F.coalesce(F.col("strict"), F.lit(False))
    n = F.coalesce("matched_pairs", F.lit(0))
    return out.select(
        "period", "required",
        F.when(strict, "preferred").otherwise("fallback").alias("cloud_tier"),
        F.when(strict, s.preferred_cloud).otherwise(s.fallback_cloud).alias("cloud_limit"),
        F.coalesce(F.when(strict, F.col("_p")).otherwise(F.col("_f")), F.lit(0)).alias("candidate_groups"),
        n.alias("matched_pairs"),
        F.when(n > 0, "ok").when(F.col("required"), "missing_required").otherwise("optional_missing").alias("status"),
    )


def ordered_lookup(requested: DataFrame, scenes: DataFrame) -> DataFrame:
    """Requested (position, id) in their order with a found flag; missing ids stay as rows."""
    hit = scenes.select(F.col("id"), "collection", "tile")
    return requested.join(hit, "id", "left").select(
        "position", "id", "collection", "tile", F.col("collection").isNotNull().alias("found")
    )


def missing_ids(requested: DataFrame, scenes: DataFrame) -> DataFrame:
    return requested.join(scenes.select("id"), "id", "left_anti")


def require_all(requested: DataFrame, scenes: DataFrame, shown: int = 20) -> DataFrame:
    """Found scenes in the order asked for; an error names the first missing ids, in that order."""
    absent = [r.id for r in missing_ids(requested, scenes).orderBy("position").limit(shown + 1).collect()]
    if absent:
        raise LookupError(f"scenes not in the catalogue: {', '.join(map(str, absent[:shown]))}{', ...' if len(absent) > shown else ''}")
    return ordered_lookup(requested, scenes).orderBy("position")


def selected_scenes(requested: DataFrame, scenes: DataFrame) -> DataFrame:
    return scenes.join(requested.select("id"), "id", "left_semi")


def pair_readiness(pair_scenes: DataFrame, catalogue: DataFrame, required_assets: Sequence[str]) -> DataFrame:
    """(pair, id, optical) rows against the catalogue: missing scenes, and missing assets of the optical ones, per pair."""
    need = F.array(*[F.lit(a) for a in required_assets])
    joined = pair_scenes.join(catalogue.select("id", "assets", F.lit(True).alias("_hit")), "id", "left")
    per = joined.groupBy("pair").agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.sort_array(F.collect_list(F.when(F.col("_hit").isNull(), F.col("id")))).alias("missing_scenes"),
        F.sort_array(F.flatten(F.collect_list(F.when(
            F.col("_hit") & F.col("optical"),
            F.transform(F.array_except(need, F.map_keys("assets")), lambda a: F.concat_ws(":", F.col("id").cast("string"), a)),
        )))).alias("missing_assets"),
    )
    return per.withColumn("ready", (F.size("missing_scenes") == 0) & (F.size("missing_assets") == 0))
