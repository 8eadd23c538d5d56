"""Dashboard roll-ups over published change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landshift.config import AOI_AREA_KM2
from landshift.functions.change import transition_label


def exact_mean(value: Column, scale: int = 1000) -> Column:
    """Mean through integer units, so the result does not depend on row order."""
    units = F.round(value * scale).cast("bigint")
    return F.sum(units) / (F.count(value) * F.lit(float(scale)))


def known(key: Column) -> Column:
    return F.when(key.isNull() | (key == ""), "unknown").otherwise(key)


def scored_summary(scored: DataFrame) -> DataFrame:
    """Counts overall, by reliability and by monitored group in one pass."""
    sets = scored.groupingSets(
        [[], [F.col("reliability")], [F.col("monitored_land_cover")]],
        F.col("reliability"), F.col("monitored_land_cover"),
    ).agg(
        F.grouping("reliability").alias("g1"), F.grouping("monitored_land_cover").alias("g2"),
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("publish_ready"), 1)).alias("publish_ready_count"),
    )
    return sets.select(
        F.when(F.col("g1") == 0, "reliability").when(F.col("g2") == 0, "monitored_land_cover").otherwise("all").alias("dimension"),
        F.when(F.col("g1") == 0, F.col("reliability")).when(F.col("g2") == 0, F.col("monitored_land_cover"))
        .otherwise("all").alias("key"),
        "total", "publish_ready_count",
    )


def dashboard(published: DataFrame, aoi_km2: float = AOI_AREA_KM2) -> DataFrame:
    """One row, also for an empty input: changed area plus its complement."""
    aoi = aoi_km2 * 1e6
    a = published.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(exact_mean(F.col("confidence")), 6).alias("mean_confidence"),
        F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("changed_area_m2"),
    )
    rest = F.greatest(F.lit(aoi) - F.col("changed_area_m2"), F.lit(0.0))
    return a.select(
        "total", "mean_confidence", F.lit(aoi).alias("aoi_area_m2"), "changed_area_m2",
        rest.alias("no_change_area_m2"),
        F.round(F.col("changed_area_m2") / aoi * 100, 6).alias("changed_percent"),
        F.round(rest / aoi * 100, 6).alias("no_change_percent"),
    )


def grouped_rollup(published: DataFrame) -> DataFrame:
    """Count and area by monitored group and by reliability, one scan."""
    keyed = published.select(
        known(F.col("monitored_land_cover")).alias("land_cover"), known(F.col("reliability")).alias("rel"), "area_m2"
    )
    return keyed.groupingSets([[F.col("land_cover")], [F.col("rel")]], F.col("land_cover"), F.col("rel")).agg(
        F.grouping("rel").alias("g"),
        F.count(F.lit(1)).alias("change_count"),
        F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("area_m2"),
    ).select(
        F.when(F.col("g") == 1, "monitored_land_cover").otherwise("reliability").alias("dimension"),
        F.coalesce("land_cover", "rel").alias("key"), "change_count", "area_m2",
    )


def transition_areas(published: DataFrame) -> DataFrame:
    return published.withColumn(
        "transition",
        transition_label(F.coalesce("before_state", F.lit("unknown")), F.coalesce("after_state", F.lit("unknown"))),
    ).groupBy("transition").agg(F.sum("area_m2").alias("area_m2"))


def top_transition(published: DataFrame) -> DataFrame:
    return transition_areas(published).orderBy(F.col("area_m2").desc(), "transition").limit(1)


def map_query(published: DataFrame, min_confidence: float = 0.75, group: str = "all", limit: int = 1000) -> DataFrame:
    out = published.where(F.col("confidence") >= min_confidence)
    if group != "all":
        out = out.where(F.col("monitored_land_cover") == group)
    return out.orderBy(F.col("confidence").desc(), F.col("area_m2").desc(), "id").limit(limit)


def latest_changes(published: DataFrame, limit: int = 500) -> DataFrame:
    if not 1 <= limit <= 5000:
        raise ValueError("limit must lie in 1..5000")
    return published.orderBy(F.col("after_date").desc(), "id").limit(limit)


def visible_rollup(filtered: DataFrame, aoi_km2: float = AOI_AREA_KM2) -> DataFrame:
    """Numbers a filtered map view shows."""
    area = F.coalesce(F.sum("area_m2"), F.lit(0.0))
    return filtered.agg(
        F.count(F.lit(1)).alias("visible_count"),
        area.alias("visible_changed_area_m2"),
        F.greatest(F.lit(aoi_km2 * 1e6) - area, F.lit(0.0)).alias("visible_no_change_area_m2"),
        F.coalesce(F.sum(F.when(F.col("reliability") == "high", F.col("area_m2"))), F.lit(0.0)).alias("reliable_area_m2"),
        F.count(F.when(F.col("reliability") != "high", 1)).alias("needs_review_count"),
    )


def residual_properties(rows: DataFrame, core: tuple[str, ...]) -> Column:
    """Everything outside the core columns as one JSON document."""
    rest = [c for c in rows.columns if c not in core]
    fields = [
        F.col(c).cast("string").alias(c) if dict(rows.dtypes)[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c)
        for c in rest
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def constraint_audit(rows: DataFrame) -> DataFrame:
    """Violations of the change-table constraints."""

    def bad(cond: Column, name: str) -> Column:
        return F.count(F.when(~F.coalesce(cond, F.lit(False)), 1)).alias(name)

    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        bad(F.col("id").isNotNull() & F.col("change_type").isNotNull(), "missing_key"),
        bad(F.col("confidence").between(0.0, 1.0), "confidence_out_of_range"),
        bad(F.col("area_m2") >= 0, "negative_area"),
        bad(F.col("after_state").isNotNull(), "missing_after_state"),
        bad(F.col("after_date") > F.col("before_date"), "date_order"),
    )
