"""Audits, gates and report tables; every report is a small DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from landshift.config import GATE, PublishGate
from landshift.functions.model import fraction, risk_level


def report_values(report: DataFrame, name: str) -> DataFrame:
    """A one-row report as (report, metric, value) rows."""
    cols = [c for c, t in report.dtypes if t in ("int", "bigint", "double", "float")]
    return report.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "metric", "value").select(
        F.lit(name).alias("report"), "metric", "value")


def reports_with_defaults(wanted: DataFrame, reports: DataFrame, default: float) -> DataFrame:
    """Wanted (report, metric) rows; a missing one gets the default and a missing status."""
    return wanted.join(reports, ["report", "metric"], "left").select(
        "report", "metric", F.coalesce("value", F.lit(default)).alias("value"),
        F.when(F.col("value").isNull(), "missing").otherwise("ok").alias("status"))


def struct_of(one_row: DataFrame) -> Column:
    """A one-row report as a scalar struct, so reports combine without joins."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


def publish_gate(coregistration: DataFrame, consensus: DataFrame, reliability: DataFrame, g: PublishGate = GATE) -> DataFrame:
    """publish, review or hold from registration, temporal and reliability evidence."""
    one = consensus.sparkSession.range(1)
    base = one.select(struct_of(coregistration).alias("c"), struct_of(reliability).alias("r"), struct_of(consensus).alias("t"))
    base = base.select("c", "r", F.col("t").isNull().alias("absent"), "t.mean_consensus", "t.unstable_fraction")
    temporal = (
        F.when(F.col("absent"), "missing").when(F.col("mean_consensus").isNull() | F.col("unstable_fraction").isNull(), "incomplete")
        .when((F.col("mean_consensus") < g.min_consensus) | (F.col("unstable_fraction") > g.max_instability), "warning")
        .otherwise("passed")
    )
    rel_ok = (
        (F.col("r.mean_confidence") >= g.min_confidence) & (F.col("r.mean_compatible_fraction") >= g.min_compatibility)
        & (F.col("r.mean_review_fraction") <= g.max_review)
    )
    out = base.select(
        F.coalesce("c.status", F.lit("missing")).alias("coregistration_status"), temporal.alias("temporal_status"),
        F.when(F.coalesce(rel_ok, F.lit(False)), "passed").otherwise("warning").alias("reliability_status"),
        "mean_consensus", "unstable_fraction",
    )
    allowed = F.col("coregistration_status").isin("passed", "warning")
    return out.withColumn(
        "recommendation",
        F.when(~allowed | (F.col("temporal_status") == "missing"), g.hold_label)
        .when((F.col("temporal_status") == "passed") & (F.col("reliability_status") == "passed"), g.publish_label)
        .otherwise(g.review_label),
    )


def uncertainty_drivers(records: DataFrame, frozen: Column, consensus: DataFrame, calibration: DataFrame,
                        terrain: DataFrame, classes: DataFrame, rare: Sequence[int], refined: DataFrame) -> DataFrame:
    """Gaps between validation scenes and the frozen scene plus stability, calibration and balance.

    `classes` are input counts before balancing; `refined` is the summary of refined labels per scene.
    """
    def mean(c: str, side: Column) -> Column:
        units = F.sum(F.when(side, F.round(F.col(c) * 1e6).cast("bigint")))
        return units / (F.nullif(F.count(F.when(side, F.col(c))), F.lit(0)) * 1e6)

    def total(c: str) -> Column:
        return F.sum(F.when(frozen, F.col(c)))

    strict = refined.where(~frozen).agg(fraction(F.coalesce(F.sum("strict_pixels"), F.lit(0)), F.sum("valid_pixels"))).scalar()
    share = classes.agg(fraction(
        F.coalesce(F.sum(F.when(F.col("class_id").isin(*rare), F.col("pixels"))), F.lit(0)), F.sum("pixels"))).scalar()
    valid = total("valid_pixels")
    return records.agg(
        (mean("mean_confidence", ~frozen) - mean("mean_confidence", frozen)).alias("confidence_gap"),
        (mean("mean_entropy", frozen) - mean("mean_entropy", ~frozen)).alias("entropy_gap"),
        (mean("review_fraction", frozen) - mean("review_fraction", ~frozen)).alias("review_gap"),
        (mean("compatible_fraction", ~frozen) - mean("compatible_fraction", frozen)).alias("compatibility_gap"),
        fraction(total("low_confidence_pixels"), valid).alias("low_confidence_fraction"),
        fraction(total("high_entropy_pixels"), valid).alias("high_entropy_fraction"),
        fraction(total("disagreement_pixels"), valid).alias("disagreement_fraction"),
        fraction(total("agreement_zone_pixels"), valid).alias("agreement_zone_fraction"),
    ).withColumns({
        "strict_pseudo_label_fraction": strict,
        "_c": struct_of(consensus), "_k": struct_of(calibration), "_t": struct_of(terrain), "rare_class_fraction": share,
    }).select(*[F.round(c, 5).alias(n) for n, c in {
        "confidence_gap": F.col("confidence_gap"), "entropy_gap": F.col("entropy_gap"), "review_gap": F.col("review_gap"),
        "compatibility_gap": F.col("compatibility_gap"), "low_confidence_fraction": F.col("low_confidence_fraction"),
        "high_entropy_fraction": F.col("high_entropy_fraction"), "disagreement_fraction": F.col("disagreement_fraction"),
        "agreement_zone_fraction": F.col("agreement_zone_fraction"), "strict_pseudo_label_fraction": F.col("strict_pseudo_label_fraction"),
        "mean_consensus": F.col("_c.mean_consensus"), "unstable_fraction": F.col("_c.unstable_fraction"),
        "calibration_gap": F.col("_k.mean_abs_gap"), "slope_p95": F.col("_t.slope_p95"), "rare_class_fraction": F.col("rare_class_fraction"),
    }.items()])


# fixed values: (low, high, larger is safer) limits per risk driver
RISK_LIMITS = {
    "confidence_gap": (0.15, 0.3, False),
    "high_entropy_fraction": (0.25, 0.55, False),
    "disagreement_fraction": (0.2, 0.45, False),
    "calibration_gap": (0.15, 0.3, False),
    "rare_class_fraction": (0.02, 0.08, True),
    "slope_p95": (15.0, 25.0, False),
}


def risk_report(drivers: DataFrame) -> DataFrame:
    rows = drivers.select(*[F.col(c).cast("double").alias(c) for c in RISK_LIMITS]).unpivot([], list(RISK_LIMITS), "driver", "value")
    level = F.lit(None).cast("string")
    for name, (low, high, inverse) in RISK_LIMITS.items():
        level = F.when(F.col("driver") == name, risk_level(F.col("value"), low, high, inverse)).otherwise(level)
    return rows.withColumn("risk_level", level)


def asset_inventory(assets: DataFrame, max_bytes: int, allowed: Sequence[str]) -> DataFrame:
    return assets.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("total_bytes"),
        F.count(F.when(F.col("length") > max_bytes, 1)).alias("oversized_count"),
    ).withColumn("allowed", F.col("suffix").isin(*allowed))


def scan_assets(spark, root: str) -> DataFrame:
    """Files below a folder; only path and length are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))


def output_completeness(required: DataFrame, available: DataFrame) -> DataFrame:
    """Required names against what exists, with mismatch counts of the existing ones."""
    have = available.groupBy("family").agg(
        F.count(F.lit(1)).alias("rasters"), F.count(F.when(F.size("mismatches") > 0, 1)).alias("mismatched"))
    return required.join(have, "family", "left").select(
        "family", F.coalesce("rasters", F.lit(0)).alias("rasters"), F.coalesce("mismatched", F.lit(0)).alias("mismatched"),
        F.when(F.col("rasters").isNull(), "missing").when(F.col("mismatched") > 0, "needs_attention").otherwise("ok").alias("status"))


def readiness_counts(patches: DataFrame, pairs: DataFrame) -> DataFrame:
    p = patches.agg(F.count(F.when(F.col("split") == "test", 1)).alias("test_patches"), F.count(F.lit(1)).alias("patches"))
    q = pairs.agg(F.count(F.when(F.col("split") == "test", 1))).scalar()
    return p.withColumn("test_pairs", q).withColumn(
        "status", F.when((F.col("test_patches") > 0) & (F.col("test_pairs") > 0), "ready").otherwise("not_ready"))


def benchmark_package(best: DataFrame, features: DataFrame, required: Sequence[str], leaks: Column, misaligned: Column, strict: Column) -> DataFrame:
    """Best candidate with its blockers; an empty list means the package is ready."""
    have = features.agg(F.collect_set("feature")).scalar()
    out = best.withColumn("_missing", F.array_except(F.array(*[F.lit(f) for f in required]), have))
    blockers = F.array_compact(F.array(
        F.when(leaks > 0, "leakage"), F.when(misaligned > 0, "weak_sources"),
        F.when(F.size("_missing") > 0, "features"), F.when(strict == 0, "relaxed_cloud"),
    ))
    return out.withColumns({"missing_features": F.array_join("_missing", ","), "blockers": F.array_join(blockers, ",")}).withColumn(
        "status", F.when(F.col("blockers") == "", "ready").otherwise("blocked")).drop("_missing")
