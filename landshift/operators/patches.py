"""Patch windows, acceptance, sequence numbers, splits, balancing and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from landshift.config import FROZEN_YEAR, PatchPolicy
from landshift.functions import model as md
from landshift.functions.bands import all_valid
from landshift.functions.labels import harmonized_to_model
from landshift.operators.ranking import hash_unit, row_numbers


def patch_windows(grids: DataFrame, size: int, stride: int) -> DataFrame:
    """Full windows only: one row per (grid, row, col)."""

    def starts(extent: str) -> Column:
        return F.when(F.col(extent) >= size, F.sequence(F.lit(0), (F.col(extent) - size).cast("int"), F.lit(stride)))

    return grids.withColumn("row", F.explode(starts("height"))).withColumn("col", F.explode(starts("width")))


def coverage_windows(grids: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows that cover the whole grid: the last row and column sit flush with the edge."""

    def starts(extent: str) -> Column:
        last = F.greatest(F.col(extent) - size, F.lit(0)).cast("int")
        return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))

    return grids.withColumn("row", F.explode(starts("height"))).withColumn("col", F.explode(starts("width")))


def training_mask(pixels: DataFrame, features: Sequence[str], min_confidence: float = 0.65) -> DataFrame:
    """Label confidence from the source count and the single-date training mask."""
    conf = F.least(F.col("source_count") / 3.0, F.lit(1.0))
    return pixels.withColumns({
        "valid": all_valid(*[F.col(f) for f in features]),
        "label_confidence": conf,
    }).withColumn(
        "trainable",
        (F.col("agreement") > 0) & ~F.col("disagreement") & F.col("valid") & (F.col("label_confidence") >= min_confidence),
    )


def patch_statistics(masked: DataFrame, policy: PatchPolicy, height: Column, width: Column) -> DataFrame:
    """One row per full patch; edge remainders are dropped."""
    s = policy.size
    area = float(s * s)
    full = masked.where((F.col("y") < F.floor(height / s) * s) & (F.col("x") < F.floor(width / s) * s))

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    label = harmonized_to_model(F.col("agreement"))
    return full.withColumn("_label", label).groupBy(
        "scene", F.floor(F.col("y") / s).alias("prow"), F.floor(F.col("x") / s).alias("pcol")
    ).agg(
        F.round(n(F.col("agreement") > 0) / area, 6).alias("agreement_fraction"),
        F.round(n(F.col("valid")) / area, 6).alias("valid_fraction"),
        n(F.col("trainable")).alias("training_pixels"),
        n(F.col("disagreement")).alias("disagreement_pixels"),
        *[n(F.col("_label") == k).alias(f"class_{k}") for k in range(1, 6)],
    ).withColumn(
        "accepted",
        (F.col("agreement_fraction") >= policy.min_agreement_fraction)
        & (F.col("valid_fraction") >= policy.min_valid_fraction)
        & (F.col("training_pixels") >= policy.min_training_pixels),
    )


def split_for_sequence(seq: Column, policy: PatchPolicy) -> Column:
    r = seq % 10
    return (
        F.when(r.isin(*policy.train_remainders), "train")
        .when(r.isin(*policy.validation_remainders), "validation").otherwise("test")
    )


def sequenced_patches(stats: DataFrame, policy: PatchPolicy) -> DataFrame:
    """Accepted patches numbered in scan order per scene; the number decides block id and split."""
    out = row_numbers(stats.where("accepted"), ["scene"], ["prow", "pcol"], "_rn").withColumn("seq", F.col("_rn") - 1).drop("_rn")
    if policy.max_patches is not None:
        out = out.where(F.col("seq") < policy.max_patches)
    out = out.withColumn("block_id", F.format_string("s%d_r%03d_c%03d_%05d", "scene", "prow", "pcol", "seq"))
    tail = F.regexp_extract("block_id", r"_(\d+)$", 1).cast("bigint")
    return out.withColumn("split", split_for_sequence(tail, policy))


def balance(patches: DataFrame, policy: PatchPolicy, minority: Sequence[int]) -> DataFrame:
    """Keep every train patch with a minority class; cap majority-only train patches per
    scene at max(limit, multiplier x minority count); leave other splits alone."""
    has = F.lit(False)
    for k in minority:
        has = has | (F.col(f"class_{k}") > 0)
    train = F.col("split") == "train"
    base = patches.withColumn("_major", train & ~has)
    allowed = base.where(train & has).groupBy("scene").agg(F.count(F.lit(1)).alias("_m"))
    ranked = row_numbers(base.where("_major"), ["scene"], [F.col("training_pixels").desc(), "block_id"], "_rank")
    limit = F.greatest(F.lit(policy.balance_limit), F.bround(F.coalesce("_m", F.lit(0)) * F.lit(policy.balance_multiplier)))
    kept = ranked.join(allowed, "scene", "left").where(F.col("_rank") <= limit).drop("_rank", "_m")
    return base.where(~F.col("_major")).unionByName(kept).drop("_major")


def class_totals(patches: DataFrame) -> DataFrame:
    """Histograms of many patches merged into (class_id, pixels)."""
    sums = patches.agg(*[F.coalesce(F.sum(f"class_{k}"), F.lit(0)).alias(str(k)) for k in range(1, 6)])
    return sums.unpivot([], [str(k) for k in range(1, 6)], "class_id", "pixels").select(
        F.col("class_id").cast("int").alias("class_id"), "pixels")


def split_counts(patches: DataFrame) -> DataFrame:
    """Counts of the three splits, zero when absent."""
    return patches.agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "validation", "test")]
    )


def class_weights(totals: DataFrame, beta: float, cap: float | None, overrides: dict[int, float]) -> DataFrame:
    """Effective-number weights, normalised by the mean of active classes, capped, raised by overrides."""
    raw = totals.withColumn("_w", md.effective_number_weight(F.col("pixels"), beta))
    mean = raw.where("_w > 0").agg(F.avg("_w")).scalar()
    w = F.when(F.col("_w") > 0, F.round(F.col("_w") / mean, 6)).otherwise(0.0)
    if cap is not None:
        w = F.least(w, F.lit(cap))
    for k, v in overrides.items():
        w = F.when(F.col("class_id") == k, F.greatest(w, F.lit(v))).otherwise(w)
    return raw.select("class_id", "pixels", w.alias("weight"))


def sampling_weights(patches: DataFrame, weights: DataFrame, boost: float, minimum: float = 1.0) -> DataFrame:
    """Patches holding rare classes weigh more; the weight table has one row per class."""
    lookup = weights.agg(F.map_from_entries(F.collect_list(F.struct("class_id", "weight")))).scalar()
    present = F.filter(
        F.array(*[F.when(F.col(f"class_{k}") > 0, F.try_element_at(F.col("_w"), F.lit(k))) for k in range(1, 6)]),
        lambda w: w > 0,
    )
    return patches.withColumn("_w", lookup).withColumn("_p", present).withColumn(
        "sampling_weight",
        F.when(F.size("_p") > 0, F.greatest(F.lit(minimum), 1.0 + boost * F.array_max("_p"))).otherwise(F.lit(1.0)),
    ).drop("_w", "_p")


def oversample(patches: DataFrame, key: str, weight: str, factor: float, seed: int) -> DataFrame:
    """Sampling with replacement: n = round(factor x N) draws in expectation, as copies per row.

    A row's expected share is split into its whole part and a reproducible
    coin for the rest, so no row ever has to meet another.
    """
    micro = F.round(F.col(weight) * 1e6).cast("bigint")
    totals = patches.agg(F.struct(F.sum(micro).alias("w"), F.count(F.lit(1)).alias("n")).alias("t")).scalar()
    out = patches.withColumn("_t", totals)
    share = F.round(F.bround(F.col("_t.n") * F.lit(factor)) * micro / F.col("_t.w"), 9)
    coin = F.when(hash_unit(F.col(key), seed) < share - F.floor(share), 1).otherwise(0)
    return out.withColumn("copies", (F.floor(share) + coin).cast("int")).drop("_t")


def materialise_copies(weighted: DataFrame) -> DataFrame:
    return weighted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).where("copies > 0")


def window_coverage(patches: DataFrame) -> DataFrame:
    """Distinct dates per spatial window and whether any window repeats."""
    per = patches.groupBy("prow", "pcol").agg(F.countDistinct("scene").alias("dates"))
    multi = F.count(F.when(F.col("dates") > 1, 1))
    return per.agg(
        F.count(F.lit(1)).alias("window_count"), multi.alias("multi_date_windows"),
        F.when(multi > 0, "ready_for_temporal_transformer")
        .otherwise("insufficient_exact_repeated_windows_for_temporal_transformer").alias("status"),
    )


def leakage_findings(records: DataFrame, tag: str) -> DataFrame:
    """Frozen years outside the test split, and tags that sit in several splits."""
    frozen = records.where((F.col("year") >= FROZEN_YEAR) & (F.col("split") != "test")).select(
        F.lit("frozen_year_outside_test").alias("finding"), F.col("patch_id").cast("string").alias("subject"),
        F.col("split").alias("detail"),
    )
    multi = records.groupBy(tag).agg(F.collect_set("split").alias("s")).where(F.size("s") > 1).select(
        F.lit("tag_in_several_splits").alias("finding"), F.col(tag).cast("string").alias("subject"),
        F.array_join(F.sort_array("s"), ",").alias("detail"),
    )
    return frozen.unionByName(multi)


def leakage_status(findings: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return findings.agg(n.alias("violation_count"), F.when(n == 0, "pass").otherwise("fail").alias("status"))


def preflight(patches: DataFrame, channels: int, expected_channels: int, min_pixels: int) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    pixels = F.coalesce(F.sum("training_pixels"), F.lit(0))
    train, val = n(F.col("split") == "train"), n(F.col("split") == "validation")
    ok = (F.lit(channels) == expected_channels) & (train > 0) & (val > 0) & (pixels >= min_pixels)
    return patches.agg(
        F.count(F.lit(1)).alias("patch_count"), train.alias("train_count"), val.alias("validation_count"),
        pixels.alias("training_pixels"), F.lit(channels == expected_channels).alias("has_required_channels"),
        ((train > 0) & (val > 0)).alias("has_train_and_validation"), (pixels >= min_pixels).alias("has_enough_pixels"),
        F.when(ok, "ready").otherwise("blocked").alias("status"),
    )


def patch_payload(pixels: DataFrame, channels: Sequence[str], size: int) -> DataFrame:
    """One row per patch with an ordered value array per channel; a patch is size x size at most."""
    pos = (F.col("y") % size) * size + F.col("x") % size
    return pixels.groupBy(
        "scene", F.floor(F.col("y") / size).alias("prow"), F.floor(F.col("x") / size).alias("pcol")
    ).agg(F.sort_array(F.collect_list(F.struct(pos.alias("pos"), *channels))).alias("_p")).select(
        "scene", "prow", "pcol", F.col("_p.pos").alias("pos"), *[F.col(f"_p.{c}").alias(c) for c in channels]
    )
