"""Independent weak sources: votes, consensus, reliability and pseudo-labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.config import REVIEW, ReviewThresholds
from landshift.functions import labels as lb, model as md

HARMONIZED = range(1, 7)
MODEL = range(1, 6)
LABEL_SPAN = 1 << 16  # labels are class codes below this; a larger one is an error


def majority_vote(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Row-local vote over source columns (0 = unlabeled); lowest class wins a tie."""
    counts = lb.vote_counts(F.array(*sources), HARMONIZED)
    top = F.array_max("_votes")
    total = F.aggregate("_votes", F.lit(0), lambda a, v: a + v)
    return (
        df.withColumn("_votes", counts)
        .withColumns({"source_count": total, "mode_count": top,
                      "mode_label": F.when(top > 0, lb.argmax_class(F.col("_votes"))).otherwise(0)})
        .withColumns({
            "agreement": F.when(F.col("mode_count") >= 2, F.col("mode_label")).otherwise(0),
            "disagreement": (F.col("source_count") >= 2) & (F.col("mode_count") < F.col("source_count")),
        })
        .drop("_votes")
    )


def _consensus_columns(count_of) -> dict[str, Column]:
    counts = F.array(*[count_of(k) for k in MODEL])
    valid = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return {
        "valid_count": valid,
        "mode_class": F.when(valid > 0, lb.argmax_class(counts)).otherwise(0),
        "consensus": F.when(valid > 0, F.array_max(counts) / valid),
    }


def temporal_consensus(classes: DataFrame, column: str = "model_class") -> DataFrame:
    """Per pixel over dates: valid dates, most frequent class, its share."""
    agg = classes.groupBy("y", "x").agg(
        *[F.count(F.when(F.col(column) == k, 1)).alias(f"_c{k}") for k in MODEL]
    )
    return agg.select("y", "x", *[c.alias(n) for n, c in _consensus_columns(lambda k: F.col(f"_c{k}")).items()])


def with_consensus(df: DataFrame, column: str = "model_class") -> DataFrame:
    """The same measures beside every observation: one shuffle, no join back."""
    w = Window.partitionBy("y", "x")
    out = df
    for k in MODEL:
        out = out.withColumn(f"_c{k}", F.count(F.when(F.col(column) == k, 1)).over(w))
    cols = _consensus_columns(lambda k: F.col(f"_c{k}"))
    return out.withColumns(cols).drop(*[f"_c{k}" for k in MODEL])


def consensus_summary(consensus: DataFrame, t: ReviewThresholds = REVIEW) -> DataFrame:
    valid = F.count(F.when(F.col("valid_count") > 0, 1))
    unstable = F.count(F.when(F.col("consensus") < t.unstable_fraction, 1))
    micro = F.round(F.col("consensus") * 1e6).cast("bigint")
    return consensus.agg(
        valid.alias("valid_pixel_count"),
        F.round(F.sum(micro) / (F.count("consensus") * 1e6), 6).alias("mean_consensus"),
        unstable.alias("unstable_pixel_count"),
        F.round(md.fraction(unstable, valid, 0.0), 6).alias("unstable_fraction"),
    )


def modal_label(images: DataFrame, start: str, end: str) -> DataFrame:
    """Most frequent label per pixel over [start, end); lowest label on ties.

    Labels outside 0..LABEL_SPAN - 1 and an empty window are errors.
    """
    windowed = images.where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date")))
    if windowed.isEmpty():
        raise ValueError(f"no image from {start} to before {end}")
    coded = F.col("label").between(0, LABEL_SPAN - 1)
    label = F.when(coded, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("label out of range: "), F.col("label").cast("string"))).cast("int"))
    counts = windowed.withColumn("label", label).groupBy("y", "x", "label").agg(F.count(F.lit(1)).alias("n"))
    # count and label share one number, so the winner is a plain hash aggregate
    best = F.max(F.col("n") * LABEL_SPAN + (LABEL_SPAN - 1 - F.col("label")))
    return counts.groupBy("y", "x").agg(best.alias("b"), F.sum("n").alias("image_count")).select(
        "y", "x", (LABEL_SPAN - 1 - F.col("b") % LABEL_SPAN).cast("int").alias("label"),
        F.expr(f"b div {LABEL_SPAN}").alias("votes"), "image_count"
    )


def with_evidence(model: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Model output, votes and consensus side by side."""
    out = with_consensus(majority_vote(model, sources))
    return out.withColumn("is_compatible", lb.compatible(F.col("model_class"), F.col("agreement")))


def with_zones(evidence: DataFrame, t: ReviewThresholds = REVIEW) -> DataFrame:
    valid = F.col("model_class") > 0
    return evidence.withColumns({
        "valid": valid,
        "agreement_zone": valid & weak_support(),
        "disagreement_zone": valid & F.col("disagreement"),
        "high_entropy_zone": valid & (F.col("entropy") >= t.high_entropy),
        "low_confidence_zone": valid & (F.col("confidence") < t.low_confidence),
    }).withColumn(
        "review_zone", F.col("disagreement_zone") | F.col("high_entropy_zone") | F.col("low_confidence_zone")
    )


def weak_support() -> Column:
    return (F.col("agreement") > 0) & (F.col("source_count") >= 2) & ~F.col("disagreement")


def reliability_records(evidence: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    def n(c: str | Column) -> Column:
        return F.count(F.when(c if isinstance(c, Column) else F.col(c), 1))

    def micro_mean(c: str) -> Column:
        return F.round(F.sum(F.round(F.col(c) * 1e6).cast("bigint")) / (F.count(c) * 1e6), 6)

    valid, agree, review = n("valid"), n("agreement_zone"), n("review_zone")
    comp = n(F.col("agreement_zone") & F.col("is_compatible"))
    return with_zones(evidence).groupBy(*keys).agg(
        valid.alias("valid_pixels"), agree.alias("agreement_zone_pixels"), comp.alias("compatible_pixels"),
        F.round(md.fraction(agree, valid, 0.0), 6).alias("agreement_zone_fraction"),
        F.round(md.fraction(comp, agree, 0.0), 6).alias("compatible_fraction"),
        n("disagreement_zone").alias("disagreement_pixels"), n("high_entropy_zone").alias("high_entropy_pixels"),
        n("low_confidence_zone").alias("low_confidence_pixels"), review.alias("review_pixels"),
        F.round(md.fraction(review, valid, 0.0), 6).alias("review_fraction"),
        micro_mean("confidence").alias("mean_confidence"), micro_mean("entropy").alias("mean_entropy"),
    )


def reliability_summary(records: DataFrame) -> DataFrame:
    worst = F.max(F.struct("review_fraction", (-F.col("scene")).alias("neg")))
    return records.agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.round(F.avg("compatible_fraction"), 4).alias("mean_compatible_fraction"),
        F.round(F.avg("review_fraction"), 4).alias("mean_review_fraction"),
        (-worst["neg"]).alias("highest_priority_scene"),
    )


def refine(evidence: DataFrame, include_external: bool = True, t: ReviewThresholds = REVIEW) -> DataFrame:
    """Pseudo-labels: strict model-compatible pixels first, then source-only agreement."""
    support = weak_support()
    strict = (
        (F.col("model_class") > 0) & (F.col("confidence") >= t.strict_confidence) & (F.col("entropy") <= t.strict_entropy)
        & (F.col("consensus") >= t.strict_consensus) & support & F.col("is_compatible")
    )
    external_label = lb.harmonized_to_model(F.col("agreement"))
    external = F.lit(include_external) & (external_label > 0) & support
    return evidence.withColumns({"strict": strict, "external": external}).withColumns({
        "refined_label": F.when(F.col("strict"), F.col("model_class")).when(F.col("external"), external_label).otherwise(0),
        "refined_mask": F.col("strict") | F.col("external"),
        "refined_confidence": lb.refined_confidence(
            F.col("strict"), F.col("external"), F.col("confidence"), F.col("entropy"), F.col("consensus"),
            F.col("source_count")),
    })


def refined_summary(refined: DataFrame) -> DataFrame:
    valid = F.count(F.when(F.col("model_class") > 0, 1))
    chosen = F.count(F.when(F.col("refined_mask"), 1))
    return refined.groupBy("scene").agg(
        chosen.alias("selected_pixels"), valid.alias("valid_pixels"),
        F.round(md.fraction(chosen, valid, 0.0), 6).alias("selected_fraction"),
        F.count(F.when(F.col("strict"), 1)).alias("strict_pixels"),
        F.count(F.when(F.col("external"), 1)).alias("external_pixels"),
        *[F.count(F.when(F.col("refined_label") == k, 1)).alias(f"class_{k}_pixels") for k in MODEL],
    )


def calibration_bins(evidence: DataFrame, bins: int = 10) -> DataFrame:
    """Support rate per confidence bin; empty bins stay with a NULL rate."""
    hit = evidence.where((F.col("model_class") > 0) & F.col("confidence").isNotNull()).select(
        F.least(F.floor(F.round("confidence", 6) * bins), F.lit(bins - 1)).cast("int").alias("bin"),
        weak_support().alias("supported"),
    ).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("supported"), 1)).alias("s"))
    frame = evidence.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(hit, "bin", "left").select(
        "bin",
        F.round(F.col("bin") / bins, 3).alias("confidence_low"),
        F.round((F.col("bin") + 1) / bins, 3).alias("confidence_high"),
        F.round((F.col("bin") + 0.5) / bins, 3).alias("midpoint"),
        F.coalesce("n", F.lit(0)).alias("pixel_count"),
        F.round(F.col("s") / F.col("n"), 6).alias("support_rate"),
    )


def calibration_gap(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("midpoint") - F.col("support_rate"))
    return bins.agg(
        F.count("support_rate").alias("usable_bins"), F.round(F.avg(F.round(gap, 6)), 5).alias("mean_abs_gap")
    )


def class_metrics(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """IoU, Dice and recall per class from the confusion counts; label 0 is ignored."""
    conf = predicted.where(F.col(label) > 0).groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = conf.select(
        F.explode(F.array(
            F.struct(F.col("t").cast("int").alias("class_id"), F.col("n").alias("tn"), F.lit(0).cast("bigint").alias("pn"),
                     F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("p").cast("int").alias("class_id"), F.lit(0).cast("bigint").alias("tn"), F.col("n").alias("pn"),
                     F.lit(0).cast("bigint").alias("hit")),
        )).alias("s")
    ).select("s.*").where("class_id > 0")
    a = sides.groupBy("class_id").agg(
        F.sum("tn").alias("true_pixels"), F.sum("pn").alias("predicted_pixels"), F.sum("hit").alias("intersection"))
    union = F.col("true_pixels") + F.col("predicted_pixels") - F.col("intersection")
    return a.withColumns({
        "iou": F.round(md.fraction(F.col("intersection"), union), 6),
        "dice": F.round(md.fraction(2 * F.col("intersection"), F.col("true_pixels") + F.col("predicted_pixels")), 6),
        "recall": F.round(md.fraction(F.col("intersection"), F.col("true_pixels")), 6),
    })


def review_zones(evidence: DataFrame, t: ReviewThresholds = REVIEW) -> DataFrame:
    zone = md.review_zone(F.col("confidence"), F.col("entropy"), F.col("disagreement"), t)
    return evidence.withColumn("zone", zone).groupBy("scene", "zone").agg(F.count(F.lit(1)).alias("pixel_count"))


def review_tasks(records: DataFrame, max_items: int) -> DataFrame:
    """Scenes that need review most; the rank window runs over the kept rows only."""
    top = records.orderBy(F.col("review_fraction").desc(), "scene").limit(max_items)
    w = Window.orderBy(F.col("review_fraction").desc(), "scene")
    return top.select(F.row_number().over(w).alias("priority"), "scene", "review_fraction", "compatible_fraction")


def first_valid_mosaic(tiles: DataFrame, value: str, order: str) -> DataFrame:
    """Overlapping tiles: the first source in order with a value wins; combines map-side.

    `order` must not repeat within a pixel.
    """
    return tiles.where(F.col(value).isNotNull()).groupBy("y", "x").agg(
        F.min_by(value, order).alias(value), F.min(order).alias(order))


def latest_per_split(records: DataFrame, split: str, wanted: str, tag: str) -> DataFrame:
    """Newest record of a split, or of any split when the wanted one is empty."""
    best = F.max(F.struct((F.col(split) == wanted).alias("hit"), F.col(tag).alias("tag"), F.col(split).alias("s")))
    return records.agg(best.alias("b")).select(F.col("b.tag").alias("tag"), F.col("b.s").alias("split"))
