"""Review layer and review sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from landshift.functions import model as md
from landshift.operators.ranking import capped_strata, hash_order

# fixed values: advice shown per review priority
ACTIONS = {
    "high_anomaly": "Inspect first: possible new land-cover regime, sensor artifact, or model blind spot before any retraining.",
    "weak_support_review": "Review with imagery/OSM/indices and either assign a corrected class or mark as mixed/unknown.",
    "embedding_supported": "Use as a control sample only after visual review confirms the dominant interpretation.",
}


def with_priority(scored: DataFrame) -> DataFrame:
    p = md.review_priority(F.col("fraction"), F.col("anomaly"))
    return scored.withColumn("priority", p).withColumn(
        "priority_reason",
        F.when(F.col("priority") == "high_anomaly", "high embedding anomaly")
        .when(F.col("priority") == "weak_support_review", "mixed or weak-source support")
        .otherwise("embedding cluster has compatible weak-source interpretation"),
    )


def priority_areas(layer: DataFrame, side: int, pixel_area: float) -> DataFrame:
    return layer.groupBy("priority").agg(
        F.count(F.lit(1)).alias("patch_count"), (F.count(F.lit(1)) * float(side * side * pixel_area)).alias("area_m2"))


def review_samples(layer: DataFrame, max_samples: int, max_per_stratum: int) -> DataFrame:
    """Stratified top-k: capped per (priority, class, year), then the best overall with a rank."""
    scored = layer.withColumns({
        "review_score": F.round(md.review_score(F.col("fraction"), F.col("anomaly"), F.col("priority")), 6),
        "sampling_role": md.sampling_role(F.col("priority")),
        "recommended_action": F.when(F.col("priority") == "high_anomaly", ACTIONS["high_anomaly"])
        .when(F.col("priority") == "weak_support_review", ACTIONS["weak_support_review"])
        .otherwise(ACTIONS["embedding_supported"]),
    })
    order = [F.col("review_score").desc(), F.col("anomaly").desc(), F.col("patch_id")]
    return capped_strata(scored, ["priority", "class_id", "year"], order, max_per_stratum, max_samples)


def largest_remainders(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole quotas that add up to `total`; what rounding down leaves goes to the largest remainders, earlier names first."""
    quotas = {name: int(total * share + 1e-9) for name, share in shares.items()}
    by_rest = sorted(shares, key=lambda name: quotas[name] - total * shares[name])
    for name in by_rest[:total - sum(quotas.values())]:
        quotas[name] += 1
    return quotas


def expert_sample(pixels: DataFrame, key: str, total: int, seed: int) -> DataFrame:
    """Expert design: reliable, review and minority strata with fixed shares, reproducible order."""
    # fixed values: shares of the three strata
    shares = {"reliable_prediction": 0.35, "review_zone": 0.35, "minority_classes": 0.30}
    quotas = largest_remainders(total, shares)
    w = Window.partitionBy("stratum").orderBy(hash_order(F.col(key), seed), key)
    ranked = pixels.where(F.col("stratum").isin(*quotas)).withColumn("_rn", F.row_number().over(w))
    # the literal limit lets every task keep only its own first rows before the exchange
    kept = ranked.where(F.col("_rn") <= max(quotas.values()))
    limit = F.lit(0)
    for name, n in quotas.items():
        limit = F.when(F.col("stratum") == name, n).otherwise(limit)
    return kept.where(F.col("_rn") <= limit).drop("_rn")
