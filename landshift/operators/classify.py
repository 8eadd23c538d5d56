"""Pixel classifier: weighted training, probabilities, per-class evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def train_and_predict(pixels: DataFrame, features: Sequence[str], label: str, trainable: str, weights: DataFrame, classes: int = 5,
                      max_iterations: int = 20) -> DataFrame:
    """Multinomial regression on trainable pixels, probabilities for all complete pixels.

    Class weights (one row per class) become one map beside every row; `iterations` tells
    after how many steps the fit stopped, `max_iterations` at the latest.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    complete = pixels.dropna(subset=list(features)).withColumn("features", array_to_vector(F.array(*features)))
    lookup = weights.agg(F.map_from_entries(F.collect_list(F.struct("class_id", "weight")))).scalar()
    train = complete.where(F.col(trainable)).withColumn("_weights", lookup).withColumn(
        "weight", F.coalesce(F.try_element_at("_weights", F.col(label)), F.lit(1.0)))
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iterations).fit(train)
    probs = vector_to_array("probability")
    return model.transform(complete).withColumn("probs", F.slice(probs, 2, classes)).withColumns({
        "model_class": F.col("prediction").cast("int"), "iterations": F.lit(model.summary.totalIterations)})
