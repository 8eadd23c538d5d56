"""Sinks and table maintenance: bands, features, publishing, scene upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from landshift.operators.rollup import residual_properties

SCENE_MUTABLE = ("cloud_cover", "assets", "properties")
CHANGE_CORE = ("id", "change_type", "confidence", "base_confidence", "area_m2")


def write_band(df: DataFrame, path: str, dtype: str = "float") -> None:
    """Pixels as a table laid out for pruning: scene and band folders, sorted rows."""
    (
        df.withColumn("value", F.col("value").cast(dtype))
        .repartition("scene", "band", (F.floor(F.col("y") / 1024)).alias("_strip"))
        .sortWithinPartitions("scene", "band", "y", "x")
        .select("scene", "band", "y", "x", "value")
        .write.mode("overwrite").partitionBy("scene", "band").parquet(path)
    )


def as_features(df: DataFrame, geometry: str, properties: Sequence[str]) -> DataFrame:
    """GeoJSON feature text per row; `geometry` holds one ring as an array of [x, y], or a polygon as an array of rings."""
    ring = not isinstance(df.schema[geometry].dataType.elementType.elementType, ArrayType)
    return df.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.lit("Polygon").alias("type"), (F.array(geometry) if ring else F.col(geometry)).alias("coordinates")).alias("geometry"),
                F.struct(*properties).alias("properties"),
            )
        ).alias("value")
    )


def write_features(df: DataFrame, geometry: str, properties: Sequence[str], path: str) -> None:
    """Newline-delimited features; every task writes its own file."""
    as_features(df, geometry, properties).write.mode("overwrite").text(path)


def write_manifest(patches: DataFrame, path: str) -> None:
    """Patch manifest in (split, tag, patch_id) order: files hold consecutive ranges, rows are ordered inside them."""
    patches.orderBy("split", "tag", "patch_id").write.mode("overwrite").json(path)


def publish_rows(scored: DataFrame, run_id: str) -> DataFrame:
    """Publish-ready rows with a retry-safe id and their residual properties."""
    ready = scored.where("publish_ready")
    return ready.select(
        F.md5(F.concat_ws("|", F.lit(run_id), F.col("id").cast("string"))).alias("publish_id"),
        F.lit(run_id).alias("run_id"), "id", "change_type",
        F.coalesce("confidence", "base_confidence").alias("confidence"), "area_m2",
        residual_properties(ready, CHANGE_CORE).alias("properties"),
    )


def publish(scored: DataFrame, path: str, run_id: str, replace: bool = True) -> None:
    """Rows in a folder per run, and the run's own row in the folder `path`_runs.

    A run that is published again replaces its own folder and row. `replace` drops the rows of
    the other runs; their run rows stay, as a history. The run's row is written last, so a run
    without one did not finish.
    """
    mode = "static" if replace else "dynamic"
    publish_rows(scored, run_id).write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", mode).parquet(path)
    run_row(scored, run_id).write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").parquet(f"{path.rstrip('/')}_runs")


def run_row(scored: DataFrame, run_id: str, status: str = "published") -> DataFrame:
    """Bookkeeping of one run: its status and how many rows it published and held back."""
    ready = F.count(F.when(F.col("publish_ready"), 1))
    return scored.agg(ready.alias("published_count"), (F.count(F.lit(1)) - ready).alias("held_count")).select(
        F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), "published_count", "held_count")


def upsert_scenes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new ids; on conflict only the mutable columns take the new value."""
    o, n = stored.alias("o"), incoming.alias("n")
    cols = []
    for c in stored.columns:
        if c == "id":
            cols.append(F.coalesce(F.col("o.id"), F.col("n.id")).alias("id"))
        elif c in SCENE_MUTABLE:
            cols.append(F.when(F.col("n.id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("o.id").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(*cols)
