"""Scene catalogue kept current from a stream of arriving scenes.

The batch upsert runs once per micro-batch. Every batch writes a new version
folder and readers take the newest complete one, so a batch that is retried
after a lost executor rewrites the same folder instead of doubling rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from landshift.sources.sinks import upsert_scenes


def _version(path: str, batch: int) -> str:
    return f"{path}/version={batch:010d}"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions; the folder listing is one name per micro-batch."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root)]
    return sorted(
        int(p.getName().split("=")[1]) for p in names
        if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    )


def read_catalogue(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    done = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(_version(path, done[-1])) if done else None


def newest_per_id(batch: DataFrame, arrival: str) -> DataFrame:
    """One row per scene id of a batch, the latest arrival."""
    return batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), arrival).alias("r")).select("id", "r.*")


def keep_current(scenes: DataFrame, path: str, checkpoint: str, arrival: str = "acquired_at", **trigger) -> StreamingQuery:
    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = newest_per_id(batch, arrival)
        stored = read_catalogue(batch.sparkSession, path, before=batch_id)
        merged = fresh if stored is None else upsert_scenes(stored, fresh)
        merged.write.mode("overwrite").parquet(_version(path, batch_id))

    return scenes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
