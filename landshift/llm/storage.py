"""Tables written between the steps of an operator.

They live in a database whose folder lies under spark.checkpoint.dir, which all
executors share, so a lost executor costs no recomputation beyond its own task.
Only SQL touches the files: a table that is no longer needed is dropped, the
rest go with the session.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from landshift.session import ensure_checkpoint_dir

_DATABASES: dict[str, str] = {}


def _database(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _DATABASES:
        ensure_checkpoint_dir(spark)
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        name = "landshift_" + uuid.uuid4().hex[:12]
        spark.sql(f"CREATE DATABASE {name} LOCATION '{folder.rstrip('/')}/{name}'")
        _DATABASES[app] = name
        atexit.register(_forget, spark, app)
    return _DATABASES[app]


def _forget(spark: SparkSession, app: str) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        spark.sql(f"DROP DATABASE IF EXISTS {_DATABASES.pop(app)} CASCADE")


def store(df: DataFrame) -> DataFrame:
    """`df` written once as a Parquet table and read back; `discard` drops it."""
    return _saved(df.sparkSession, df.write)


def _saved(spark: SparkSession, writer: DataFrameWriter) -> DataFrame:
    name = f"{_database(spark)}.t_{uuid.uuid4().hex}"
    writer.format("parquet").option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.stored_as = name
    return out


def discard(*stored: DataFrame) -> None:
    """Drop tables made by `store` that no later step reads."""
    for df in stored:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stored_as} PURGE")


def store_by_key(df: DataFrame, key: str) -> DataFrame:
    """As `store`, but bucketed and sorted by `key`, so that later joins on it move only the other side."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _saved(spark, df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key))
