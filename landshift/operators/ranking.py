"""Exact row numbers that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.session import cut_lineage


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """row_number() over (partition by keys order by order), for groups of any size.

    Rows are range-partitioned on keys and order, so a hot group spreads over
    many tasks; each range counts its rows, the counts are accumulated, and a
    row's number is its local number plus the rows of its group in earlier
    ranges. The order must be total. The ranges are written to the checkpoint
    folder once, which pins them for both readers.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    staged = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *cols).withColumn("_range", F.spark_partition_id())
    )
    sizes = staged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_range", *keys).orderBy(*cols)
    joined = staged.join(offsets, ["_range", *keys])
    return joined.withColumn(name, (F.col("_offset") + F.row_number().over(local)).cast("bigint")).drop("_range", "_offset")


def hash_order(key: Column, seed: int) -> Column:
    """Pseudo-random but reproducible order of a key, independent of partitioning."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def hash_unit(key: Column, seed: int) -> Column:
    """Reproducible number in [0, 1) per key."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, all rows when there are fewer."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def capped_strata(df: DataFrame, strata: Sequence[str], order: Sequence[Column], cap: int, total: int,
                  name: str = "sample_rank") -> DataFrame:
    """At most `cap` rows per stratum, then the best `total` rows with their rank.

    Both steps keep a bounded number of rows per task before anything is gathered.
    """
    w = Window.partitionBy(*strata).orderBy(*order)
    kept = df.withColumn("_s", F.row_number().over(w)).where(F.col("_s") <= cap).drop("_s")
    top = kept.orderBy(*order).limit(total)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))
