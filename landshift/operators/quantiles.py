"""Exact quantiles of a whole column without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.session import cut_lineage


def exact_quantiles_by(df: DataFrame, values: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(name, q): quantiles of several columns from one pass over the rows, as `exact_quantiles` finds them for one."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in values]))
    counts = df.select(named.alias("r")).select("r.*").where(F.col("v").isNotNull()).groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    staged = cut_lineage(counts.repartitionByRange("name", "v").withColumn("_range", F.spark_partition_id()))
    sizes = staged.groupBy("name", "_range").agg(F.sum("n").alias("s"))
    earlier = Window.partitionBy("name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("name", "_range", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("o"))
    totals = sizes.groupBy("name").agg(F.sum("s").alias("total"))
    local = Window.partitionBy("name", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = staged.join(offsets, ["name", "_range"]).withColumn("hi", F.col("o") + F.sum("n").over(local)).join(totals, "name")
    lo = F.col("hi") - F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((lo <= rank) & (rank < F.col("hi")), F.col("v")))

    wanted = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    picks = [c.alias(f"{side}{i}") for i, w in enumerate(wanted) for side, c in (("b", at(F.floor(w))), ("a", at(F.ceil(w))))]
    row = ranked.groupBy("name", "total").agg(*picks)
    return row.select("name", F.array(*[
        F.col(f"b{i}") + (F.col(f"a{i}") - F.col(f"b{i}")) * (w - F.floor(w)) for i, w in enumerate(wanted)]).alias("q"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row with an array of linearly interpolated quantiles.

    Equal values are counted together first, so a value that fills a third of
    the column is a single row. Distinct values are then range-partitioned, the
    ranges accumulate their counts, and only values at a wanted rank survive.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    staged = cut_lineage(counts.repartitionByRange(F.col("v")).withColumn("_range", F.spark_partition_id()))
    sizes = staged.groupBy("_range").agg(F.sum("n").alias("s"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("o"))
    total = staged.agg(F.sum("n")).scalar()
    local = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = staged.join(offsets, "_range").select("v", (F.col("o") + F.sum("n").over(local)).alias("hi"), "n").withColumn(
        "lo", F.col("hi") - F.col("n")
    )
    wanted = [F.lit(float(p)) * (total - 1) for p in probs]
    picks = []
    for i, w in enumerate(wanted):
        below, above = F.floor(w), F.ceil(w)
        picks.append(F.max(F.when((F.col("lo") <= below) & (below < F.col("hi")), F.col("v"))).alias(f"b{i}"))
        picks.append(F.max(F.when((F.col("lo") <= above) & (above < F.col("hi")), F.col("v"))).alias(f"a{i}"))
    row = ranked.agg(*picks, F.max("hi").alias("total"))
    out = []
    for i, p in enumerate(probs):
        w = F.lit(float(p)) * (F.col("total") - 1)
        out.append(F.col(f"b{i}") + (F.col(f"a{i}") - F.col(f"b{i}")) * (w - F.floor(w)))
    return row.select(F.array(*out).alias("q"))
