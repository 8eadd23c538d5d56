"""Patch descriptors, scaling, encoding, clustering, anomaly scores and profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.config import FROZEN_YEAR, REVIEW, ReviewThresholds
from landshift.functions import model as md
from landshift.operators.overlay import keep_where
from landshift.operators.quantiles import exact_quantiles
from landshift.operators.ranking import hash_order, hash_sample
from landshift.session import cut_lineage


def without_frozen(records: DataFrame) -> DataFrame:
    """The frozen period never enters fitting or sampling."""
    return records.where(F.col("year") < FROZEN_YEAR)


def descriptors(values: DataFrame, quantiles: Sequence[float], keys: Sequence[str] = ("patch_id", "channel")) -> DataFrame:
    """Mean, population deviation and quantiles per patch channel.

    Masked values count; a patch whose mask is empty uses all of them; a
    channel without any value gets zeros. A patch is a bounded window.
    """
    q = F.array(*[F.lit(float(p)) for p in quantiles])
    masked = F.when(F.col("mask"), F.col("value"))
    agg = values.groupBy(*keys).agg(
        F.count(F.when(F.col("mask"), 1)).alias("_m"),
        F.avg(masked).alias("_ma"), F.stddev_pop(masked).alias("_ms"), F.percentile(masked, q).alias("_mq"),
        F.avg("value").alias("_aa"), F.stddev_pop("value").alias("_as"), F.percentile("value", q).alias("_aq"),
    )

    def pick(m: Column, a: Column) -> Column:
        return F.coalesce(F.when(F.col("_m") > 0, m).otherwise(a), F.lit(0.0))

    return agg.select(
        *keys, pick(F.col("_ma"), F.col("_aa")).alias("mean"), pick(F.col("_ms"), F.col("_as")).alias("std"),
        *[pick(F.get("_mq", i), F.get("_aq", i)).alias(f"p{round(p * 100):02d}") for i, p in enumerate(quantiles)],
    )


def descriptor_vectors(stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """Channel statistics joined into one vector per patch, channel-major; channels are few."""
    rows = F.sort_array(F.collect_list(F.struct("channel", F.array(*names).alias("v"))))
    return stats.groupBy("patch_id").agg(F.flatten(F.transform(rows, lambda r: r["v"])).alias("vector"))


def grid_descriptor(values: DataFrame, side: int, cells: int) -> DataFrame:
    """Mean and deviation of each layout cell of a square patch, zeros for empty cells."""
    size = side // cells
    r, c = F.floor(F.col("pos") / side), F.col("pos") % side
    trimmed = values.where((r < size * cells) & (c < size * cells))
    return trimmed.groupBy("patch_id", (F.floor(r / size) * cells + F.floor(c / size)).cast("int").alias("cell")).agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"))


def channel_moments(values: DataFrame) -> DataFrame:
    """One-pass moments of the train rows."""
    train = values.where("split = 'train'")
    n, s, q = F.count("value"), F.sum("value"), F.sum(F.col("value") * F.col("value"))
    return train.groupBy("channel").agg(
        n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(1e-6))).alias("std"))


def standard_scale(patches: DataFrame, dims: int) -> DataFrame:
    """Scaled vectors; statistics come from train patches, constant dimensions keep scale 1.

    The vectors are written once: they are thousands of times smaller than the
    pixels behind them and are read for fitting and again for scaling.
    """
    patches = cut_lineage(patches)
    fit = patches.where("split = 'train'").agg(
        F.array(*[F.avg(F.get("vector", i)) for i in range(dims)]).alias("m"),
        F.array(*[F.stddev_pop(F.get("vector", i)) for i in range(dims)]).alias("s"),
    ).select(F.struct("m", "s")).scalar()
    z = F.transform("vector", lambda v, i: (v - F.get(F.col("_f.m"), i)) / F.when(F.get(F.col("_f.s"), i) > 0, F.get(F.col("_f.s"), i)).otherwise(1.0))
    return patches.withColumn("_f", fit).withColumn("scaled", z).drop("_f")


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def dense_layer(vector: Column, weights: Sequence[Sequence[float]], bias: Sequence[float], relu: bool = True) -> Column:
    """weights[j] holds the input weights of output j."""
    units = [_dot(vector, _literal(w)) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)]
    return F.array(*[F.greatest(u, F.lit(0.0)) if relu else u for u in units])


def reconstruction_error(vector: Column, restored: Column) -> Column:
    sq = F.zip_with(vector, restored, lambda a, b: (a - b) * (a - b))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(vector)


def assign_clusters(df: DataFrame, vector: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """1-based id of the nearest centroid (first on ties) and the distance to it; 0 for nodata.

    The squares are written out component by component, which Spark compiles; functions over arrays are interpreted.
    """
    def distance(c: Sequence[float]) -> Column:
        gaps = [F.get(vector, F.lit(i)) - F.lit(float(v)) for i, v in enumerate(c)]
        return F.sqrt(reduce(add, [g * g for g in gaps], F.lit(0.0)))

    out = df.withColumn("_d", F.array(*[distance(c) for c in centroids]))
    return out.withColumns({
        "cluster": F.coalesce(F.array_position("_d", F.array_min("_d")).cast("int"), F.lit(0)),
        "center_distance": F.array_min("_d"),
    }).drop("_d")


def anomaly_scores(df: DataFrame) -> DataFrame:
    """Half reconstruction error, half centre distance, scaled by the 5th and 95th percentile."""
    raw = cut_lineage(df.withColumn("raw_anomaly", F.round(0.5 * F.col("error") + 0.5 * F.col("center_distance"), 9)))
    q = exact_quantiles(raw, "raw_anomaly", [0.05, 0.95]).scalar()
    return raw.withColumn("_q", q).withColumn(
        "anomaly",
        F.least(F.greatest((F.col("raw_anomaly") - F.get("_q", 0)) / (F.get("_q", 1) - F.get("_q", 0) + 1e-9), F.lit(0.0)), F.lit(1.0)),
    ).drop("_q")


def silhouette(df: DataFrame, key: str, vector: str, cluster: str, sample: int, seed: int) -> DataFrame:
    """Euclidean silhouette of a bounded evaluation sample, NULL with fewer than two clusters.

    The sample (at most `sample` rows) goes to the tasks as one array; every
    task scores its own share of the rows against it.
    """
    spark = df.sparkSession
    picked = hash_sample(df.where(F.col(cluster) > 0), key, sample, seed).select(key, vector, cluster)
    rows = picked.collect()
    points = np.array([r[vector] for r in rows], dtype=float).reshape(len(rows), -1)
    labels = np.array([r[cluster] for r in rows], dtype=int)
    shared = spark.sparkContext.broadcast((points, labels))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pts, lab = shared.value
        ids = np.unique(lab)
        for batch in batches:
            i = batch["i"].to_numpy()
            d = np.sqrt(((pts[i][:, None, :] - pts[None, :, :]) ** 2).sum(-1))
            sums = np.stack([d[:, lab == k].sum(1) for k in ids], 1)
            sizes = np.array([(lab == k).sum() for k in ids], dtype=float)
            own = np.searchsorted(ids, lab[i])
            r = np.arange(len(i))
            a = sums[r, own] / np.maximum(sizes[own] - 1, 1)
            other = sums / sizes
            other[r, own] = np.inf
            b = other.min(1)
            top = np.maximum(a, b)
            s = np.where((sizes[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
            yield pd.DataFrame({"s": s})

    n_clusters = len(set(labels.tolist()))
    index = spark.range(len(rows)).select(F.col("id").alias("i")).repartition(max(1, len(rows) // 256), "i")
    if n_clusters < 2:
        return index.agg(F.lit(len(rows)).alias("sample_size"), F.lit(n_clusters).alias("cluster_count"), F.lit(None).cast("double").alias("silhouette"))
    return index.mapInPandas(score, "s double").agg(
        F.count(F.lit(1)).cast("int").alias("sample_size"), F.lit(n_clusters).alias("cluster_count"), F.round(F.avg("s"), 5).alias("silhouette"))


def silhouette_all(df: DataFrame, vector: str, cluster: str, dims: int) -> DataFrame:
    """Silhouette of all rows with squared distances, which a cluster's size, sum and sum of squares give exactly.

    One row per cluster comes out of the aggregation and goes back to the rows as a
    scalar; NULL with fewer than two clusters.
    """
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda acc, v: acc + v * v)
    rows = df.where(F.col(cluster) > 0).select(F.col(vector).alias("v"), F.col(cluster).alias("own"), square.alias("sq"))
    sums = rows.groupBy(F.col("own").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sq").alias("sq"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dims)]).alias("s"))
    clusters = sums.agg(F.sort_array(F.collect_list(F.struct("k", "n", "sq", "s")))).scalar()

    def total(c: Column) -> Column:
        dot = F.aggregate(F.zip_with("v", c["s"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return c["n"] * F.col("sq") + c["sq"] - 2 * dot

    own = F.get(F.filter("c", lambda c: c["k"] == F.col("own")), F.lit(0))
    scored = rows.withColumn("c", clusters).withColumns({
        "a": total(own) / F.greatest(own["n"] - 1, F.lit(1)), "n": own["n"],
        "b": F.array_min(F.transform(F.filter("c", lambda c: c["k"] != F.col("own")), lambda c: total(c) / c["n"])),
    })
    top = F.greatest("a", "b")
    s = F.when((F.col("n") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    many = F.max(F.size("c"))
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(many, F.lit(0)).cast("bigint").alias("cluster_count"),
        F.when(many > 1, F.round(F.avg(s), 5)).alias("silhouette"))


def cluster_profile(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, label mix, means and first examples per cluster.

    One pass reduces the patches to (cluster, class, year) cells; everything but
    the examples comes from those few rows.
    """
    cells = df.groupBy(cluster, "class_id", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("fraction") * 1e6).cast("bigint")).alias("f"),
        F.sum(F.round(F.col("anomaly") * 1e6).cast("bigint")).alias("a"))

    def mix_text(entries: Column, key: str) -> Column:
        return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e[key].cast("string"), e["n"].cast("string"))), ",")

    def by(key: str) -> DataFrame:
        return cells.groupBy(cluster, key).agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("a").alias("a"))

    labels = by("class_id").groupBy(cluster).agg(
        F.sum("n").alias("patch_count"), F.sum("f").alias("f"), F.sum("a").alias("a"),
        F.max(F.struct("n", (-F.col("class_id")).alias("neg"))).alias("_b"),
        F.sort_array(F.collect_list(F.struct("class_id", "n"))).alias("_mix"),
    )
    years = by("year").groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("year", "n"))).alias("_years"))
    first = df.select(cluster, "patch_id", F.row_number().over(Window.partitionBy(cluster).orderBy("patch_id")).alias("_rn")).where("_rn <= 5")
    examples = first.groupBy(cluster).agg(F.array_join(F.transform(F.sort_array(F.collect_list("patch_id")), lambda p: p.cast("string")), ",").alias("examples"))
    size = F.col("patch_count")
    return labels.join(years, cluster).join(examples, cluster).select(
        cluster, "patch_count", (-F.col("_b.neg")).alias("dominant_class"), F.round(F.col("_b.n") / size, 6).alias("dominant_share"),
        mix_text(F.col("_mix"), "class_id").alias("label_mix"),
        F.round(md.histogram_entropy(F.transform("_mix", lambda e: e["n"])), 6).alias("mix_entropy"),
        F.round(F.col("f") / (size * 1e6), 6).alias("mean_fraction"), F.round(F.col("a") / (size * 1e6), 5).alias("mean_anomaly"),
        mix_text(F.col("_years"), "year").alias("year_mix"), "examples",
    )


def track_metrics(scored: DataFrame, profile: DataFrame, t: ReviewThresholds = REVIEW) -> DataFrame:
    """Reliability summary of a label-free track, one row."""
    n = F.count(F.lit(1))
    review = (F.col("fraction") < t.weak_support) | (F.col("anomaly") >= t.high_anomaly)
    a = scored.agg(
        n.alias("patch_count"),
        F.round(F.sum(F.round(F.col("fraction") * 1e6).cast("bigint")) / (n * 1e6), 6).alias("weak_compatibility"),
        F.round(F.count(F.when(review, 1)) / n, 6).alias("review_burden"),
        F.round(F.count(F.when(F.col("anomaly") >= t.high_anomaly, 1)) / n, 6).alias("high_anomaly_fraction"),
    )
    p = profile.agg(
        # six decimals in micro-units: a sum of doubles would leave ties of the rounding to the order of the clusters
        F.struct(F.round(F.sum(F.round(F.col("mix_entropy") * 1e6).cast("bigint")) / (F.nullif(F.count("mix_entropy"), F.lit(0)) * 1e6), 5).alias("a"),
                 F.round(F.count(F.when(F.col("dominant_share") >= t.weak_support, 1)) / n, 6).alias("c")).alias("s")).scalar()
    return a.withColumn("_p", p).select(
        "*", F.col("_p.a").alias("mean_ambiguity"), F.col("_p.c").alias("coherent_fraction")).drop("_p")


def quota_sample(records: DataFrame, key: str, max_records: int, seed: int, floor: int = 32, share: float = 0.65) -> DataFrame:
    """Train quota first, the rest from other splits, both in reproducible random order.

    Each side keeps at most `max_records` rows before it is ranked.
    """
    quota = max(floor, int(max_records * share))
    order = hash_order(F.col(key), seed)
    train = records.where("split = 'train'").orderBy(order, key).limit(quota)
    other = records.where("split <> 'train'").orderBy(order, key).limit(max_records)
    taken = train.agg(F.count(F.lit(1))).scalar()
    w = Window.orderBy(hash_order(F.col(key), seed), key)
    rest = other.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(max_records) - taken).drop("_rn")
    return train.unionByName(rest)


def pixel_cluster_profile(pixels: DataFrame, features: Sequence[str], pixel_area: float) -> DataFrame:
    from landshift.functions.change import landcover_state

    n = F.count(F.lit(1))
    agg = keep_where(pixels, F.col("cluster") > 0, ["cluster", *features]).groupBy("cluster").agg(
        n.alias("pixel_count"), (n * pixel_area).alias("area_m2"),
        *[F.round(F.sum(F.round(F.col(f) * 1e6).cast("bigint")) / (F.count(f) * 1e6), 5).alias(f) for f in features])
    return agg.withColumn("state", landcover_state(F.col("ndvi"), F.col("ndbi"), F.col("ndwi")))


def linear_autoencode(df: DataFrame, vector: str, axes: Sequence[Sequence[float]]) -> DataFrame:
    """Encode onto the axes, decode back, and keep the mean squared error."""
    back = [list(row) for row in zip(*axes, strict=True)]
    coded = df.withColumn("code", dense_layer(F.col(vector), axes, [0.0] * len(axes), relu=False))
    return coded.withColumn("error", reconstruction_error(F.col(vector), dense_layer(F.col("code"), back, [0.0] * len(back), relu=False)))
