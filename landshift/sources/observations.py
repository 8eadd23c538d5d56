"""Observation tables derived from the given parquet tables.

Every table here grows with its source: the raster is 56 columns wide and as
tall as the part table is long, so more parts mean more rows of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landshift.functions import bands

RASTER_WIDTH = 56
PATCH = 8
SCENE_EPOCH = 1995
ROWS_PER_TASK = 100_000  # line items that one task turns into pixels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def pixels(spark: SparkSession, sf_dir: str, scenes: tuple[int, int] | None = None) -> DataFrame:
    """One row per (scene, y, x): six bands, four weak sources, two raw sums.

    `scenes` (first, last) becomes a date range that the scan can push down. Raster rows stay together and
    their tasks grow in number with the line items, so that neither the scan nor what follows in a task grows.
    """
    li = table(spark, sf_dir, "lineitem")
    tasks = 1 + li.count() // ROWS_PER_TASK
    if scenes is not None:
        first, last = (f"{SCENE_EPOCH + s}-01-01" for s in (scenes[0], scenes[1] + 1))
        li = li.where((F.col("l_shipdate") >= F.lit(first).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(last).cast("timestamp_ntz")))
    keyed = li.select(
        (F.year("l_shipdate") - SCENE_EPOCH).alias("scene"),
        F.expr("l_partkey div 8").alias("y"),
        ((F.col("l_partkey") % 8) * 7 + F.col("l_linenumber") - 1).cast("int").alias("x"),
        cents(F.col("l_discount")).alias("discount"),
        cents(F.col("l_tax")).alias("tax"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        cents(F.col("l_extendedprice")).alias("price"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_orderkey").alias("ord"),
    )
    sums = keyed.repartition(tasks, "y").groupBy("scene", "y", "x").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("discount").alias("t_discount"),
        F.sum("tax").alias("t_tax"),
        F.sum("quantity").alias("t_quantity"),
        F.sum(F.col("price") % 97 + 1).alias("t_price"),
        F.sum(F.col("supp") % 100 + 1).alias("t_vv"),
        F.sum(F.col("ord") % 50 + 1).alias("t_vh"),
        F.sum("supp").alias("sum_supp"),
        F.sum("ord").alias("sum_ord"),
        F.sum("price").alias("sum_price"),
    )
    n = F.col("n")
    return sums.select(
        "scene", "y", "x", "n",
        # what is no number, or the sentinel, is nodata from here on
        *[bands.finite(F.col(total) / (n * scale)).alias(band) for band, total, scale in (
            ("red", "t_discount", 10.0), ("green", "t_tax", 8.0), ("nir", "t_quantity", 50.0), ("swir", "t_price", 97.0), ("vv", "t_vv", 100.0), ("vh", "t_vh", 50.0))],
        (F.col("sum_supp") % 7).cast("int").alias("s1"),
        (F.col("sum_ord") % 7).cast("int").alias("s2"),
        (F.col("sum_price") % 7).cast("int").alias("s3"),
        (F.col("t_quantity") % 7).cast("int").alias("s4"),
        "sum_supp", "sum_ord",
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with the four monitored indices."""
    return with_indices(pixels(spark, sf_dir))


def with_indices(px: DataFrame) -> DataFrame:
    c = F.col
    return px.withColumns({
        "ndvi": bands.ndvi(c("nir"), c("red")),
        "ndwi": bands.ndwi(c("green"), c("nir")),
        "ndbi": bands.ndbi(c("swir"), c("nir")),
        "ratio": bands.safe_ratio(c("vv"), c("vh")),
    })


def terrain(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    """Elevation grid: a row per vector, a column per component."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")
    ).select("y", "x", bands.finite(F.round(F.col("v").cast("double") * 1000, 3)).alias("elevation"))
    if holes:
        return cells.withColumn("elevation", F.when((F.col("y") + F.col("x")) % 11 != 0, F.col("elevation")))
    return cells


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalogue: optical views and sign-ups; radar clicks (ascending), purchases (descending) and errors (orbit unknown)."""
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("id"),
        F.when(kind.isin("view", "signup"), "optical").otherwise("radar").alias("collection"),
        F.col("ts").alias("acquired_at"),
        F.to_date("ts").alias("day"),
        F.weekofyear("ts").alias("period"),
        F.col("value").alias("cloud_cover"),
        F.concat(F.lit("T"), F.col("user_id") % 2).alias("tile"),
        F.when(kind == "click", "ascending").when(kind == "purchase", "descending").alias("orbit"),
        F.when(F.col("event_id") % 5 == 0, F.array(F.lit("VV")))
        .otherwise(F.array(F.lit("VV"), F.lit("VH"))).alias("polarizations"),
        F.when(F.col("event_id") % 7 == 0, F.create_map(F.lit("red"), F.concat(F.lit("r/"), F.col("event_id"))))
        .otherwise(F.create_map(F.lit("red"), F.concat(F.lit("r/"), F.col("event_id")),
                                F.lit("nir"), F.concat(F.lit("n/"), F.col("event_id")))).alias("assets"),
        F.col("user_id").alias("x0"),
        (F.col("event_id") % 97).alias("y0"),
        F.col("props").alias("properties"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected change records from orders and their customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = cents(F.col("o_totalprice"))
    lead = F.substring("o_orderpriority", 1, 1)
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .select(
            F.col("o_orderkey").alias("id"),
            F.when(lead == "1", "vegetation_loss").when(lead == "2", "built_up_gain")
            .when(lead == "3", "moisture_change").otherwise("radar_change").alias("change_type"),
            F.when(F.col("c_mktsegment") == "BUILDING", "built_up")
            .when(F.col("c_mktsegment") == "AUTOMOBILE", "bare_sparse")
            .when(F.col("c_mktsegment") == "MACHINERY", "mixed")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "vegetation")
            .when(F.col("c_mktsegment") == "FURNITURE", "water_moisture").alias("before_state"),
            F.get(F.array(*[F.lit(s) for s in STATES]), (F.col("o_custkey") % 6).cast("int")).alias("after_state"),
            ((n % 1000) / 1000.0).alias("base_confidence"),
            F.when(n % 13 != 0, (n % 701) / 501.0).alias("change_magnitude"),
            ((n % 900 + 10) * 100.0).alias("area_m2"),
            F.to_date("o_orderdate").alias("before_date"),
            F.date_add(F.to_date("o_orderdate"), 45).alias("after_date"),
        )
    )


# after-state by customer remainder; the sixth slot is a missing state
STATES = ("built_up", "bare_sparse", "mixed", "vegetation", "water_moisture", None)


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-pixel class probabilities 1..5 with integer weights."""
    return with_model_output(pixels(spark, sf_dir))


def with_model_output(px: DataFrame) -> DataFrame:
    from landshift.functions.labels import argmax_class
    from landshift.functions.model import predictive_entropy

    w = [((F.col("sum_supp") * k + F.col("sum_ord")) % 11 + 1) for k in range(1, 6)]
    w = [x * x * x for x in w]
    total = w[0] + w[1] + w[2] + w[3] + w[4]
    return (
        px.withColumn("_w", F.array(*w)).withColumn("_total", total)
        .withColumn("probs", F.transform("_w", lambda x: x / F.col("_total")))
        .withColumn("model_class", argmax_class(F.col("_w")))
        .withColumn("confidence", F.array_max("_w") / F.col("_total"))
        .withColumn("entropy", F.round(predictive_entropy(F.col("probs"), 5), 6))
        .drop("_w", "_total")
    )


def patch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per vector: year, split, weak label histogram, 4 x 16 channels."""
    e = table(spark, sf_dir, "embeddings")
    year = (2023 + F.col("vec_id") % 4).cast("int")
    a = F.col("vec_id") % 17
    return e.select(
        F.col("vec_id").alias("patch_id"),
        year.alias("year"),
        F.when(year <= 2024, "train").when(year == 2025, "validation").otherwise("test").alias("split"),
        F.col("label"),
        F.when(
            F.col("vec_id") % 23 != 0,
            F.map_from_arrays(
                F.array((F.col("label") % 5 + 1).cast("int"), ((F.col("label") + 1) % 5 + 1).cast("int"),
                        ((F.col("label") + 2) % 5 + 1).cast("int")),
                F.array((a * 8 + 1).cast("bigint"), (F.col("vec_id") % 29).cast("bigint"), F.lit(3).cast("bigint")),
            ),
        ).alias("class_hist"),
        F.transform("embedding", lambda v: F.round(v.cast("double"), 6)).alias("vector"),
    )


def vector_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements from orders: a tag map and a point list in grid units."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    x, y = (k % 53).cast("double"), F.floor(k / 53).cast("double")
    w = (F.col("o_custkey") % 3 + 1).cast("double")

    def pt(px: Column, py: Column) -> Column:
        return F.struct(px.alias("x"), py.alias("y"))

    lead = F.substring("o_orderpriority", 1, 1)
    ring = F.array(pt(x, y), pt(x + w, y), pt(x + w, y + 1.5), pt(x, y + 1.5), pt(x, y))
    line = F.array(pt(x, y), pt(x + w, y + 0.5))
    single = F.array(pt(x, y))
    small = F.array(pt(x, y), pt(x + w, y), pt(x, y))
    shape = k % 5
    return o.select(
        k.alias("id"),
        F.when(lead == "1", F.create_map(F.lit("building"), F.lit("yes"), F.lit("landuse"), F.lit("forest")))
        .when(lead == "2", F.create_map(F.lit("highway"), F.lit("track")))
        .when(lead == "3", F.create_map(F.lit("landuse"), F.get(
            F.array(*[F.lit(v) for v in ("Forest", "quarry", "basin", "orchard", "retail")]),
            (F.col("o_custkey") % 5).cast("int"))))
        .when(lead == "4", F.create_map(F.lit("landuse"), F.lit("military")))
        .otherwise(F.create_map(F.lit("natural"), F.lit("wood"))).alias("tags"),
        F.when(shape == 0, line).when(shape == 1, single).when(shape == 2, small).otherwise(ring).alias("points"),
    )


def raster_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster headers, one per supplier, most of them on the master grid."""
    from landshift.config import GRID

    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    off = F.when(k % 10 == 3, 1.0).when(k % 10 == 4, 0.0001).when(k % 10 == 7, 5.0).otherwise(0.0)
    return s.select(
        k.alias("id"),
        F.concat(F.lit("family_"), F.col("s_nationkey") % 7).alias("family"),
        F.when(k % 11 == 5, "EPSG:4326").otherwise(GRID.crs).alias("crs"),
        F.when(k % 13 == 6, GRID.width - 1).otherwise(GRID.width).alias("width"),
        F.lit(GRID.height).alias("height"),
        F.array(F.lit(10.0), F.lit(0.0), F.lit(GRID.left) + off, F.lit(0.0), F.lit(-10.0), F.lit(GRID.top)).alias("affine"),
        F.array(F.lit(GRID.left) + off, F.lit(GRID.bottom), F.lit(GRID.right) + off, F.lit(GRID.top)).alias("bounds"),
        F.when(k % 4 == 0, "uint8").otherwise(GRID.dtype).alias("dtype"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("lang").alias("suffix"),
        F.col("n_chars").alias("length"),
    )
