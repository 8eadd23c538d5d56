"""Area of interest and master grid as one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.config import GRID, MasterGrid
from landshift.functions.geo import utm_to_lonlat

AOI_SCHEMA = (
    "features array<struct<properties: map<string, string>, "
    "geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
)


def load_aoi(spark: SparkSession, path: str) -> DataFrame:
    """Outer ring and bounding box of the first feature; fails on an empty collection."""
    doc = spark.read.schema(AOI_SCHEMA).json(path, multiLine=True)
    first = F.when(F.size("features") > 0, F.get("features", 0)).otherwise(
        F.raise_error(F.lit("the area of interest has no feature")))
    ring = F.transform(F.get(F.col("f.geometry.coordinates"), 0), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return doc.select(first.alias("f")).select(ring.alias("ring")).select(
        "ring", F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))


def grid_row(spark: SparkSession, g: MasterGrid = GRID) -> DataFrame:
    schema = "crs string, width int, height int, affine array<double>, bounds array<double>, tolerance double, dtype string"
    return spark.createDataFrame([(g.crs, g.width, g.height, list(g.affine), list(g.bounds), g.tolerance, g.dtype)], schema)


def grid_outline(grid: DataFrame, zone: int = 35, south: bool = True) -> DataFrame:
    """Closed corner ring of each grid in longitude and latitude, clockwise from the top left."""
    left, bottom, right, top = (F.get("bounds", i) for i in range(4))

    def corner(x, y):
        lon, lat = utm_to_lonlat(x, y, zone, south)
        return F.array(lon, lat)

    a = corner(left, top)
    return grid.select(F.array(a, corner(right, top), corner(right, bottom), corner(left, bottom), a).alias("ring"))


def outline_differs(outline: DataFrame, ring: list[list[float]], tolerance: float = 1e-9) -> DataFrame:
    """Whether a published ring departs from the grid outline anywhere."""
    want = F.array(*[F.array(F.lit(p[0]), F.lit(p[1])) for p in ring])
    gaps = F.zip_with("ring", want, lambda a, b: F.greatest(F.abs(a[0] - b[0]), F.abs(a[1] - b[1])))
    return outline.select((F.array_max(gaps) > tolerance).alias("differs"), F.array_max(gaps).alias("largest_gap"))
