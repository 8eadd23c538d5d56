"""Band algebra. Nodata is NULL everywhere, so three-valued logic does the masking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 1e-6  # fixed value: denominators at or below this are nodata
NODATA = -9999.0  # fixed value: sentinel used by external rasters


def finite(value: Column, nodata: float | None = NODATA) -> Column:
    """NaN, infinities and the sentinel become NULL."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    if nodata is not None:
        bad = bad | (value == F.lit(nodata))
    return F.when(~bad, value)


def safe_divide(num: Column, den: Column) -> Column:
    return F.when(F.abs(den) > EPSILON, num / den)


safe_ratio = safe_divide


def normalized_difference(a: Column, b: Column) -> Column:
    return safe_divide(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def ndbi(swir: Column, nir: Column) -> Column:
    return normalized_difference(swir, nir)


def evi2(nir: Column, red: Column) -> Column:
    return safe_divide(F.lit(2.5) * (nir - red), nir + F.lit(2.4) * red + F.lit(1.0))


def savi(nir: Column, red: Column) -> Column:
    return safe_divide(F.lit(1.5) * (nir - red), nir + red + F.lit(0.5))


def mndwi(green: Column, swir: Column) -> Column:
    return safe_divide(green - swir, green + swir)


def bsi(swir: Column, red: Column, nir: Column, green: Column) -> Column:
    bright, dark = swir + red, nir + green
    return safe_divide(bright - dark, bright + dark)


def log_ratio(ratio: Column) -> Column:
    return F.when(ratio > 0, F.log1p(ratio))


def clip(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def all_valid(*cols: Column) -> Column:
    out = cols[0].isNotNull()
    for c in cols[1:]:
        out = out & c.isNotNull()
    return out
