"""Slope maps from elevation rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators.field import require_dem, slope_class
from sylva.operators.raster import in_metres
from sylva.operators.stencil import slope


def slope_map(dem: DataFrame, meta: DataFrame) -> DataFrame:
    """``raster_id, row, col, slope, slope_class`` of elevation pixels (``raster_id, row, col, v``).

    Each raster's own cell size counts, in metres also where cells are in degrees.
    Rasters of several bands are pictures, not elevations, and are refused."""
    # One value.
    require_dem(meta.agg(F.coalesce(F.max("bands"), F.lit(1)).alias("bands")).first()["bands"])
    px = in_metres(meta).select("raster_id", "px_m")
    # The rise over a cell of one metre, then over the real one.
    risen = slope(dem, 1.0).join(px, "raster_id").withColumn("slope", F.col("slope") / F.col("px_m"))
    return risen.select("raster_id", "row", "col", "slope", slope_class(F.col("slope")).alias("slope_class"))
