"""Rasters, field tables and photo metadata as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators.field import require_bands
from sylva.operators.raster import BANDS, GROUP_TILES, read_window, tiles_of_window, to_pixels
from sylva.session import materialize

# Table names tried in this order.
CRUISE_TABLES = ("TREE DATA", "DATA POHON")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON or Parquet by extension."""
    lower = path.lower()
    if lower.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if lower.endswith(".json"):
        return spark.read.json(path)
    return spark.read.parquet(path)


def read_raster(spark: SparkSession, path: str, meta: DataFrame | None = None) -> DataFrame:
    """A pixel table or a tile table as pixels; needs r, g and b."""
    df = read_table(spark, path)
    bands = [c for c in ("r", "g", "b", "alpha") if c in df.columns]
    require_bands(len([b for b in bands if b != "alpha"]))
    if "tile_row" in df.columns:
        df = to_pixels(df, bands)
    if "alpha" not in df.columns:
        df = df.withColumn("alpha", F.lit(None).cast("double"))
    if meta is not None:
        df = df.join(meta.select("raster_id"), "raster_id", "left_semi")
    return df


def read_raster_window(
    spark: SparkSession, path: str, x0: int, y0: int, w: int, h: int, size: int = 256, group: int = GROUP_TILES,
) -> DataFrame:
    """The pixels of a window from a table that ``write_raster`` wrote with this tile and group size.

    Only folders of tile groups that meet the window are listed and only its tiles
    are unpacked; tile numbers are sorted in the files, so other row groups are skipped."""
    tiles = tiles_of_window(spark.read.parquet(path), x0, y0, w, h, size, group)
    return read_window(to_pixels(tiles, [c for c in BANDS if c in tiles.columns]), x0, y0, w, h)


def raster_meta(pixels: DataFrame, xmin: float, ymax: float, px_size: float, wkid: int, bands: int = 3) -> DataFrame:
    """One row per raster, sized from its pixels.

    Written out, so that Spark knows how small it is when it plans the joins."""
    return materialize(pixels.groupBy("raster_id").agg(
        F.lit(xmin).alias("xmin"), F.lit(ymax).alias("ymax"), F.lit(px_size).alias("px_size"),
        (F.max("col") + 1).cast("int").alias("width"), (F.max("row") + 1).cast("int").alias("height"),
        F.lit(bands).alias("bands"), F.lit(wkid).alias("wkid")))


def cruise_points(table: DataFrame, wkid: int) -> DataFrame:
    """X and Y as doubles plus the chosen coordinate system."""
    return table.withColumn("X", F.col("X").try_cast("double")).withColumn("Y", F.col("Y").try_cast("double")).withColumn("wkid", F.lit(wkid))


def read_cruise(spark: SparkSession, folder: str, wkid: int, extension: str = "csv") -> DataFrame:
    """The first table of the known names that can be read."""
    failure: Exception | None = None
    for name in CRUISE_TABLES:
        try:
            return cruise_points(read_table(spark, f"{folder}/{name}.{extension}"), wkid)
        except AnalysisException as e:
            failure = e
    raise FileNotFoundError(f"no table named {' or '.join(CRUISE_TABLES)} in {folder}") from failure


def read_photo_points(photos: DataFrame) -> DataFrame:
    """Photos with a position as points (x = longitude, y = latitude)."""
    return photos.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("x", F.col("lon")).withColumn("y", F.col("lat"))


def require_photo_points(photos: DataFrame) -> DataFrame:
    points = read_photo_points(photos)
    if points.isEmpty():
        raise ValueError("none of the photos has a GPS position")
    return points
