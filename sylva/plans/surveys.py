"""Survey comparison with its summary record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.projection import utm_to_wgs84, wgs84_to_utm
from sylva.operators.compare import MATCH_DISTANCE_M, change_summary, compare_detections
from sylva.operators.field import require_different
from sylva.session import materialize
from sylva.sources.writers import job_summary


def in_crs_of(points: DataFrame, wkid: int, target: int) -> DataFrame:
    """Points of one UTM zone in another, through latitude and longitude."""
    if wkid == target:
        return points
    g = points if wkid == 4326 else points.withColumn("_g", utm_to_wgs84(F.col("x"), F.col("y"), F.lit(wkid)))
    lat, lon = (F.col("y"), F.col("x")) if wkid == 4326 else (F.col("_g.lat"), F.col("_g.lon"))
    return g.withColumn("_u", wgs84_to_utm(lat, lon, F.lit(target))).withColumn("x", F.col("_u.x")).withColumn("y", F.col("_u.y")).drop("_g", "_u")


def compare_surveys(
    old: DataFrame, new: DataFrame, d: float = MATCH_DISTANCE_M, names: tuple[str, str] = ("old", "new"),
    wkids: tuple[int, int] = (0, 0),
) -> tuple[DataFrame, DataFrame]:
    """``(changes, summary JSON)``; the new survey is read in the old one's frame."""
    require_different(*names)
    changes = materialize(compare_detections(old, in_crs_of(new, wkids[1], wkids[0]), d))
    return changes, job_summary(change_summary(changes))
