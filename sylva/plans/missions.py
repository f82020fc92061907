"""Coverage and corridor missions for many blocks, with parts and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.projection import utm_to_wgs84
from sylva.operators.field import require_projected
from sylva.operators.mission import MULTI_START_RUNS, budget_cuts, corridor_points, coverage_points, cross_hatch, place_parts, timed
from sylva.session import materialize, meet


def _finish(points: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waypoints with parts, and one row of totals per plan.

    Blocks that name their coordinate system (``wkid``) need a projected one."""
    if "wkid" in blocks.columns:
        wrong = F.col("wkid").isNull() | (F.col("wkid") == 4326)
        stop = F.raise_error(F.lit("distances need a projected coordinate system")).cast(blocks.schema["speed"].dataType)
        blocks = blocks.withColumn("speed", F.when(wrong, stop).otherwise(F.col("speed")))
    settings = blocks.select("fid", "altitude", "speed", "minutes")
    flown = materialize(timed(meet(points, settings, "fid", unique=True)))
    cuts = materialize(budget_cuts(flown))
    waypoints = meet(place_parts(flown, cuts).drop("seq"), settings.select("fid", "altitude", "speed"), "fid", unique=True)
    made = cuts.groupBy("fid").agg(F.count("*").alias("_cuts"))
    metres = F.sum("leg")
    totals = (
        flown.groupBy("fid").agg(
            metres.alias("total_distance_m"), F.when(F.max("speed") > 0, metres / F.max("speed") / 60.0).otherwise(0.0).alias("total_minutes"),
            F.max("off_polygon_legs").alias("off_polygon_legs"), F.count("*").alias("_n"))
        .join(made.hint("shuffle_hash"), "fid", "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(0)))
        .withColumn("parts", (F.col("_cuts") + 1).cast("int")).withColumn("waypoints", F.col("_n") + F.col("_cuts")).drop("_n", "_cuts")
    )
    return waypoints, totals


_SUMS = ("total_distance_m", "total_minutes", "off_polygon_legs", "parts", "waypoints")


def coverage_plan(blocks: DataFrame, crosshatch: bool = False, multi_start: int = MULTI_START_RUNS) -> tuple[DataFrame, DataFrame]:
    """``(waypoints, plans)``: waypoints ``fid, part, sequence, x, y, altitude,
    speed``; plans with parts, waypoints, distance, minutes, legs outside the area.

    ``multi_start``: up to how many runs a block's order is searched from every
    run. A block without any waypoint has no plan row; ``coverage_failure`` says why."""
    waypoints, totals = _finish(coverage_points(blocks, multi_start), blocks)
    if crosshatch:
        turned = blocks.withColumn("direction", F.col("direction") + 90)
        more, more_totals = _finish(coverage_points(turned, multi_start), turned)
        waypoints = cross_hatch(waypoints, more)
        totals = totals.unionByName(more_totals).groupBy("fid").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return waypoints, totals


def corridor_plan(blocks: DataFrame, multi_start: int = MULTI_START_RUNS) -> tuple[DataFrame, DataFrame]:
    """The same for blocks that also carry a centre line ``path``."""
    return _finish(corridor_points(blocks, multi_start), blocks)


def to_wgs84(waypoints: DataFrame, wkid: int) -> DataFrame:
    """Adds ``lat, lon`` for the mission files."""
    require_projected(wkid)
    return waypoints.withColumn("_g", utm_to_wgs84(F.col("x"), F.col("y"), F.lit(wkid))).withColumn("lat", F.col("_g.lat")).withColumn("lon", F.col("_g.lon")).drop("_g")
