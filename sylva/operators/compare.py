"""Change between two surveys of the same stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators.spatial import nearest_within
from sylva.session import materialize

# Fixed value: matching distance in metres.
MATCH_DISTANCE_M = 3.0


def compare_detections(old: DataFrame, new: DataFrame, d: float = MATCH_DISTANCE_M) -> DataFrame:
    """``status, fid, x, y, partner``: lost, matched (fid of old) and new points.

    Every old point asks for its one nearest new point nearer than d; of several
    that ask for the same one the lowest fid has it and the others are lost,
    with no second choice."""
    wanted = nearest_within(old, new, d).select(F.col("qid").alias("fid"), F.col("rid").alias("partner"))
    # Both sides of the answer need the claims; the search behind them runs once.
    claims = materialize(wanted.groupBy("partner").agg(F.min("fid").alias("fid")))
    olds = (
        old.select("fid", "x", "y").join(claims, "fid", "left")
        .withColumn("status", F.when(F.col("partner").isNull(), "lost").otherwise("matched"))
    )
    news = (
        new.select("fid", "x", "y").join(claims.select(F.col("partner").alias("fid")), "fid", "left_anti")
        .withColumn("partner", F.lit(None).cast("long")).withColumn("status", F.lit("new"))
    )
    cols = ["status", "fid", "x", "y", "partner"]
    return olds.select(*cols).unionByName(news.select(*cols))


def change_summary(changes: DataFrame) -> DataFrame:
    tally = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    return changes.agg(tally("lost"), tally("new"), tally("matched"))
