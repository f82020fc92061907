"""Applying the replies of a vision model to candidates. Failures keep candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import parse_verdicts
from sylva.operators.numbering import number_rows

# Batch and crop sizes.
BATCH = 16
LEAST_CROP_PX = 10
CROP_MARGIN_PX = 20
CROP_MIN_HALF = 60
CROP_MAX_HALF = 400


def crop_windows(features: DataFrame, meta: DataFrame) -> DataFrame:
    """Padded pixel window of each ``fid, xmin, xmax, ymin, ymax`` extent."""
    m = features.join(meta.select("raster_id", F.col("xmin").alias("_x0"), F.col("ymax").alias("_y1"), "px_size", "width", "height"), "raster_id")
    left, right = (F.col("xmin") - F.col("_x0")) / F.col("px_size"), (F.col("xmax") - F.col("_x0")) / F.col("px_size")
    top, bottom = (F.col("_y1") - F.col("ymax")) / F.col("px_size"), (F.col("_y1") - F.col("ymin")) / F.col("px_size")
    half = lambda a, b: F.least(F.greatest((b - a) / 2 + CROP_MARGIN_PX, F.lit(float(CROP_MIN_HALF))), F.lit(float(CROP_MAX_HALF)))
    hw, hh = half(left, right), half(top, bottom)
    start = lambda c, h, size: F.greatest(F.lit(0), F.least((c - h).cast("int"), size - 1))
    placed = (
        m.withColumn("x_off", start((left + right) / 2, hw, F.col("width")))
        .withColumn("y_off", start((top + bottom) / 2, hh, F.col("height")))
    )
    return placed.select(
        "fid", "raster_id", "x_off", "y_off",
        F.least((hw * 2).cast("int"), F.col("width") - F.col("x_off")).alias("w"),
        F.least((hh * 2).cast("int"), F.col("height") - F.col("y_off")).alias("h"))


def tree_crops(trees: DataFrame, meta: DataFrame, sigma_px: int) -> DataFrame:
    """Square crop of +-max(3 sigma, 60) px round each tree, cut at the raster."""
    pad = max(int(sigma_px * 3), CROP_MIN_HALF)
    m = trees.join(meta.select("raster_id", "width", "height"), "raster_id")
    placed = m.withColumn("x_off", F.greatest(F.lit(0), F.col("px") - pad)).withColumn("y_off", F.greatest(F.lit(0), F.col("py") - pad))
    return placed.withColumn("w", F.least(F.col("width"), F.col("px") + pad) - F.col("x_off")).withColumn(
        "h", F.least(F.col("height"), F.col("py") + pad) - F.col("y_off")).drop("width", "height")


def judge(candidates: DataFrame, replies: DataFrame, batch: int = BATCH) -> DataFrame:
    """Adds ``batch, keep`` to candidates that carry a 0-based ``pos``.

    A quota failure stops the run: its batch and every later one keep all. The
    first such batch is one number, so it is fetched before the plan is built."""
    seen = replies.join(
        candidates.select(F.floor(F.col("pos") / batch).cast("int").alias("batch")).distinct(), "batch", "left_semi")
    stop = seen.filter(F.col("status") == "quota").agg(F.min("batch")).first()[0]
    placed = candidates.withColumn("batch", F.floor(F.col("pos") / batch).cast("int")).withColumn("_k", (F.col("pos") % batch + 1).cast("int"))
    usable = replies.filter(F.col("status") == "ok")
    if stop is not None:
        usable = usable.filter(F.col("batch") < stop)
    answers = usable.select("batch", F.explode(parse_verdicts(F.col("text"))).alias("_k", "_yes"))
    return placed.join(answers, ["batch", "_k"], "left").withColumn("keep", F.coalesce("_yes", F.lit(True))).drop("_k", "_yes")


def apply_verdicts(
    candidates: DataFrame, replies: DataFrame, batch: int = BATCH, crops: DataFrame | None = None,
    trees: bool = False, order: str = "fid",
) -> tuple[DataFrame, DataFrame]:
    """``(kept candidates, one-row counts)``.

    With ``crops`` (fid, w, h) candidates too small to show are not asked about:
    trees among them are dropped and not counted, regions and lines stay."""
    small = None
    asked = candidates
    if crops is not None:
        tiny = crops.filter((F.col("w") < LEAST_CROP_PX) | (F.col("h") < LEAST_CROP_PX)).select("fid")
        asked = candidates.join(tiny, "fid", "left_anti")
        small = None if trees else candidates.join(tiny, "fid", "left_semi")
    judged = judge(number_rows(asked, [order], "pos", start=0), replies, batch)
    kept = judged.filter("keep").select(*candidates.columns)
    if small is not None:
        kept = kept.unionByName(small.select(*candidates.columns))
    rejected = judged.agg(F.count_if(~F.col("keep")).alias("rejected"), F.max("batch").alias("_last"))
    failures = error_counts(replies, judged.select("batch").distinct())
    counts = rejected.withColumn("_one", F.lit(1)).join(failures.withColumn("_one", F.lit(1)), "_one").drop("_one", "_last")
    return kept, counts


def error_counts(replies: DataFrame, batches: DataFrame) -> DataFrame:
    """Failed batches up to the first quota failure, and the last message."""
    seen = replies.join(batches, "batch", "left_semi").filter(F.col("status") != "ok")
    stop = seen.filter(F.col("status") == "quota").agg(F.min("batch")).first()[0]
    if stop is not None:
        seen = seen.filter(F.col("batch") <= stop)
    return seen.agg(F.count("*").alias("api_errors"), F.coalesce(F.max_by("text", "batch"), F.lit("")).alias("last_error"))
