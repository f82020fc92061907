"""Pixel values under points, for tables and for request streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylva.functions.bands import pixel_col, pixel_row
from sylva.sources.writers import sample_layer

ALL_THERE_IS = {"availableNow": True}


def sample_pixels(points: DataFrame, pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds ``px_r, px_g, px_b`` of the pixel under each ``raster_id, x, y``; null
    outside. A single band answers for all three, a second leaves blue at 0."""
    placed = (
        points.join(meta.select("raster_id", "xmin", "ymax", "px_size", "width", "height"), "raster_id", "left")
        .withColumn("_col", pixel_col(F.col("x"), F.col("xmin"), F.col("px_size")))
        .withColumn("_row", pixel_row(F.col("y"), F.col("ymax"), F.col("px_size")))
    )
    on_raster = F.col("_col").between(0, F.col("width") - 1) & F.col("_row").between(0, F.col("height") - 1)
    placed = placed.withColumn("_row", F.when(on_raster, F.col("_row"))).drop("xmin", "ymax", "px_size", "width", "height")
    g = F.col("g") if "g" in pixels.columns else F.lit(None)
    b = F.col("b") if "b" in pixels.columns else F.lit(None)
    r = F.col("r").cast("int")
    values = pixels.select(
        "raster_id", F.col("row").alias("_row"), F.col("col").alias("_col"), r.alias("px_r"),
        F.coalesce(g.cast("int"), r).alias("px_g"),
        F.when(g.isNull(), r).otherwise(F.coalesce(b.cast("int"), F.lit(0))).alias("px_b"))
    return placed.join(values, ["raster_id", "_row", "_col"], "left").drop("_row", "_col")


def sample_replies(requests: DataFrame, pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """``raster_id, line`` requests to ``reply``: ``r,g,b``, NODATA or ERROR.

    The same function serves a batch table and a stream: pixels are the static
    side, no state is kept, and a bad line only spoils its own reply. Blank
    lines get no reply."""
    fields = F.split(F.trim("line"), ",")
    number = lambda i: F.get(fields, F.lit(i)).try_cast("double")
    asked = (
        requests.filter(F.trim("line") != "").withColumn("x", number(0)).withColumn("y", number(1))
        .withColumn("_ok", (F.size(fields) == 2) & F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    seen = sample_pixels(asked, pixels, meta)
    reply = (
        F.when(~F.col("_ok"), F.lit("ERROR")).when(F.col("px_r").isNull(), F.lit("NODATA"))
        .otherwise(F.concat_ws(",", "px_r", "px_g", "px_b"))
    )
    return seen.withColumn("reply", reply).select(*requests.columns, "reply")


def sample_stream(requests: DataFrame, pixels: DataFrame, meta: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Replies as they are asked for. ``trigger``: what ``DataStreamWriter.trigger``
    takes; none: all that is there, then stop."""
    return (
        sample_replies(requests, pixels, meta).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or ALL_THERE_IS)).start()
    )


def click_samples(clicks: DataFrame, pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Clicks ``raster_id, x, y, cls`` that hit a pixel, as samples."""
    hit = sample_pixels(clicks, pixels, meta).filter(F.col("px_r").isNotNull())
    return hit.select("x", "y", F.col("px_r").alias("r"), F.col("px_g").alias("g"), F.col("px_b").alias("b"),
                      (2.0 * F.col("px_g") - F.col("px_r") - F.col("px_b")).alias("exg"), "cls")


def collect_samples(clicks: DataFrame, pixels: DataFrame, meta: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Buffer clicks until the stream stops, then write the sample layer.

    A batch is written under its own id, so a repeated batch replaces itself."""
    def flush(batch: DataFrame, batch_id: int) -> None:
        sample_layer(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return (
        click_samples(clicks, pixels, meta).writeStream.foreachBatch(flush)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or ALL_THERE_IS)).start()
    )
