"""The run log as an append-only stream; reading it is ``run_history``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylva.functions.text import feature_of
from sylva.streaming.sampling import ALL_THERE_IS


def log_entries(status: DataFrame) -> DataFrame:
    """``ts, property, message`` changes to entries; empty messages are not logged."""
    return status.filter(F.col("message").isNotNull() & (F.col("message") != "")).select(
        "ts", feature_of(F.col("property")).alias("feature"), "message")


def history_stream(status: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """``trigger``: what ``DataStreamWriter.trigger`` takes; none: all that is there, then stop."""
    return (
        log_entries(status).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or ALL_THERE_IS)).start()
    )
