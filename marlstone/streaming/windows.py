"""Event-time windows over batches and streams alike, and an idempotent streaming scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def tumbling(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, event_type, n, total for fixed windows, sliding ones with slide; late: how late rows of a stream may come."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = _timed(events, late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """One row for each user's run of events with no gap in it."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def score_stream(stream: DataFrame, score, folder: str, checkpoint: str, key: str = "id"):
    """Scores a stream into folder/batch=N; a batch that is run again replaces its own rows, and keys repeated within it count once."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
