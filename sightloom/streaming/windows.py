"""Unbounded events: tumbling windows and gap sessions with watermarks, in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Per video and window: rows and kinds. events: ts (timestamp), video, kind; rows later than `late` are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "video")
    return rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds")).select("video", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "kinds")


def gap_sessions(events: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Per video and label: runs of events without a pause of `gap` or more."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "video", "kind")
    return rows.agg(F.count("*").alias("n")).select("video", "kind", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is there now to a Parquet table, each row once also after a restart."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
