"""Streaming extension: observations arrive, the index stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit_stream(observations: DataFrame, gazetteer: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """observations: streaming (observation_id, ts, text). Repeats of an observation
    within the watermark count once; every match of a gazetteer surface admits its pages."""
    from ..functions import text as T

    fresh = observations.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["observation_id"])
    padded = fresh.select("observation_id", "ts", F.concat(F.lit(" "), T.normalize_surface(F.col("text")), F.lit(" ")).alias("t"))
    words = padded.withColumn("head", F.explode(F.array_distinct(F.split(F.trim("t"), " "))))
    wanted = gazetteer.withColumn("head", F.substring_index("surface", " ", 1))
    met = words.join(wanted, "head").filter(F.contains("t", F.concat(F.lit(" "), F.col("surface"), F.lit(" "))))
    return met.select("observation_id", "ts", "surface", F.explode("page_ids").alias("page_id"))


def windowed_counts(events: DataFrame, length: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Events and their value by type in tumbling windows."""
    watermarked = events.withWatermark("ts", lateness)
    return watermarked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there and stop. Each batch replaces the table at ``path`` (complete
    mode), so that a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
