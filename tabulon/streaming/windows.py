"""Streaming extensions: the aggregates over event-time windows, and stateless text cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_blanks


def event_stream(spark: SparkSession, folder: str, schema, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def _aggregates(value: str) -> list[Column]:
    v = F.col(value)
    return [F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.avg(v).alias("avg")]


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Aggregates by key over tumbling or sliding windows; state ends when the watermark passes a window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*_aggregates(value))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "min", "max", "sum", "avg")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", keys: tuple[str, ...] = ("user_id",), ts: str = "ts", value: str = "value") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*_aggregates(value))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "min", "max", "sum", "avg")


def cleaned_stream(lines: DataFrame, text: str = "value") -> DataFrame:
    """Blanks collapsed, empty lines dropped; no state."""
    return lines.withColumn(text, collapse_blanks(F.col(text))).where(F.length(text) > 0)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
