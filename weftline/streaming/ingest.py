"""Transcript lines as a stream: the batch parser on files as they come, with late-data counts per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.transcripts import parsed

LINES = "source_file STRING, source_line INT, line STRING, arrived TIMESTAMP"


def line_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Parsed lines from the Parquet files of a folder as they appear."""
    raw = spark.readStream.schema(LINES).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return parsed(raw)


def counts_by_window(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, matched, lines) by arrival time; lines later than the watermark are left out of windows that are closed."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", width), "matched").agg(F.count(F.lit(1)).alias("lines"))


def first_copies(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each line of a file once, as far back as the watermark reaches."""
    return stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["source_file", "source_line"])
