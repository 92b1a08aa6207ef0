"""Recordings as they arrive: the batch operators that keep no state over rows, on a stream of export files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_exports(spark: SparkSession, folder: str, schema: str, pattern: str = "*Parameters_*.txt") -> DataFrame:
    """New tab separated exports of a folder, as a stream."""
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).csv(folder)


def minute_activity(df: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Calls by minute; a minute is final once the watermark has passed it."""
    return df.withWatermark(time, late).groupBy(F.window(time, "1 minute")).agg(F.count("*").alias("n"))
