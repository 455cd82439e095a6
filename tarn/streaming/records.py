"""The decoding plan over a stream: the same expressions as in batch, and windowed counts of routes and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.decode import classify


def classify_stream(records: DataFrame, message: str = "message_sanitized") -> DataFrame:
    """Records of a stream with route, supported and facts; stateless, so late records are no matter."""
    return classify(records, message)


def route_counts(records: DataFrame, time: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts of (window, route, action) by event time; records later than the watermark are left out."""
    return classify(records).withWatermark(time, late).groupBy(F.window(time, width), "route", F.col("facts.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))
