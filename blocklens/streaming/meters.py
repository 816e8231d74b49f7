"""Streaming aggregates: metering per key and hour, samples per minute, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_usage(calls: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """account, hour, units, requests of a stream of calls (account, at timestamp, units); final hours only in append mode.

    late: None if the stream has its watermark already.
    """
    return (
        (calls.withWatermark("at", late) if late else calls).groupBy("account", F.window("at", "1 hour").alias("w"))
        .agg(F.sum("units").alias("units"), F.count("*").alias("requests"))
        .select("account", F.col("w.start").alias("hour"), "units", "requests")
    )


def minute_samples(samples: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """bucket, t, executed: the last sample of every bucket of a stream of samples (t timestamp, executed)."""
    return (
        samples.withWatermark("t", late).groupBy(F.window("t", width).alias("w"))
        .agg(F.max("t").alias("t"), F.max_by("executed", "t").alias("executed"))
        .select(F.col("w.start").alias("bucket"), "t", "executed")
    )


def distinct_calls(calls: DataFrame, late: str = "2 hours") -> DataFrame:
    """Calls without repeats of an id inside the watermark: a retry counts once."""
    return calls.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
