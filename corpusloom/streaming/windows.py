"""Windowed reports over request and log streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.redact import redact_columns
from corpusloom.sources.readers import parse_stage_log


def requests_per_window(
    stream: DataFrame, user: str, ts: str, size: str = "60 seconds", slide: str = "10 seconds", delay: str = "10 minutes"
) -> DataFrame:
    """Requests of each user per sliding window; partial counts before the shuffle."""
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, size, slide).alias("w"), user).agg(F.count("*").alias("requests"))
    return counts.select(user, F.col("w.start").alias("window_start"), "requests")


def stage_event_stream(
    lines: DataFrame, text: str, ts: str, size: str = "5 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Counts and durations of stage events per tumbling window; rows past the watermark are dropped."""
    events = parse_stage_log(lines, text, keep=(ts,)).withWatermark(ts, delay)
    out = events.groupBy(F.window(ts, size).alias("w"), "stage").agg(
        F.count("*").alias("events"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
    )
    return out.select("stage", F.col("w.start").alias("window_start"), "events", "total_ms", "max_ms")


def soak_window_stream(
    records: DataFrame, ts: str, size: str = "300 seconds", delay: str = "10 minutes"
) -> DataFrame:
    """Request statistics of each fixed-length window of a request stream.

    Streaming percentiles are approximate; the batch soak windows are exact.
    """
    ms = F.when(F.col("success"), F.col("duration_ms"))
    out = records.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w")).agg(
        F.count("*").alias("request_count"),
        F.count_if("success").alias("success_count"),
        F.avg(ms).alias("latency_mean_ms"),
        F.max(ms).alias("latency_max_ms"),
        F.percentile_approx(ms, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 10_000).alias("_p"),
    )
    return out.select(
        F.col("w.start").alias("window_start"), "request_count", "success_count", "latency_mean_ms", "latency_max_ms",
        *[F.col("_p")[i].alias(f"latency_p{q}_ms") for i, q in enumerate((50, 95, 99))],
    )


def redaction_stream(lines: DataFrame) -> DataFrame:
    """Log records without secrets; stateless, so it runs on any stream."""
    return redact_columns(lines)
