"""Explicit schemas of the tables that are read from files."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, optional) for n, t, optional in fields])


REQUEST_RECORDS = _schema(
    ("run_id", _S, False),
    ("request_id", _S, False),
    ("case_id", _S, False),
    ("operation", _S, False),
    ("phase", _S, False),
    ("concurrency", _I, False),
    ("request_index", _L, False),
    ("started_epoch", _D, False),
    ("completed_epoch", _D, False),
    ("duration_ms", _D, False),
    ("status_code", _I, True),
    ("success", _B, False),
    ("request_bytes", _L, False),
    ("response_bytes", _L, False),
    ("file_type", _S, True),
    ("content_origin", _S, True),
    ("fixture_size_bytes", _L, True),
    ("declared_text_units", _L, True),
    ("declared_image_count", _L, True),
    ("chunk_count", _L, True),
    ("input_tokens", _L, True),
    ("output_tokens", _L, True),
    ("error_type", _S, True),
    ("error_message", _S, True),
)

LEVEL_SUMMARIES = _schema(
    ("operation", _S, False),
    ("phase", _S, False),
    ("concurrency", _I, False),
    ("request_count", _L, False),
    ("success_count", _L, False),
    ("error_count", _L, False),
    ("error_rate", _D, False),
    ("elapsed_seconds", _D, False),
    ("throughput", _D, False),
    ("mean_ms", _D, True),
    ("min_ms", _D, True),
    ("max_ms", _D, True),
    ("total_request_bytes", _L, False),
    ("total_response_bytes", _L, False),
    ("total_input_tokens", _L, False),
    ("total_output_tokens", _L, False),
    ("p50_ms", _D, True),
    ("p95_ms", _D, True),
    ("p99_ms", _D, True),
)

EVENTS = _schema(
    ("event_id", _L, True),
    ("ts", T.TimestampNTZType(), True),
    ("user_id", _L, True),
    ("event_type", _S, True),
    ("value", _D, True),
    ("props", _S, True),
)
