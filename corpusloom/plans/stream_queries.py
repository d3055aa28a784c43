"""Streaming jobs run to completion on the input tables, and their batch rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.plans.derived import DERIVED
from corpusloom.plans.index_queries import _META_IN, _META_SQL, _SYNC_IN, _SYNCED, scratch
from corpusloom.plans.registry import Tables, by_order, query
from corpusloom.plans.telemetry_queries import _SOAK, soak_columns
from corpusloom.plans.text_queries import _REDACT_SQL
from corpusloom.streaming import admission, callbacks, soak, upserts, windows

HALF_DAY_US = 43_200_000_000


class StreamTables(Tables):
    """The derived tables on top of the events table read as a stream."""

    def __call__(self, name: str) -> DataFrame:
        if name == "events":
            reader = self.spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", "events.parquet")
            return reader.parquet(self.sf_dir)
        return super().__call__(name)


def _finish(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available data into files, and read them back."""
    path, state = scratch(t, name), scratch(t, f"{name}-state")
    q = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


def _finish_updates(t: Tables, stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a windowed stream in update mode: open windows count too, and later updates win.

    A micro-batch adds the windows that it changed under its own number.
    """
    path = scratch(t, name)
    q = (
        stream.writeStream.foreachBatch(upserts.update_batch(path, keys))
        .option("checkpointLocation", scratch(t, f"{name}-state"))
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return upserts.latest_rows(t.spark, path, stream.schema, keys)


def _for_each(t: Tables, source: DataFrame, keys: list[str], name: str, fn) -> None:
    """Cut a table into several micro-batches by key and run ``fn`` on each."""
    files = scratch(t, f"{name}-in")
    source.repartition(4, *keys).write.parquet(files)
    stream = t.spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(files)
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", scratch(t, f"{name}-state"))
    q.trigger(availableNow=True).start().awaitTermination()


def _streams(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


_RATE = """WITH RECURSIVE q AS (SELECT event_id, user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {events}),
  r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS recent, CAST(NULL AS BIGINT) AS event_id, FALSE AS admitted FROM q
    UNION ALL SELECT user_id, rn, CASE WHEN len(keep) < 2 THEN list_append(keep, at_us) ELSE keep END, event_id, len(keep) < 2
    FROM (SELECT q.user_id, q.rn, q.event_id, q.at_us, list_filter(r.recent, lambda x: q.at_us - x <= 43200000000) AS keep FROM r JOIN q ON r.user_id = q.user_id AND q.rn = r.rn + 1))
  SELECT user_id, event_id, admitted FROM r WHERE rn > 0"""


@query("rate_limit", "X1", _RATE)
def _(t):
    requests = t("samples").select("event_id", F.col("threads").alias("user_id"), "at_us")
    out = admission.rate_limit(requests, "user_id", "at_us", "event_id", limit=2, window=HALF_DAY_US, block=14 * HALF_DAY_US)
    return out.select("user_id", "event_id", "admitted")


@query("rate_limit_stream", "X1", _RATE)
def _(t):
    stream = _streams(t)("samples").select("event_id", F.col("threads").alias("user_id"), "at_us")
    out = admission.rate_limit_stream(stream, "user_id", "at_us", "event_id", limit=2, window=HALF_DAY_US)
    return _finish(t, out, "rate").select("user_id", "event_id", "admitted")


@query(
    "requests_per_window",
    "X2",
    """WITH w AS (SELECT user_id, ts, unnest([0, 6, 12, 18]) AS back FROM {events}),
      s AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(back) AS window_start FROM w)
      SELECT user_id, window_start, count(*) AS requests FROM s GROUP BY 1, 2""",
)
def _(t):
    stream = _streams(t)("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = windows.requests_per_window(stream, "user_id", "ts", "1 day", "6 hours")
    out = _finish_updates(t, out, ["user_id", "window_start"], "pressure")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_IDEM = """WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY user_id, idempotency_key ORDER BY at_us, event_id) AS rn FROM {apply_requests} WHERE trim(idempotency_key) <> ''),
  r AS (SELECT DISTINCT user_id, idempotency_key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS held, CAST(NULL AS BIGINT) AS event_id, FALSE AS applied FROM q
    UNION ALL SELECT user_id, idempotency_key, rn, CASE WHEN ok THEN at_us ELSE held END, event_id, ok FROM (SELECT q.*, r.held, (r.held IS NULL OR r.held <= q.at_us - 43200000000) AS ok
      FROM r JOIN q ON r.user_id = q.user_id AND r.idempotency_key = q.idempotency_key AND q.rn = r.rn + 1))
  SELECT event_id, applied FROM r WHERE rn > 0 UNION ALL SELECT event_id, TRUE FROM {apply_requests} WHERE coalesce(trim(idempotency_key), '') = ''"""


@query("idempotent_apply", "X3", _IDEM)
def _(t):
    out = admission.idempotent_apply(
        t("apply_requests"), "user_id", "idempotency_key", "at_us", "event_id", ttl=HALF_DAY_US, block=14 * HALF_DAY_US
    )
    return out.select("event_id", "applied")


@query("idempotent_apply_stream", "X3", _IDEM)
def _(t):
    out = admission.idempotent_apply_stream(
        _streams(t)("apply_requests"), "user_id", "idempotency_key", "at_us", "event_id", ttl=HALF_DAY_US
    )
    return _finish(t, out, "apply").select("event_id", "applied")


@query(
    "idempotent_upload_stream",
    "X4",
    """SELECT users_idx, idempotency_key, count(*) AS kept FROM (SELECT users_idx, idempotency_key, row_number() OVER (PARTITION BY users_idx, idempotency_key ORDER BY arrival) AS n FROM {upload_batches})
       WHERE n = 1 OR idempotency_key IS NULL GROUP BY 1, 2""",
)
def _(t):
    path = scratch(t, "uploads")
    batches = t("upload_batches")
    fn = upserts.unique_upload_batch(path, batches.schema, ["users_idx", "idempotency_key"], "arrival", compact_every=2)
    _for_each(t, batches, ["arrival"], "uploads", fn)
    kept = upserts.read_log(t.spark, path, batches.schema)
    return kept.groupBy("users_idx", "idempotency_key").agg(F.count("*").alias("kept"))


@query(
    "stage_event_stream",
    "X5 S5",
    """SELECT CASE event_type WHEN 'click' THEN 'download' WHEN 'view' THEN 'document_chunking_completed' ELSE 'file_processing' END AS stage, date_trunc('day', ts)::TIMESTAMP AS window_start,
       count(*) AS events, round(sum(value), 6) AS total_ms, max(value) AS max_ms FROM {events} WHERE event_type IN ('click', 'view', 'signup') AND user_id > 0 GROUP BY 1, 2""",
)
def _(t):
    lines = _streams(t)("stage_log").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _finish_updates(t, windows.stage_event_stream(lines, "line", "ts", "1 day"), ["stage", "window_start"], "stages")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total_ms", F.round("total_ms", 6))


@query(
    "soak_window_stream",
    "X6",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS request_count, count(*) FILTER (WHERE event_type <> 'error') AS success_count,
       round(avg(value) FILTER (WHERE event_type <> 'error') + 1e-9, 6) AS latency_mean_ms, max(value) FILTER (WHERE event_type <> 'error') AS latency_max_ms
       FROM {events} GROUP BY 1""",
)
def _(t):
    records = _streams(t)("events").select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms")
    )
    out = _finish_updates(t, windows.soak_window_stream(records, "ts", "1 day"), ["window_start"], "soak")
    return out.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "request_count", "success_count",
        F.round(F.col("latency_mean_ms") + 1e-9, 6).alias("latency_mean_ms"), "latency_max_ms",
    )


# A window is over when the watermark, ten minutes behind, is ten minutes past its last request.
_CLOSED = "b + 600 < least((SELECT max(completed_epoch) FROM {records}), (SELECT max(epoch) FROM {samples})) - 600"


@query(
    "soak_case_stream",
    "X6 M12",
    f"""WITH {_SOAK} SELECT case_id, window_index, request_count, success_count, round(error_rate, 6) AS error_rate, round(throughput, 6) AS throughput, round(latency_mean_ms + 1e-9, 6) AS latency_mean_ms,
      round(latency_p95_ms, 6) AS latency_p95_ms, resource_sample_count, round(rss_mean + 1e-9, 4) AS rss_mean, round(rss_p95 + 1e-9, 4) AS rss_p95, round(vram_p95 + 1e-9, 4) AS vram_p95, thread_max, handle_max FROM k WHERE {_CLOSED}""",
)
def _(t):
    out = _finish(t, soak.soak_case_stream(_streams(t)("records"), _streams(t)("samples")), "soak-cases")
    return soak_columns(out.withColumns({c: F.col(c).cast("long") for c in ("thread_max", "handle_max")}))


@query("versioned_chunk_stream", "X7 L13", _SYNCED)
def _(t):
    path = scratch(t, "sync")
    dealt, n = by_order(t)
    base = dealt("chunks").select("file_idx", F.col("index_version").cast("long").alias("index_version"), "chunk_index", "chunk_id")
    fn = upserts.versioned_chunk_batch(base, path, scratch(t, "outcomes"), compact_every=2, partitions=n)
    _for_each(t, t.sql(_SYNC_IN), ["file_idx"], "sync", fn)
    return upserts.chunk_state(base, path, n)


@query("versioned_metadata_stream", "X8 L15", _META_SQL)
def _(t):
    path = scratch(t, "metadata")
    base = t("file_metadata").select("file_idx", "summary", "extraction_status", "index_version")
    dealt, n = by_order(t)
    incoming = dealt.sql(_META_IN).groupBy("file_idx", "seq").agg(*[F.first(c).alias(c) for c in ("success", "index_version", "summary")])
    _for_each(t, incoming, ["file_idx"], "metadata", upserts.metadata_batch(base, path, compact_every=2, partitions=n))
    return upserts.metadata_state(base, path, ["summary"], T.StructType(list(incoming.schema.fields)), n)


@query(
    "redaction_stream",
    "X9 N10 N11",
    f"SELECT line_id, {_REDACT_SQL} AS value, '[REDACTED]' AS api_token FROM {{log_lines}}",
)
def _(t):
    lines = _streams(t).sql(DERIVED["log_lines"]).select("line_id", "value", F.col("value").alias("prompt"), F.col("value").alias("api-token"))
    return _finish(t, windows.redaction_stream(lines.withColumnRenamed("api-token", "api_token")), "redact")


_LATE = """WITH h AS (SELECT job_id, epoch_us(ts) // 1000 AS a FROM {callback_events} WHERE kind = 'handoff'), c AS (SELECT job_id, epoch_us(ts) // 1000 AS z FROM {callback_events} WHERE kind = 'completed')
  SELECT h.job_id, a AS handed_off_ms FROM h LEFT JOIN c ON h.job_id = c.job_id WHERE (z IS NULL OR z > a + 600000)"""


@query("callback_timeouts", "X10", _LATE)
def _(t):
    at = t.sql("SELECT job_id, kind, CAST(floor(EPOCH_US(ts) / 1000) AS BIGINT) AS at_ms FROM {callback_events}")
    return callbacks.callback_timeouts(at, "at_ms")


@query(
    "callback_timeout_stream",
    "X10",
    _LATE + " AND (z IS NOT NULL OR a + 600000 <= (SELECT max(epoch_us(ts) // 1000) - 60000 FROM {callback_events}))",
)
def _(t):
    stream = _streams(t).sql(DERIVED["callback_events"]).withColumn("ts", F.col("ts").cast("timestamp"))
    return _finish(t, callbacks.callback_timeout_stream(stream, "ts"), "callbacks")
