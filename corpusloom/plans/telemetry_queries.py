"""Telemetry summaries, boundaries, drift and joins over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import telemetry as tm
from corpusloom.operators.percentiles import exact_percentiles
from corpusloom.plans.registry import Tables, query

DAY_US = 86_400_000_000


def _round(df, digits: int = 6):
    """Doubles rounded, so that the order of a sum does not show.

    Means can lie exactly between two rounded values; they are nudged off that point.
    """
    nudge = {c: 1e-9 if "mean" in c else 0.0 for c in df.columns}
    return df.select(
        *[F.round(F.col(c) + nudge[c], digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _r(expr: str, name: str) -> str:
    return f"round({expr}{' + 1e-9' if 'mean' in name else ''}, 6) AS {name}"


@query(
    "percentiles",
    "M1",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
       min(value) AS p0, max(value) AS p100 FROM {events} GROUP BY 1""",
)
def _(t):
    p = {"p50": 50, "p95": 95, "p99": 99, "p0": 0, "p100": 100}
    return _round(exact_percentiles(t("events"), ["event_type"], "value", p))


@query(
    "overall_percentiles",
    "M1",
    "SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM {lineitem}",
)
def _(t):
    return _round(exact_percentiles(t("lineitem"), [], "l_extendedprice", {"p50": 50, "p999": 99.9}))


_LEVELS = """l AS (SELECT operation, phase, concurrency, count(*) AS request_count, count(*) FILTER (WHERE success) AS success_count, count(*) FILTER (WHERE NOT success) AS error_count,
   count(*) FILTER (WHERE NOT success) / count(*) AS error_rate, greatest(max(completed_epoch) - min(started_epoch), 1e-9) AS elapsed_seconds,
   count(*) FILTER (WHERE success) / greatest(max(completed_epoch) - min(started_epoch), 1e-9) AS throughput, avg(duration_ms) FILTER (WHERE success) AS mean_ms,
   min(duration_ms) FILTER (WHERE success) AS min_ms, max(duration_ms) FILTER (WHERE success) AS max_ms,
   quantile_cont(duration_ms, 0.5) FILTER (WHERE success) AS p50_ms, quantile_cont(duration_ms, 0.95) FILTER (WHERE success) AS p95_ms, quantile_cont(duration_ms, 0.99) FILTER (WHERE success) AS p99_ms,
   CAST(sum(request_bytes) AS BIGINT) AS total_request_bytes, CAST(sum(response_bytes) AS BIGINT) AS total_response_bytes,
   CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens
  FROM {records} GROUP BY ALL)"""
_ROUNDED = "error_rate elapsed_seconds throughput mean_ms min_ms max_ms p50_ms p95_ms p99_ms".split()


@query(
    "summarize_level",
    "M2 M20",
    f"WITH {_LEVELS} SELECT * REPLACE ({', '.join(_r(c, c) for c in _ROUNDED)}) FROM l",
)
def _(t):
    return _round(tm.summarize_level(t("records")))


@query(
    "detect_saturation",
    "M3 M4",
    f"""WITH {_LEVELS}, g AS (SELECT *, lag(concurrency) OVER w AS previous_concurrency, (throughput - lag(throughput) OVER w) / lag(throughput) OVER w * 100 AS gain,
        (p95_ms - lag(p95_ms) OVER w) / lag(p95_ms) OVER w * 100 AS growth FROM l WHERE phase = 'concurrency' WINDOW w AS (PARTITION BY operation ORDER BY concurrency)),
      f AS (SELECT *, CASE WHEN error_rate > 0.3 THEN 'error_rate_exceeded' WHEN gain <= 5 AND growth >= 2 THEN 'throughput_plateau_with_latency_growth' END AS reason FROM g)
      SELECT operation, concurrency, reason, previous_concurrency, CASE WHEN error_rate <= 0.3 THEN round(gain, 6) END AS throughput_gain_percent,
        CASE WHEN error_rate <= 0.3 THEN round(growth, 6) END AS p95_growth_percent, round(error_rate, 6) AS error_rate
      FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY concurrency) AS n FROM f WHERE reason IS NOT NULL) WHERE n = 1""",
)
def _(t):
    levels = tm.summarize_level(t("records")).where("phase = 'concurrency'")
    return _round(tm.detect_saturation(levels, tm.SaturationPolicy(0.3, 5.0, 2.0)))


_STAGES = """b AS (SELECT stage_id, count(*) AS request_count, count(*) FILTER (WHERE success) AS success_count, count(*) FILTER (WHERE success AND duration_ms <= 30) AS sla_success_count,
    count(*) FILTER (WHERE NOT success) AS error_count, quantile_cont(duration_ms, 0.95) FILTER (WHERE success) AS latency_p95_ms, quantile_cont(duration_ms, 0.9) FILTER (WHERE success) AS latency_p90_ms,
    arg_min(coalesce(error_type, 'http_' || status_code), request_index) FILTER (WHERE NOT success) AS first_error_type FROM {records} GROUP BY 1),
  x AS (SELECT s.stage_id, count(*) AS sample_count, max(system_memory_percent) AS mem, max(gpu_memory_percent) AS gpu, max(target_rss_bytes) AS rss
    FROM {stages} s JOIN {samples} m ON m.at_us BETWEEN s.start_us AND s.end_us GROUP BY 1),
  s AS (SELECT s.*, b.* EXCLUDE (stage_id), x.* EXCLUDE (stage_id), error_count / request_count AS error_rate, success_count / greatest((end_us - start_us) / 1e6, 1e-9) AS throughput,
      CASE WHEN error_count / request_count > 0.14 THEN 'error_rate_exceeded' WHEN latency_p95_ms > 58.5 THEN 'p95_latency_exceeded' WHEN mem >= 85 THEN 'system_memory_guard_triggered' WHEN gpu >= 45 THEN 'gpu_memory_guard_triggered' END AS stop_reason
    FROM {stages} s JOIN b ON s.stage_id = b.stage_id JOIN x ON s.stage_id = x.stage_id),
  v AS (SELECT *, CASE WHEN stop_reason LIKE '%guard%' THEN 'stopped' WHEN stop_reason IS NOT NULL THEN 'failed' WHEN success_count > sla_success_count OR error_rate > 0 THEN 'degraded' ELSE 'passed' END AS status FROM s)"""


def _stages(t: Tables):
    policy = tm.StopPolicy(max_error_rate=0.14, max_p95_ms=58.5, max_memory_percent=85.0, max_gpu_memory_percent=45.0)
    return tm.summarize_stage(t("stages"), t("records"), t("samples"), 30.0, DAY_US, policy)


@query(
    "summarize_stage",
    "M5 M6 M7 M8",
    f"""WITH {_STAGES} SELECT stage_id, request_count, success_count, sla_success_count, error_count, round(error_rate, 6) AS error_rate, round(throughput, 6) AS throughput,
      round(latency_p90_ms, 6) AS latency_p90_ms, round(latency_p95_ms, 6) AS latency_p95_ms, first_error_type, sample_count, round(mem, 6) AS system_memory_percent_max, rss AS target_rss_bytes_max, stop_reason, status FROM v""",
)
def _(t):
    names = """stage_id request_count success_count sla_success_count error_count error_rate throughput latency_p90_ms latency_p95_ms
        first_error_type sample_count system_memory_percent_max target_rss_bytes_max stop_reason status"""
    return _round(_stages(t).select(*names.split()))


@query(
    "capacity_boundaries",
    "M9",
    f"""WITH {_STAGES}, u AS (SELECT * FROM v WHERE mode IN ('ramp', 'burst')), r AS (SELECT *, max(CASE WHEN mode = 'ramp' THEN 1 ELSE 0 END) OVER (PARTITION BY operation) AS has FROM u),
      o AS (SELECT *, sum(CASE WHEN status IN ('failed', 'stopped') THEN 1 ELSE 0 END) OVER (PARTITION BY operation ORDER BY concurrency, sequence) AS fails FROM r WHERE has = 0 OR mode = 'ramp')
      SELECT operation, max(concurrency) FILTER (WHERE fails = 0) AS normal_maximum_concurrency, min(concurrency) FILTER (WHERE fails > 0) AS first_failure_concurrency,
        arg_min(stage_id, concurrency) FILTER (WHERE fails > 0) AS first_failure_stage_id, arg_min(coalesce(stop_reason, first_error_type, status), concurrency) FILTER (WHERE fails > 0) AS first_failure_reason,
        max(fails) = 0 AS upper_bound_censored, count(*) AS evidence_count FROM o GROUP BY 1""",
)
def _(t):
    return tm.capacity_boundaries(_stages(t))


@query(
    "concurrency_boundary",
    "M10",
    f"""WITH {_LEVELS}, o AS (SELECT *, max(error_rate > 0.2) OVER (PARTITION BY operation ORDER BY concurrency) AS failed FROM l WHERE phase = 'concurrency')
      SELECT operation, max(concurrency) FILTER (WHERE NOT failed) AS normal_maximum_value, min(concurrency) FILTER (WHERE failed) AS first_failure_value,
        CASE WHEN bool_or(failed) THEN 'error_rate_exceeded' END AS first_failure_reason, NOT bool_or(failed) AS upper_bound_censored, count(*) AS evidence_count FROM o GROUP BY 1""",
)
def _(t):
    return tm.concurrency_boundary(tm.summarize_level(t("records")), 0.2)


@query(
    "numeric_boundary",
    "M11",
    """WITH e AS (SELECT 'ingest:' || coalesce(file_type, 'unknown') || ':' || coalesce(content_origin, 'unknown') AS operation, success, error_type, request_index, unnest([
         {'d': 'fixture_size_bytes', 'v': fixture_size_bytes}, {'d': 'declared_text_units', 'v': declared_text_units}, {'d': 'declared_image_count', 'v': declared_image_count}, {'d': 'chunk_count', 'v': chunk_count}]) AS x
        FROM {records} WHERE operation = 'ingest'),
      o AS (SELECT *, max(NOT success) OVER (PARTITION BY operation, x.d ORDER BY x.v, request_index) AS failed FROM e WHERE x.v IS NOT NULL)
      SELECT x.d AS dimension, operation, max(x.v) FILTER (WHERE NOT failed) AS normal_maximum_value, min(x.v) FILTER (WHERE failed) AS first_failure_value,
        arg_min(coalesce(error_type, 'request_failed'), struct_pack(v := x.v, i := request_index)) FILTER (WHERE failed) AS first_failure_reason, NOT bool_or(failed) AS upper_bound_censored, count(*) AS evidence_count
      FROM o GROUP BY 1, 2""",
)
def _(t):
    return tm.numeric_boundary(t("records"))


_SOAK = """w AS (SELECT case_id, min(started_epoch) AS a, max(completed_epoch) AS b, count(*) AS request_count, count(*) FILTER (WHERE success) AS success_count, avg(duration_ms) FILTER (WHERE success) AS latency_mean_ms,
    quantile_cont(duration_ms, 0.95) FILTER (WHERE success) AS latency_p95_ms FROM {records} GROUP BY 1),
  m AS (SELECT w.case_id, count(*) AS resource_sample_count, avg(target_rss_bytes) AS rss_mean, quantile_cont(target_rss_bytes::DOUBLE, 0.95) AS rss_p95, quantile_cont(target_gpu_bytes::DOUBLE, 0.95) AS vram_p95,
    max(threads) AS thread_max, max(handles) AS handle_max FROM w JOIN {samples} s ON s.case_id = w.case_id AND epoch BETWEEN a AND b GROUP BY 1),
  k AS (SELECT w.*, m.* EXCLUDE (case_id), CAST(replace(w.case_id, 'soak-window-', '') AS INTEGER) AS window_index, (request_count - success_count) / request_count AS error_rate, success_count / greatest(b - a, 1e-9) AS throughput FROM w LEFT JOIN m ON w.case_id = m.case_id)"""


@query(
    "soak_windows",
    "M12",
    f"""WITH {_SOAK} SELECT case_id, window_index, request_count, success_count, round(error_rate, 6) AS error_rate, round(throughput, 6) AS throughput, round(latency_mean_ms + 1e-9, 6) AS latency_mean_ms,
      round(latency_p95_ms, 6) AS latency_p95_ms, resource_sample_count, round(rss_mean + 1e-9, 4) AS rss_mean, round(rss_p95 + 1e-9, 4) AS rss_p95, round(vram_p95 + 1e-9, 4) AS vram_p95, thread_max, handle_max FROM k""",
)
def _(t):
    return soak_columns(tm.soak_windows(t("records"), t("samples")))


def soak_columns(w):
    """The columns of the twin, rounded like there."""
    w = w.select(
        "case_id", "window_index", "request_count", "success_count", "error_rate", "throughput", "latency_mean_ms", "latency_p95_ms",
        "resource_sample_count", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("rss_mean", "rss_p95", "vram_p95")], "thread_max", "handle_max",
    )
    return _round(w)


def _growth(c: str) -> str:
    return f"(max({c}) FILTER (WHERE z) - max({c}) FILTER (WHERE a1)) / max({c}) FILTER (WHERE a1) * 100"


@query(
    "soak_drift",
    "M13 M4",
    f"""WITH {_SOAK}, e AS (SELECT *, window_index = min(window_index) OVER () AS a1, window_index = max(window_index) OVER () AS z FROM k),
      d AS (SELECT count(*) AS window_count, min(window_index) AS first_window_index, max(window_index) AS last_window_index, {_growth("latency_p95_ms")} AS latency_p95_growth_percent,
        {_growth("rss_p95")} AS rss_p95_growth_percent, {_growth("vram_p95")} AS vram_p95_growth_percent,
        max(thread_max) FILTER (WHERE z) - max(thread_max) FILTER (WHERE a1) AS thread_max_growth, max(handle_max) FILTER (WHERE z) - max(handle_max) FILTER (WHERE a1) AS handle_max_growth FROM e)
      SELECT window_count, first_window_index, last_window_index, round(latency_p95_growth_percent, 6) AS latency_p95_growth_percent, round(rss_p95_growth_percent, 6) AS rss_p95_growth_percent,
        round(vram_p95_growth_percent, 6) AS vram_p95_growth_percent, thread_max_growth, handle_max_growth, latency_p95_growth_percent >= 20 AS latency_candidate, rss_p95_growth_percent >= 15 AS rss_candidate,
        vram_p95_growth_percent >= 15 AS vram_candidate, thread_max_growth >= 5 AS thread_candidate, handle_max_growth >= 100 AS handle_candidate,
        latency_p95_growth_percent >= 20 OR rss_p95_growth_percent >= 15 OR vram_p95_growth_percent >= 15 OR thread_max_growth >= 5 OR handle_max_growth >= 100 AS any_candidate FROM d""",
)
def _(t):
    return _round(tm.soak_drift(tm.soak_windows(t("records"), t("samples"))))


@query(
    "classify_failures",
    "M14",
    """SELECT request_id, CASE WHEN error_type = 'ReadTimeout' THEN 'timeout' WHEN file_type = 'pdf' THEN 'oom' ELSE 'external_service' END AS category,
       CASE WHEN error_type = 'ReadTimeout' THEN 'request_timeout' WHEN file_type = 'pdf' THEN 'oom' ELSE 'external_service_failure' END AS condition, operation, error_type, status_code, duration_ms
       FROM {records} WHERE NOT success AND error_type IS NOT NULL""",
)
def _(t):
    return tm.classify_failures(t("records"))


@query(
    "scan_log_markers",
    "M15",
    """SELECT * FROM (SELECT 'cuda out of memory' AS token, 'oom' AS category, 'cuda_oom' AS condition, count(*) AS line_count FROM {log_lines} WHERE lower(value) LIKE '%cuda out of memory%'
       UNION ALL SELECT 'connection refused', 'external_service', 'connection_refused', count(*) FROM {log_lines} WHERE lower(value) LIKE '%connection refused%') WHERE line_count > 0""",
)
def _(t):
    return tm.scan_log_markers(t("log_lines"))


@query(
    "summarize_resources",
    "M16",
    "SELECT operation, phase, concurrency, case_id, count(*) AS sample_count, "
    + ", ".join(f"round(avg({m}::DOUBLE) + 1e-9, 6) AS {m}_mean, round(max({m}::DOUBLE), 6) AS {m}_max" for m in tm.RESOURCE_METRICS)
    + " FROM {samples} WHERE operation <> 'idle' GROUP BY ALL",
)
def _(t):
    return _round(tm.summarize_resources(t("samples")))


@query(
    "stage_resources",
    "M17",
    """SELECT s.event_id, s.file_idx, f.c_mktsegment AS profile_name, count(m.event_id) AS sample_count, round(avg(m.system_memory_percent) + 1e-9, 6) AS system_memory_percent_mean, round(max(m.system_memory_percent), 6) AS system_memory_percent_max,
       round(avg(m.target_rss_bytes) + 1e-9, 4) AS target_rss_bytes_mean, max(m.target_rss_bytes) AS target_rss_bytes_max
       FROM {stage_spans} s LEFT JOIN {samples} m ON m.at_us BETWEEN s.start_us AND s.end_us LEFT JOIN {customer} f ON s.file_idx = f.c_custkey GROUP BY 1, 2, 3""",
)
def _(t):
    fixtures = t("customer").select(F.col("c_custkey").alias("file_idx"), F.col("c_mktsegment").alias("profile_name"))
    out = tm.stage_resources(t("stage_spans"), t("samples"), fixtures, ["system_memory_percent", "target_rss_bytes"], DAY_US)
    out = out.select(
        "event_id", "file_idx", "profile_name", "sample_count", "system_memory_percent_mean", "system_memory_percent_max",
        F.round(F.col("target_rss_bytes_mean") + 1e-9, 4).alias("target_rss_bytes_mean"), "target_rss_bytes_max",
    )
    return _round(out)


@query(
    "counter_deltas",
    "M18",
    """SELECT event_id, CASE WHEN target_gpu_bytes >= lag(target_gpu_bytes) OVER w THEN target_gpu_bytes - lag(target_gpu_bytes) OVER w END AS target_gpu_bytes_delta,
       CASE WHEN threads >= lag(threads) OVER w THEN threads - lag(threads) OVER w END AS threads_delta FROM {samples} WINDOW w AS (PARTITION BY operation ORDER BY at_us)""",
)
def _(t):
    s = t("samples").select("event_id", "operation", "at_us", "target_gpu_bytes", "threads")
    out = tm.counter_deltas(s, ["operation"], "at_us", ["target_gpu_bytes", "threads"], F.floor(F.col("at_us") / DAY_US))
    return out.select("event_id", "target_gpu_bytes_delta", "threads_delta")


@query(
    "cpu_percent",
    "M19",
    """WITH s AS (SELECT DISTINCT target, sampled_at FROM {cpu_times}), p AS (SELECT *, lag(sampled_at) OVER (PARTITION BY target ORDER BY sampled_at) AS prev FROM s)
      SELECT p.target, p.sampled_at, round(CASE WHEN any_value(prev) IS NULL THEN 0 ELSE coalesce(sum(CASE WHEN b.cpu_time IS NOT NULL THEN greatest(c.cpu_time - b.cpu_time, 0) END), 0) / (p.sampled_at - any_value(prev)) * 100 END, 6) AS cpu_percent
      FROM p JOIN {cpu_times} c ON c.target = p.target AND c.sampled_at = p.sampled_at LEFT JOIN {cpu_times} b ON b.target = p.target AND b.sampled_at = p.prev AND b.pid = c.pid GROUP BY 1, 2""",
)
def _(t):
    return _round(tm.cpu_percent(t("cpu_times"), "target", F.floor(F.col("sampled_at") / 168)))


@query(
    "run_summary",
    "M21",
    """SELECT count(*) AS request_count, count(*) FILTER (WHERE success) AS success_count, count(*) FILTER (WHERE NOT success) AS failure_count,
       (SELECT count(*) FROM {stages}) AS stage_count, (SELECT count(*) FROM {samples}) AS sample_count FROM {records}""",
)
def _(t):
    return tm.run_summary(t("records"), t("stages"), t("samples"))


@query("slow_stages", "M22", "SELECT event_id, value >= 30.5 AS is_slow FROM {events}")
def _(t):
    return t("events").select("event_id", tm.is_slow_stage(F.col("value"), 30.5).alias("is_slow"))


@query(
    "log_volume",
    "M23",
    """WITH w AS (SELECT dayofweek(ts) AS workload, CASE WHEN user_id < 50 THEN 'legacy' WHEN user_id < 100 THEN 'json' ELSE 'console' END AS mode, value, user_id AS duration_ms FROM {log_lines}),
      v AS (SELECT workload, mode, CAST(sum(length(value) - length(replace(value, chr(10), ''))) AS BIGINT) AS line_count, CAST(sum(strlen(value)) AS BIGINT) AS byte_count, count(*) AS write_count, quantile_cont(duration_ms::DOUBLE, 0.5) AS median_ms FROM w GROUP BY 1, 2)
      SELECT v.workload, v.mode, v.line_count, v.byte_count, v.write_count, round(v.median_ms, 6) AS median_ms, round((v.line_count - b.line_count) / b.line_count * 100, 6) AS line_change_percent,
        round((v.byte_count - b.byte_count) / b.byte_count * 100, 6) AS byte_change_percent, round(v.median_ms / nullif(b.median_ms, 0), 6) AS time_ratio
      FROM v JOIN v b ON v.workload = b.workload AND b.mode = 'legacy'""",
)
def _(t):
    u = F.col("user_id")
    writes = t("log_lines").select(
        (F.dayofweek("ts") - 1).alias("workload"),
        F.when(u < 50, "legacy").when(u < 100, "json").otherwise("console").alias("mode"),
        "value", u.alias("duration_ms"),
    )
    return _round(tm.log_volume(writes, "legacy"))
