"""Request, stage and resource telemetry: summaries, boundaries, drift, failures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.constants import FAILURE_TOKENS, LOG_MARKERS
from corpusloom.operators.intervals import interval_stats
from corpusloom.operators.ordered import previous
from corpusloom.operators.percentiles import exact_percentiles

LEVEL = ["operation", "phase", "concurrency"]
# Fixed value: shortest elapsed time, in seconds.
MIN_ELAPSED = 1e-9


def percent_change(before: Column, after: Column) -> Column:
    """Change in percent; null on null, on a zero base, or when not finite."""
    change = (after - before) / F.when(before != 0, before) * 100.0
    return F.when(~F.isnan(change) & (F.abs(change) < float("inf")), change)


def summarize_level(records: DataFrame, keys: list[str] = LEVEL) -> DataFrame:
    """Counts, rates and latencies per level; latencies are those of successes."""
    ok = F.col("success")
    ms = F.when(ok, F.col("duration_ms"))
    rows = records.withColumn("_ms", ms)
    elapsed = F.greatest(F.max("completed_epoch") - F.min("started_epoch"), F.lit(MIN_ELAPSED))
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("request_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("error_count"),
        (F.count_if(~ok) / F.count("*")).alias("error_rate"),
        elapsed.alias("elapsed_seconds"),
        (F.count_if(ok) / elapsed).alias("throughput"),
        F.avg("_ms").alias("mean_ms"),
        F.min("_ms").alias("min_ms"),
        F.max("_ms").alias("max_ms"),
        F.sum("request_bytes").alias("total_request_bytes"),
        F.sum("response_bytes").alias("total_response_bytes"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
    )
    p = exact_percentiles(rows, keys, "_ms", {"p50_ms": 50, "p95_ms": 95, "p99_ms": 99})
    return base.join(p, keys, "left")


@dataclass(frozen=True)
class SaturationPolicy:
    max_error_rate: float = 0.01
    throughput_gain_floor: float = 5.0
    p95_growth_trigger: float = 20.0


def detect_saturation(levels: DataFrame, policy: SaturationPolicy = SaturationPolicy()) -> DataFrame:
    """First saturated level of each operation, by concurrency; levels are few."""
    by = Window.partitionBy("operation").orderBy("concurrency")
    gain = percent_change(F.lag("throughput").over(by), F.col("throughput"))
    growth = percent_change(F.lag("p95_ms").over(by), F.col("p95_ms"))
    df = levels.select(
        "operation", "concurrency", "error_rate",
        F.lag("concurrency").over(by).alias("previous_concurrency"), gain.alias("_gain"), growth.alias("_growth"),
    )
    failing = F.col("error_rate") > policy.max_error_rate
    flat = (F.col("_gain") <= policy.throughput_gain_floor) & (F.col("_growth") >= policy.p95_growth_trigger)
    reason = F.when(failing, F.lit("error_rate_exceeded")).when(flat, F.lit("throughput_plateau_with_latency_growth"))
    flagged = df.withColumn("reason", reason).where(F.col("reason").isNotNull())
    rest = F.struct(
        "concurrency", "reason", "previous_concurrency",
        F.when(~failing, F.col("_gain")).alias("throughput_gain_percent"),
        F.when(~failing, F.col("_growth")).alias("p95_growth_percent"),
        "error_rate",
    )
    return flagged.groupBy("operation").agg(F.min_by(rest, "concurrency").alias("c")).select("operation", "c.*")


@dataclass(frozen=True)
class StopPolicy:
    max_error_rate: float = 0.10
    max_p95_ms: float = 10_000.0
    max_memory_percent: float = 95.0
    max_gpu_memory_percent: float = 98.0


# Stop reasons that mean the run itself was stopped.
STOPPING = (
    "system_memory_guard_triggered", "gpu_memory_guard_triggered", "target_process_exited",
    "scheduler_submission_stopped", "client_memory_guard_triggered",
)


def stop_reason(
    error_rate: Column, p95: Column, memory: Column, gpu: Column, policy: StopPolicy = StopPolicy()
) -> Column:
    """First exceeded limit, in priority order."""
    return (
        F.when(error_rate > policy.max_error_rate, F.lit("error_rate_exceeded"))
        .when(p95 > policy.max_p95_ms, F.lit("p95_latency_exceeded"))
        .when(memory >= policy.max_memory_percent, F.lit("system_memory_guard_triggered"))
        .when(gpu >= policy.max_gpu_memory_percent, F.lit("gpu_memory_guard_triggered"))
    )


def stage_status(
    requests: Column, submitted: Column, error_rate: Column, slow: Column, reason: Column, policy: StopPolicy = StopPolicy()
) -> Column:
    return (
        F.when((submitted == 0) & (requests == 0), F.lit("skipped"))
        .when(reason.isin(*STOPPING), F.lit("stopped"))
        .when(reason.isNotNull() | (error_rate > policy.max_error_rate), F.lit("failed"))
        .when((slow > 0) | (error_rate > 0), F.lit("degraded"))
        .otherwise(F.lit("passed"))
    )


def first_error_type(error_type: Column, status_code: Column, order: Column, success: Column) -> Column:
    """Aggregate: error type of the first failed record, or its HTTP code."""
    name = F.coalesce(error_type, F.concat(F.lit("http_"), status_code.cast("string")))
    return F.min_by(name, F.when(~success, order))


STAGE_METRICS = ["system_memory_percent", "gpu_memory_percent", "target_rss_bytes", "target_gpu_bytes", "threads", "handles"]


def summarize_stage(
    stages: DataFrame,
    records: DataFrame,
    samples: DataFrame,
    sla_ms: float,
    max_span: int,
    policy: StopPolicy = StopPolicy(),
) -> DataFrame:
    """SLA counts, latencies and resource maxima of each stage, with its verdict.

    ``stages``: stage_id, sequence, mode, operation, concurrency, submitted, start_us,
    end_us. ``records`` carry their stage_id; ``samples`` have at_us.
    """
    ok = F.col("success")
    rows = records.withColumn("_ms", F.when(ok, F.col("duration_ms")))
    base = rows.groupBy("stage_id").agg(
        F.count("*").alias("request_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(ok & (F.col("duration_ms") <= sla_ms)).alias("sla_success_count"),
        F.count_if(~ok).alias("error_count"),
        F.avg("_ms").alias("latency_mean_ms"),
        F.min("_ms").alias("latency_min_ms"),
        F.max("_ms").alias("latency_max_ms"),
        first_error_type(F.col("error_type"), F.col("status_code"), F.col("request_index"), ok).alias("first_error_type"),
    )
    p = exact_percentiles(rows, ["stage_id"], "_ms", {f"latency_p{q}_ms": q for q in (50, 90, 95, 99)})
    seen = interval_stats(stages, samples, ["stage_id"], "start_us", "end_us", "at_us", STAGE_METRICS, max_span)
    seen = seen.drop(*[f"{m}_mean" for m in STAGE_METRICS])
    df = seen.join(base, "stage_id", "left").join(p, "stage_id", "left")
    df = df.fillna(0, ["request_count", "success_count", "sla_success_count", "error_count"])
    n = F.when(F.col("request_count") > 0, F.col("request_count"))
    elapsed = F.greatest((F.col("end_us") - F.col("start_us")) / 1e6, F.lit(MIN_ELAPSED))
    df = (
        df.withColumn("slow_success_count", F.col("success_count") - F.col("sla_success_count"))
        .withColumn("error_rate", F.coalesce(F.col("error_count") / n, F.lit(0.0)))
        .withColumn("sla_success_rate", F.coalesce(F.col("sla_success_count") / n, F.lit(0.0)))
        .withColumn("throughput", F.col("success_count") / elapsed)
    )
    reason = stop_reason(
        F.col("error_rate"), F.col("latency_p95_ms"), F.col("system_memory_percent_max"), F.col("gpu_memory_percent_max"), policy
    )
    df = df.withColumn("stop_reason", reason)
    status = stage_status(
        F.col("request_count"), F.col("submitted"), F.col("error_rate"), F.col("slow_success_count"), F.col("stop_reason"), policy
    )
    return df.withColumn("status", status)


def capacity_boundaries(stages: DataFrame) -> DataFrame:
    """Highest concurrency before the first failed stage of each operation.

    Ramp stages decide; without any, the other modes do. "Before the first failure" is a
    comparison with the failing stage's place, so two aggregates replace a window.
    """
    usable = stages.where((F.col("concurrency") > 0) & F.col("mode").isin("ramp", "burst", "soak", "chaos", "batch", "interval"))
    ramps = usable.groupBy("operation").agg(F.max(F.col("mode") == "ramp").alias("_has_ramp"))
    source = usable.join(ramps, "operation").where(~F.col("_has_ramp") | (F.col("mode") == "ramp"))
    place = F.struct(F.col("concurrency").alias("c"), F.col("sequence").alias("s"))
    bad = F.col("status").isin("failed", "stopped")
    why = F.coalesce("stop_reason", "first_error_type", "status")
    first = source.groupBy("operation").agg(
        F.min(F.when(bad, place)).alias("_at"),
        F.min_by(F.struct("concurrency", "stage_id", why.alias("reason")), F.when(bad, place)).alias("_f"),
        F.count("*").alias("evidence_count"),
    )
    below = source.join(first.select("operation", "_at"), "operation")
    below = below.where(F.col("_at").isNull() | (place < F.col("_at")))
    normal = below.groupBy("operation").agg(F.max("concurrency").alias("normal_maximum_concurrency"))
    return first.join(normal, "operation", "left").select(
        "operation",
        "normal_maximum_concurrency",
        F.when(F.col("_at").isNotNull(), F.col("_f.concurrency")).alias("first_failure_concurrency"),
        F.when(F.col("_at").isNotNull(), F.col("_f.stage_id")).alias("first_failure_stage_id"),
        F.when(F.col("_at").isNotNull(), F.col("_f.reason")).alias("first_failure_reason"),
        F.col("_at").isNull().alias("upper_bound_censored"),
        "evidence_count",
    )


def _boundary(df: DataFrame, keys: list[str], value: str, order: Column, bad: Column, reason: Column) -> DataFrame:
    first = df.groupBy(*keys).agg(
        F.min(F.when(bad, order)).alias("_at"),
        F.min_by(F.struct(F.col(value).alias("v"), reason.alias("r")), F.when(bad, order)).alias("_f"),
        F.count("*").alias("evidence_count"),
    )
    below = df.join(first.select(*keys, "_at"), keys).where(F.col("_at").isNull() | (order < F.col("_at")))
    normal = below.groupBy(*keys).agg(F.max(value).alias("normal_maximum_value"))
    failed = F.col("_at").isNotNull()
    return first.join(normal, keys, "left").select(
        *keys,
        "normal_maximum_value",
        F.when(failed, F.col("_f.v")).alias("first_failure_value"),
        F.when(failed, F.col("_f.r")).alias("first_failure_reason"),
        (~failed).alias("upper_bound_censored"),
        "evidence_count",
    )


def concurrency_boundary(levels: DataFrame, max_error_rate: float) -> DataFrame:
    """Highest concurrency below the first level whose error rate exceeds the limit."""
    df = levels.where(F.col("phase") == "concurrency")
    bad = F.col("error_rate") > max_error_rate
    return _boundary(df, ["operation"], "concurrency", F.col("concurrency"), bad, F.lit("error_rate_exceeded"))


DIMENSIONS = ("fixture_size_bytes", "declared_text_units", "declared_image_count", "chunk_count")


def numeric_boundary(records: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Largest value ingested before the first failure, per dimension, file type and origin."""
    kind = F.concat_ws(":", F.lit("ingest"), F.coalesce("file_type", F.lit("unknown")), F.coalesce("content_origin", F.lit("unknown")))
    entries = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("long").alias("value")) for d in dimensions]))
    df = records.where(F.col("operation") == "ingest").select(
        kind.alias("operation"), entries.alias("e"), "success", "error_type", "request_index"
    )
    df = df.select("e.dimension", "operation", "e.value", "success", "error_type", "request_index")
    df = df.where(F.col("value").isNotNull())
    order = F.struct(F.col("value").alias("v"), F.col("request_index").alias("i"))
    reason = F.coalesce("error_type", F.lit("request_failed"))
    return _boundary(df, ["dimension", "operation"], "value", order, ~F.col("success"), reason)


SOAK_PREFIX = "soak-window-"
# Statistics of a soak window's resource samples, and the columns they are of.
SOAK_METRICS = {"rss": "target_rss_bytes", "vram": "target_gpu_bytes", "thread": "threads", "handle": "handles"}


def soak_rates(windows: DataFrame) -> DataFrame:
    """Number, error rate and throughput of each window from its counts."""
    elapsed = F.greatest(F.col("completed_epoch") - F.col("started_epoch"), F.lit(MIN_ELAPSED))
    return (
        windows.withColumn("window_index", F.regexp_extract("case_id", "([0-9]+)\\z", 1).try_cast("int"))
        .withColumn("error_rate", (F.col("request_count") - F.col("success_count")) / F.col("request_count"))
        .withColumn("throughput", F.col("success_count") / elapsed)
        .fillna(0, ["resource_sample_count"])
    )


def soak_windows(records: DataFrame, samples: DataFrame, prefix: str = SOAK_PREFIX) -> DataFrame:
    """Latency and resource statistics of each soak window.

    A window runs from its first start to its last end; of its samples those inside count.
    """
    ok = F.col("success")
    rows = records.where(F.startswith("case_id", F.lit(prefix))).withColumn("_ms", F.when(ok, F.col("duration_ms")))
    w = rows.groupBy("case_id").agg(
        F.min("started_epoch").alias("started_epoch"),
        F.max("completed_epoch").alias("completed_epoch"),
        F.count("*").alias("request_count"),
        F.count_if(ok).alias("success_count"),
        F.avg("_ms").alias("latency_mean_ms"),
        F.max("_ms").alias("latency_max_ms"),
    )
    bounds = w.select("case_id", "started_epoch", "completed_epoch")
    inside = samples.join(bounds, "case_id").where(F.col("epoch").between(F.col("started_epoch"), F.col("completed_epoch")))
    metrics = SOAK_METRICS
    res = inside.groupBy("case_id").agg(
        F.count("*").alias("resource_sample_count"),
        *[F.avg(c).alias(f"{n}_mean") for n, c in metrics.items()],
        *[F.max(c).alias(f"{n}_max") for n, c in metrics.items()],
    )
    # All percentiles in one pass over (window, metric, value).
    entries = [F.struct(F.lit(n).alias("m"), F.col(metrics[n]).cast("double").alias("v")) for n in ("rss", "vram")]
    long = inside.select("case_id", F.explode(F.array(*entries)).alias("e")).select("case_id", "e.m", "e.v")
    long = long.unionByName(rows.select("case_id", F.lit("latency").alias("m"), F.col("_ms").alias("v")))
    q = exact_percentiles(long, ["case_id", "m"], "v", {"p50": 50, "p95": 95, "p99": 99})
    names = {"latency": "latency_p{}_ms", "rss": "rss_p{}", "vram": "vram_p{}"}
    wide = [F.max(F.when(F.col("m") == m, F.col(f"p{i}"))).alias(n.format(i)) for m, n in names.items() for i in (50, 95, 99)]
    out = w.join(res, "case_id", "left").join(q.groupBy("case_id").agg(*wide), "case_id", "left")
    return soak_rates(out)


@dataclass(frozen=True)
class DriftLimits:
    latency_percent: float = 20.0
    rss_percent: float = 15.0
    vram_percent: float = 15.0
    threads: float = 5.0
    handles: float = 100.0


def soak_drift(windows: DataFrame, limits: DriftLimits = DriftLimits()) -> DataFrame:
    """Growth from the first to the last window, against the report limits."""
    ends = F.struct("latency_p95_ms", "rss_p95", "vram_p95", "thread_max", "handle_max")
    df = windows.agg(
        F.count("*").alias("window_count"),
        F.min("window_index").alias("first_window_index"),
        F.max("window_index").alias("last_window_index"),
        F.min_by(ends, "window_index").alias("a"),
        F.max_by(ends, "window_index").alias("b"),
    )

    def growth(c: str) -> Column:
        return percent_change(F.col(f"a.{c}"), F.col(f"b.{c}"))

    df = df.select(
        "window_count", "first_window_index", "last_window_index",
        growth("latency_p95_ms").alias("latency_p95_growth_percent"),
        growth("rss_p95").alias("rss_p95_growth_percent"),
        growth("vram_p95").alias("vram_p95_growth_percent"),
        (F.col("b.thread_max") - F.col("a.thread_max")).alias("thread_max_growth"),
        (F.col("b.handle_max") - F.col("a.handle_max")).alias("handle_max_growth"),
    )
    flags = {
        "latency_candidate": ("latency_p95_growth_percent", limits.latency_percent),
        "rss_candidate": ("rss_p95_growth_percent", limits.rss_percent),
        "vram_candidate": ("vram_p95_growth_percent", limits.vram_percent),
        "thread_candidate": ("thread_max_growth", limits.threads),
        "handle_candidate": ("handle_max_growth", limits.handles),
    }
    for name, (c, limit) in flags.items():
        df = df.withColumn(name, F.coalesce(F.col(c) >= limit, F.lit(False)))
    return df.withColumn("any_candidate", F.greatest(*flags))


def classify_failures(records: DataFrame) -> DataFrame:
    """Failed requests by cause; unclassified ones are dropped, repeats counted once."""
    text = F.lower(F.concat_ws(" ", "error_type", "error_message"))
    category, condition = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cat, cond, tokens in reversed(FAILURE_TOKENS):
        hit = F.array_contains(F.array(*[text.contains(t) for t in tokens]), True)
        category = F.when(hit, F.lit(cat)).otherwise(category)
        condition = F.when(hit, F.lit(cond)).otherwise(condition)
    df = records.where(~F.col("success") & F.col("error_type").isNotNull())
    df = df.withColumn("category", category).withColumn("condition", condition)
    df = df.where(F.col("category").isNotNull())
    first = F.min_by(F.struct("condition", "operation", "error_type", "status_code", "duration_ms"), "request_index")
    return df.groupBy("category", "request_id").agg(first.alias("f")).select("category", "request_id", "f.*")


def scan_log_markers(lines: DataFrame, text: str = "value") -> DataFrame:
    """Known failure markers in a log, each once, with the number of lines that hold it."""
    lower = F.lower(F.col(text))
    marks = F.array(
        *[
            F.when(lower.contains(token), F.struct(F.lit(token).alias("token"), F.lit(cat).alias("category"), F.lit(cond).alias("condition")))
            for token, cat, cond in LOG_MARKERS
        ]
    )
    found = lines.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    return found.groupBy("m.token", "m.category", "m.condition").agg(F.count("*").alias("line_count"))


RESOURCE_METRICS = (
    "system_cpu_percent", "system_memory_used_bytes", "target_cpu_percent", "target_rss_bytes", "target_private_bytes",
    "target_gpu_bytes", "gpu_utilization_percent", "gpu_memory_used_bytes", "embedder_cpu_percent",
    "embedder_memory_used_bytes", "store_cpu_percent", "store_memory_used_bytes",
)


def summarize_resources(samples: DataFrame, metrics: tuple[str, ...] = RESOURCE_METRICS) -> DataFrame:
    """Mean and maximum of each metric per level and case; idle samples do not count."""
    busy = samples.where(F.col("operation") != "idle")
    return busy.groupBy(*LEVEL, "case_id").agg(
        F.count("*").alias("sample_count"),
        *[F.avg(F.col(m).cast("double")).alias(f"{m}_mean") for m in metrics],
        *[F.max(F.col(m).cast("double")).alias(f"{m}_max") for m in metrics],
    )


def stage_resources(
    events: DataFrame, samples: DataFrame, fixtures: DataFrame, metrics: list[str], max_span: int
) -> DataFrame:
    """Resources while each stage ran, with the attributes of its file.

    ``events``: event_id, file_idx, start_us, end_us. Events without samples or fixture
    are kept.
    """
    seen = interval_stats(events, samples, ["event_id"], "start_us", "end_us", "at_us", metrics, max_span)
    return seen.join(fixtures, "file_idx", "left")


def counter_delta(before: Column, after: Column) -> Column:
    """Growth of a counter; null when unknown or when the counter was reset."""
    return F.when(after >= before, after - before)


def counter_deltas(samples: DataFrame, keys: list[str], at: str, counters: list[str], block: Column) -> DataFrame:
    """Growth of each counter since the previous sample of its series.

    ``block`` cuts a long series by time, so no series has to fit one task.
    """
    df = previous(samples, keys, at, counters, block)
    return df.select(
        *samples.columns, *[counter_delta(F.col(f"prev_{c}"), F.col(c)).alias(f"{c}_delta") for c in counters]
    ).drop(*[f"prev_{c}" for c in counters])


def cpu_percent(times: DataFrame, target: str, block: Column) -> DataFrame:
    """CPU use of each target per sample, from cumulative times of its processes.

    ``times``: target, sampled_at (seconds), pid, cpu_time. A process counts when it was in the
    sample just before; a negative growth counts as zero; the first sample is 0.
    """
    stamps = times.select(target, "sampled_at").distinct()
    stamps = previous(stamps, [target], "sampled_at", ["sampled_at"], block)
    now = times.join(stamps, [target, "sampled_at"])
    before = times.select(target, F.col("sampled_at").alias("prev_sampled_at"), "pid", F.col("cpu_time").alias("_then"))
    both = now.join(before, [target, "prev_sampled_at", "pid"], "left")
    grown = F.greatest(F.col("cpu_time") - F.col("_then"), F.lit(0))
    per = both.groupBy(target, "sampled_at", "prev_sampled_at").agg(F.coalesce(F.sum(F.when(F.col("_then").isNotNull(), grown)), F.lit(0)).alias("_d"))
    share = F.col("_d") / (F.col("sampled_at") - F.col("prev_sampled_at")) * 100.0
    return per.select(target, "sampled_at", F.when(F.col("prev_sampled_at").isNull(), F.lit(0.0)).otherwise(share).alias("cpu_percent"))


def run_summary(records: DataFrame, stages: DataFrame, samples: DataFrame) -> DataFrame:
    """Totals of a run in one row."""
    ok = F.col("success")
    counts = {
        "request_count": records.agg(F.count("*").alias("n")),
        "success_count": records.agg(F.count_if(ok).alias("n")),
        "failure_count": records.agg(F.count_if(~ok).alias("n")),
        "stage_count": stages.agg(F.count("*").alias("n")),
        "sample_count": samples.agg(F.count("*").alias("n")),
    }
    rows = None
    for name, df in counts.items():
        row = df.select(F.lit(name).alias("name"), "n")
        rows = row if rows is None else rows.unionByName(row)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counts])


def is_slow_stage(duration_ms: Column, threshold_ms: float) -> Column:
    return duration_ms >= threshold_ms


def log_volume(writes: DataFrame, baseline: str) -> DataFrame:
    """Log output per workload and mode, against a baseline mode.

    ``writes``: workload, mode, value, duration_ms; one row per write.
    """
    keys = ["workload", "mode"]
    breaks = F.length("value") - F.length(F.replace("value", F.lit("\n")))
    v = writes.groupBy(*keys).agg(
        F.sum(breaks).alias("line_count"),
        F.sum(F.octet_length("value")).alias("byte_count"),
        F.count("*").alias("write_count"),
    )
    v = v.join(exact_percentiles(writes, keys, "duration_ms", {"median_ms": 50}), keys, "left")
    b = v.where(F.col("mode") == baseline).select(
        "workload", F.col("line_count").alias("_l"), F.col("byte_count").alias("_b"), F.col("median_ms").alias("_m")
    )
    out = v.join(b, "workload", "left")
    return out.select(
        *v.columns,
        percent_change(F.col("_l"), F.col("line_count")).alias("line_change_percent"),
        percent_change(F.col("_b"), F.col("byte_count")).alias("byte_change_percent"),
        (F.col("median_ms") / F.when(F.col("_m") != 0, F.col("_m"))).alias("time_ratio"),
    )
