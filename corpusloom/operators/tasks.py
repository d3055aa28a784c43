"""State queries on job and task tables, evaluated for a given moment ``now``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Backoff of the task queues.
MAX_RETRY_MS = 3_600_000
STALE_UPLOAD_MINUTES = 15
DUE_BATCH = 50


def _plus_ms(ts: Column, ms: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / 1000).cast("decimal(18,6)"))


def is_claimable(now: Column) -> Column:
    status = F.col("job_status")
    lapsed = F.col("ownership_expires_at") < now
    return F.coalesce(
        (status == "PENDING")
        | ((status == "RETRY_WAIT") & (F.col("next_attempt_at") <= now))
        | ((status == "RUNNING") & lapsed & (F.col("attempts") < F.col("max_attempts"))),
        F.lit(False),
    )


def claimable_jobs(jobs: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Jobs a worker may take: pending, retry due, or lease lapsed with attempts left."""
    out = jobs.where(is_claimable(now)).orderBy(F.desc("priority"), "job_idx")
    return out if limit is None else out.limit(limit)


def expired_exhausted(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease lapsed and that have no attempts left."""
    lapsed = (F.col("job_status") == "RUNNING") & (F.col("ownership_expires_at") < now)
    return jobs.where(lapsed & (F.col("attempts") >= F.col("max_attempts")))


def timed_out_callbacks(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("job_status") == "WAITING_CALLBACK") & (F.col("ownership_expires_at") < now))


def reconcile_callbacks(jobs: DataFrame, files: DataFrame, now: Column, backoff_ms: int) -> DataFrame:
    """Next state of jobs whose callback did not come: done, failed, or retry after a fixed wait."""
    late = timed_out_callbacks(jobs, now).join(
        files.select("file_idx", F.col("status").alias("_file")), "file_idx", "left"
    )
    ready = F.coalesce(F.col("_file") == "READY", F.lit(False))
    spent = F.col("attempts") >= F.col("max_attempts")
    status = F.when(ready, F.lit("SUCCESS")).when(spent, F.lit("FAILED")).otherwise(F.lit("RETRY_WAIT"))
    return late.select(
        "job_idx",
        "file_idx",
        status.alias("job_status"),
        F.when(ready | spent, now).alias("finished_at"),
        F.when(~ready & ~spent, _plus_ms(now, F.lit(backoff_ms))).alias("next_attempt_at"),
        F.when(~ready & spent & F.col("_file").isNotNull(), F.lit("FAILED")).alias("file_status"),
    )


def failure_transition(failed: DataFrame, now: Column, backoff_ms: int) -> DataFrame:
    """Next state of jobs whose attempt failed; the wait grows linearly with the attempts."""
    spent = F.col("attempts") >= F.col("max_attempts")
    return failed.select(
        "job_idx",
        F.when(spent, F.lit("FAILED")).otherwise(F.lit("RETRY_WAIT")).alias("job_status"),
        F.when(~spent, _plus_ms(now, F.lit(backoff_ms) * F.col("attempts"))).alias("next_attempt_at"),
        F.when(spent, now).alias("finished_at"),
        F.when(spent, F.lit("FAILED")).alias("file_status"),
    )


def expired_claims(tasks: DataFrame, now: Column, max_attempts: int) -> DataFrame:
    """Tasks after lapsed claims were requeued or failed, and exhausted pending ones failed.

    The three updates run in that order: a claim requeued by the first is pending with
    attempts left, so the last leaves it alone.
    """
    lapsed = (F.col("status") == "PROCESSING") & (F.col("next_attempt_at") <= now)
    left = F.col("attempts") < max_attempts
    requeue, fail = lapsed & left, lapsed & ~left
    exhausted = (F.col("status") == "PENDING") & ~left
    status = (
        F.when(requeue, F.lit("PENDING")).when(fail | exhausted, F.lit("FAILED")).otherwise(F.col("status"))
    )
    due = F.when(requeue, now).when(fail | exhausted, F.lit(None)).otherwise(F.col("next_attempt_at"))
    rest = [c for c in tasks.columns if c not in ("status", "next_attempt_at")]
    return tasks.select(*rest, status.alias("status"), due.alias("next_attempt_at"))


def exponential_backoff_ms(attempt: Column, base_ms: int, cap_ms: int = MAX_RETRY_MS) -> Column:
    """Doubling wait, capped; the power is bounded so it cannot overflow."""
    power = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(40))
    return F.least(F.lit(float(cap_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), power)).cast("long")


def is_retryable(status: Column) -> Column:
    return status.isin(408, 425, 429) | (status >= 500)


def call_outcome(status: Column, done_status: int) -> Column:
    """done (2xx, or already gone), retry, or fail, for a deletion call."""
    return (
        F.when(status.between(200, 299) | (status == done_status), F.lit("done"))
        .when(is_retryable(status), F.lit("retry"))
        .otherwise(F.lit("fail"))
    )


def stale_uploads(uploads: DataFrame, files: DataFrame, now: Column, minutes: int = STALE_UPLOAD_MINUTES) -> DataFrame:
    """Upload batches stuck for too long, with the number of files they leave behind."""
    old = (F.col("status") == "UPLOADING") & (F.col("created_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    orphans = files.groupBy("uploads_idx").agg(F.count("*").alias("orphan_files"))
    stuck = uploads.where(old).join(orphans, "uploads_idx", "left").fillna(0, ["orphan_files"])
    return stuck.select("uploads_idx", "orphan_files", F.lit("FAILED").alias("status"), now.alias("finished_at"))


def reset_stale_generating(metadata: DataFrame, threshold: Column, now: Column) -> DataFrame:
    """Metadata whose generation hangs goes back to PROCESSING."""
    stale = (F.col("extraction_status") == "GENERATING") & (F.col("updated_at") < threshold)
    rest = [c for c in metadata.columns if c not in ("extraction_status", "updated_at")]
    return metadata.select(
        *rest,
        F.when(stale, F.lit("PROCESSING")).otherwise(F.col("extraction_status")).alias("extraction_status"),
        F.when(stale, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def pending_skipped(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata rows to skip: still PROCESSING although their file is ready and live."""
    ready = files.where((F.col("status") == "READY") & F.col("deleted_at").isNull()).select("file_idx")
    return metadata.where(F.col("extraction_status") == "PROCESSING").join(ready, "file_idx", "left_semi")


def due_tasks(tasks: DataFrame, now: Column, limit: int = DUE_BATCH) -> DataFrame:
    """First pending tasks by due time."""
    due = (F.col("status") == "PENDING") & (F.col("next_attempt_at") <= now)
    return tasks.where(due).orderBy("next_attempt_at", "task_idx").limit(limit)
