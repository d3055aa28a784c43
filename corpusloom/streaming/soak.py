"""Soak windows of a load test while it runs: requests meet resource samples, percentiles are exact."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.telemetry import SOAK_METRICS, SOAK_PREFIX, soak_rates
from corpusloom.streaming.admission import use_rocksdb

PERCENTS = (50, 95, 99)
#: Requests and samples may arrive this much out of order.
DELAY = "10 minutes"
#: Seconds without a request after which a window is over.
PAUSE = 600.0

_SAMPLE = ["epoch", *SOAK_METRICS.values()]
_WIDE = "kind int, case_id string, event_time timestamp, started double, ended double, success boolean, ms double, " + ", ".join(
    f"{c} double" for c in _SAMPLE
)
_STATS = [
    "resource_sample_count",
    *[f"{n}_{kind}" for n in SOAK_METRICS for kind in ("mean", "max")],
    *[f"{n}_p{p}" for n in ("rss", "vram") for p in PERCENTS],
]
_OUT = (
    "case_id string, started_epoch double, completed_epoch double, request_count bigint, success_count bigint, latency_mean_ms double, "
    "latency_max_ms double, " + ", ".join(f"latency_p{p}_ms double" for p in PERCENTS) + ", "
    + ", ".join(f"{c} {'bigint' if c == 'resource_sample_count' else 'double'}" for c in _STATS)
)


def percentile_of_counts(counts: Sequence[tuple[float, int]], percent: float) -> float | None:
    """Linear interpolation at (n - 1) * p / 100 over (value, count) pairs in order of value."""
    values, numbers = np.asarray(counts, np.float64).reshape(-1, 2).T
    upto = np.cumsum(numbers)
    if not len(upto):
        return None
    at = (int(upto[-1]) - 1) * (percent / 100.0)
    low, high = (float(values[np.searchsorted(upto, k, side="right")]) for k in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


def _equal(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, without those that are missing, and how often each occurs."""
    there = ~np.isnan(values)
    found, where = np.unique(values[there], return_inverse=True)
    return found, np.bincount(where, counts[there], len(found)).astype(np.int64)


def _mean(values: np.ndarray, counts: np.ndarray) -> float | None:
    n = int(counts.sum())
    return math.fsum(values * counts) / n if n else None


def _block(rows: np.ndarray) -> bytes:
    """Equal rows as one with their number, as bytes; a missing value is NaN."""
    rows = np.ascontiguousarray(rows, np.float64)
    same = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, first, n = np.unique(same, return_index=True, return_counts=True)
    return np.column_stack([rows[first], n.astype(np.float64)]).tobytes()


def _rows(blocks, width: int) -> np.ndarray:
    read = [np.frombuffer(b[0], np.float64).reshape(-1, width) for b in blocks]
    return np.concatenate(read) if read else np.empty((0, width))


class SoakWindow(StatefulProcessor):
    """Counts of equal latencies and samples of one window, until it is over.

    Each batch of rows appends one block of numbers to the state, equal rows as one. When the watermark has passed the last request by
    the pause, the window's row is made from the counts and the state is dropped; so is that of
    samples to which no request ever came.
    """

    def __init__(self, pause: float):
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bounds = handle.getValueState("bounds", "started double, ended double, requests bigint, successes bigint, last_sample double")
        self.latencies = handle.getListState("latencies", "block binary")
        self.samples = handle.getListState("samples", "block binary")

    def handleInputRows(self, key, rows, timerValues):
        started, ended, requests, successes, last = self.bounds.get() if self.bounds.exists() else (None, None, 0, 0, -math.inf)
        for pdf in rows:
            asked, sampled = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
            if len(asked):
                started = min(asked["started"].min(), math.inf if started is None else started)
                ended = max(asked["ended"].max(), -math.inf if ended is None else ended)
                requests += len(asked)
                successes += int((asked["success"] == True).sum())  # noqa: E712  nulls are no successes
                ms = asked[["ms"]].dropna().to_numpy(np.float64)
                if len(ms):
                    self.latencies.appendValue((_block(ms),))
            if len(sampled):
                last = max(last, float(sampled["epoch"].max()))
                self.samples.appendValue((_block(sampled[_SAMPLE].to_numpy(np.float64)),))
        self.bounds.update((started, ended, requests, successes, last))
        self.handle.registerTimer(self._over(ended, last))
        yield from ()

    def _over(self, ended: float | None, last: float) -> int:
        """When the window is over; samples count only while there is no request."""
        return int(((last if ended is None else ended) + self.pause) * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.bounds.exists():
            started, ended, requests, successes, last = self.bounds.get()
            if self._over(ended, last) <= expiredTimerInfo.getExpiryTimeInMs():  # else there is a later timer
                if requests:
                    yield pd.DataFrame([self._row(key[0], started, ended, requests, successes)])
                self.bounds.clear()
                self.latencies.clear()
                self.samples.clear()

    def _row(self, case_id: str, started: float, ended: float, requests: int, successes: int) -> dict:
        row = {"case_id": case_id, "started_epoch": started, "completed_epoch": ended, "request_count": requests, "success_count": successes}
        values, counts = _equal(*_rows(self.latencies.get(), 2).T)
        row["latency_mean_ms"] = _mean(values, counts)
        row["latency_max_ms"] = float(values[-1]) if len(values) else None
        row |= {f"latency_p{p}_ms": percentile_of_counts(np.column_stack([values, counts]), p) for p in PERCENTS}
        inside = _rows(self.samples.get(), len(_SAMPLE) + 1)
        inside = inside[(inside[:, 0] >= started) & (inside[:, 0] <= ended)]
        row["resource_sample_count"] = int(inside[:, -1].sum())
        for i, name in enumerate(SOAK_METRICS, 1):
            values, counts = _equal(inside[:, i], inside[:, -1])
            row[f"{name}_mean"] = _mean(values, counts)
            row[f"{name}_max"] = float(values[-1]) if len(values) else None
            if name in ("rss", "vram"):
                row |= {f"{name}_p{p}": percentile_of_counts(np.column_stack([values, counts]), p) for p in PERCENTS}
        return row

    def close(self) -> None:
        pass


def soak_case_stream(records: DataFrame, samples: DataFrame, prefix: str = SOAK_PREFIX, delay: str = DELAY, pause: float = PAUSE) -> DataFrame:
    """``soak_windows`` of two streams: a row for each window that is over, with the same columns.

    ``records`` and ``samples`` as there. Requests and samples each have a watermark, and the
    slower one counts, so no window closes before the samples of its time are in. A window is over
    ``pause`` seconds after its last request; what comes behind the watermark is dropped by Spark.
    """
    use_rocksdb(records.sparkSession)
    at = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long"))
    nothing = F.lit(None).cast("double")
    asked = records.where(F.startswith("case_id", F.lit(prefix)) & F.col("completed_epoch").isNotNull()).select(
        F.lit(0).alias("kind"), "case_id", at("completed_epoch").alias("event_time"), F.col("started_epoch").cast("double").alias("started"),
        F.col("completed_epoch").cast("double").alias("ended"), "success", F.when(F.col("success"), F.col("duration_ms")).cast("double").alias("ms"),
        *[nothing.alias(c) for c in _SAMPLE],
    )
    sampled = samples.where(F.startswith("case_id", F.lit(prefix)) & F.col("epoch").isNotNull()).select(
        F.lit(1).alias("kind"), "case_id", at("epoch").alias("event_time"), nothing.alias("started"), nothing.alias("ended"),
        F.lit(None).cast("boolean").alias("success"), nothing.alias("ms"), *[F.col(c).cast("double").alias(c) for c in _SAMPLE],
    )
    both = asked.withWatermark("event_time", delay).unionByName(sampled.withWatermark("event_time", delay))
    schema = T._parse_datatype_string(_OUT)
    windows = both.groupBy("case_id").transformWithStateInPandas(
        SoakWindow(pause), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return soak_rates(windows)
