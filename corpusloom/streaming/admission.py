"""Admission rules that depend on earlier admissions: rate limit and idempotent apply.

Times are integer microseconds. The batch forms run on whole tables. The streaming forms decide
a request when it arrives and keep decisions per key in the state store, until the watermark has passed
the time for which they matter; a timer then drops them, so the state follows the keys of
the last minutes and not all keys there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions.text import strip
from corpusloom.operators.ordered import gap_segments, ordered_fold

# Twenty requests per minute; an applied key holds for five minutes.
RATE_LIMIT = 20
RATE_WINDOW_US = 60_000_000
APPLY_TTL_US = 300_000_000
HOUR_US = 3_600_000_000
#: Requests may arrive this much out of order.
DELAY = "10 minutes"


def _admit(recent: tuple, now: int, limit: int, window: int) -> tuple[tuple, bool]:
    """Admit when fewer than ``limit`` admitted requests are at most ``window`` old."""
    recent = tuple(t for t in recent if now - t <= window)
    if len(recent) >= limit:
        return recent, False
    return (*recent, now), True


def _apply(last: int | None, now: int, ttl: int) -> tuple[int, bool]:
    """Apply unless the key was applied less than ``ttl`` ago."""
    if last is not None and last > now - ttl:
        return last, False
    return now, True


def rate_limit(
    requests: DataFrame, user: str, at: str, request: str, limit: int = RATE_LIMIT, window: int = RATE_WINDOW_US, block: int = HOUR_US
) -> DataFrame:
    """Add ``admitted`` to every request; refused requests do not count against a user.

    Nothing admitted before a pause longer than the window still counts after it, so each
    stretch between such pauses is decided on its own, with at most ``limit`` remembered
    times. Only a user who never pauses stays in one task, which streams.
    """
    df = gap_segments(requests, [user], at, request, window, block)
    folded = ordered_fold(
        df, [user, "_segment"], ["_o"], tuple, lambda state, v: _admit(state, v[0], limit, window), [at], "admitted", "boolean"
    )
    return folded.drop("_segment", "_o")


def idempotent_apply(
    requests: DataFrame, user: str, key: str, at: str, request: str, ttl: int = APPLY_TTL_US, block: int = HOUR_US
) -> DataFrame:
    """Add ``applied``: false for a key repeated within ``ttl``; blank keys always apply."""
    blank = F.coalesce(strip(F.col(key)), F.lit("")) == ""
    keyed = gap_segments(requests.where(~blank), [user, key], at, request, ttl, block, at_gap=True)
    folded = ordered_fold(
        keyed, [user, key, "_segment"], ["_o"], lambda: None, lambda state, v: _apply(state, v[0], ttl), [at], "applied", "boolean"
    )
    return folded.drop("_segment", "_o").unionByName(requests.where(blank).withColumn("applied", F.lit(True)))


def _in_order(rows: Iterator[pd.DataFrame], at: str, request: str) -> pd.DataFrame:
    """The rows of one key in this micro-batch, whose size the trigger bounds."""
    return pd.concat(list(rows)).sort_values([at, request], kind="stable")


class _Decisions(StatefulProcessor):
    """Keeps the times of positive decisions of one key for ``span`` microseconds of event time.

    A request is decided against the decisions around its own time, so one that arrives out of
    order, but not behind the watermark, isn't held against requests long after it.
    """

    flag = ""

    def __init__(self, at: str, request: str, span: int):
        self.at, self.request, self.span = at, request, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at bigint")

    def decide(self, times: list[int], now: int) -> bool:
        raise NotImplementedError

    def _needed(self, times: list[int], watermark_ms: int) -> list[int]:
        """Times that a request which is not behind the watermark may still meet."""
        return [t for t in times if t + self.span >= (watermark_ms - 1) * 1000]

    def _keep(self, times: list[int], watermark_ms: int) -> None:
        times = self._needed(times, watermark_ms)
        if times:
            self.times.put([(t,) for t in times])
        else:
            self.times.clear()

    def handleInputRows(self, key, rows, timerValues):
        pdf = _in_order(rows, self.at, self.request)
        times = [row[0] for row in self.times.get()] if self.times.exists() else []
        decided = []
        for now in pdf[self.at].tolist():
            ok = self.decide(times, now)
            if ok:
                times.append(now)
            decided.append(ok)
        self._keep(times, timerValues.getCurrentWatermarkInMs())
        if times:
            # The first millisecond at which none of these times is needed.
            self.handle.registerTimer((max(times) + self.span) // 1000 + 2)
        yield pdf.assign(**{self.flag: decided})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        times = [row[0] for row in self.times.get()] if self.times.exists() else []
        self._keep(times, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


class RateLimiter(_Decisions):
    """Admits when fewer than ``limit`` admitted requests lie in the window that ends with the request."""

    flag = "admitted"

    def __init__(self, at: str, request: str, limit: int, window: int):
        super().__init__(at, request, window)
        self.limit = limit

    def decide(self, times: list[int], now: int) -> bool:
        return sum(0 <= now - t <= self.span for t in times) < self.limit


class IdempotentApply(_Decisions):
    """Applies unless the key was applied within the time to live, before the request or after it."""

    flag = "applied"

    def decide(self, times: list[int], now: int) -> bool:
        return not any(abs(now - t) < self.span for t in times)


def _with(stream: DataFrame, flag: str) -> T.StructType:
    return T.StructType([*stream.schema.fields, T.StructField(flag, T.BooleanType())])


def use_rocksdb(spark) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _decided(stream: DataFrame, keys: list[str], processor: _Decisions, delay: str) -> DataFrame:
    # Spark drops rows at the watermark, too; a millisecond more keeps these, and those of time 0 before there is any.
    timed = stream.withColumn("_event_time", F.timestamp_micros(F.col(processor.at) + 1000)).withWatermark("_event_time", delay)
    schema = _with(stream, processor.flag)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def rate_limit_stream(
    stream: DataFrame, user: str, at: str, request: str, limit: int = RATE_LIMIT, window: int = RATE_WINDOW_US, delay: str = DELAY
) -> DataFrame:
    """Add ``admitted`` to every request on arrival.

    Requests may come out of order by ``delay``; Spark drops those behind the watermark. In
    order of time the result is that of ``rate_limit``. A user's admitted times are dropped when the
    watermark is past their window.
    """
    use_rocksdb(stream.sparkSession)
    return _decided(stream, [user], RateLimiter(at, request, limit, window), delay)


def idempotent_apply_stream(
    stream: DataFrame, user: str, key: str, at: str, request: str, ttl: int = APPLY_TTL_US, delay: str = DELAY
) -> DataFrame:
    """Add ``applied``. Rows with a blank key pass by the state; the rest is decided per (user, key).

    Lateness as in ``rate_limit_stream``. A key is forgotten when the watermark is past its time to live.
    """
    use_rocksdb(stream.sparkSession)
    blank = F.coalesce(strip(F.col(key)), F.lit("")) == ""
    decided = _decided(stream.where(~blank), [user, key], IdempotentApply(at, request, ttl), delay)
    return decided.unionByName(stream.where(blank).withColumn("applied", F.lit(True)))


def deduplicate_applies(stream: DataFrame, user: str, key: str, ts: str, ttl: str = "5 minutes") -> DataFrame:
    """Built-in variant: one row per key within the watermark.

    It may hold a key longer than the time given, so it can drop what the exact form applies.
    """
    blank = F.coalesce(strip(F.col(key)), F.lit("")) == ""
    marked = stream.withWatermark(ts, ttl)
    return marked.where(~blank).dropDuplicatesWithinWatermark([user, key]).unionByName(marked.where(blank))
