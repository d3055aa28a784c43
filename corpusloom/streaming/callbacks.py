"""Hand-offs that get no completion in time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.ordered import forward_fill
from corpusloom.streaming.admission import use_rocksdb

# Fixed value: a callback may take ten minutes.
CALLBACK_MS = 600_000


# Jobs share this many groups of state, so a micro-batch makes a call for each group and not for each job.
GROUPS = 2048


class CallbackTimeout(StatefulProcessor):
    """Open hand-offs of the jobs of one group as list state, with one event-time timer for the earliest."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "job bigint, at_ms bigint")

    def _held(self) -> pd.DataFrame:
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        jobs = [job for job, _ in held]
        return pd.DataFrame(
            {
                "job": np.array([job or 0 for job in jobs], "int64"),
                "known": np.array([job is not None for job in jobs], "bool"),
                "at_ms": np.array([at for _, at in held], "int64"),
                "kind": "handoff",
            }
        )

    def _late(self, rows: pd.DataFrame) -> pd.DataFrame:
        job = rows["job"].astype("Int64").where(rows["known"])
        return pd.DataFrame({"job_id": job, "handed_off_ms": rows["at_ms"]})

    def _hold(self, rows: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(rows):
            jobs = [job if known else None for job, known in zip(rows["job"].tolist(), rows["known"].tolist())]
            self.open.put(list(zip(jobs, rows["at_ms"].tolist())))
            self.handle.registerTimer(int(rows["at_ms"].min()) + self.timeout_ms)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        new = new[new["kind"].isin(["handoff", "completed"]) & new["at_ms"].notna()].astype({"at_ms": "int64"})
        df = pd.concat([self._held(), new[["job", "known", "at_ms", "kind"]]], ignore_index=True)
        # Of one moment, the hand-off comes before the completion.
        df["done"] = df["kind"] == "completed"
        df = df.drop_duplicates(["job", "known", "at_ms", "done"]).sort_values(["known", "job", "at_ms", "done"], ignore_index=True)
        done = (df["done"] & df["known"]).to_numpy()
        job, at, n = df["job"].to_numpy(), df["at_ms"].to_numpy(), len(df)
        # The completion that decides a hand-off is the next one of its job.
        next_done = np.minimum.accumulate(np.where(done, np.arange(n), n)[::-1])[::-1]
        at_next = np.minimum(next_done, n - 1)
        decided = (next_done < n) & (job[at_next] == job) & df["known"].to_numpy()
        handoff = ~df["done"].to_numpy()
        late = df[handoff & decided & (at[at_next] > at + self.timeout_ms)]
        if len(late):
            yield self._late(late)
        self._hold(df[handoff & ~decided])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = held["at_ms"] + self.timeout_ms <= now
        if due.any():
            yield self._late(held[due])
        self._hold(held[~due])

    def close(self) -> None:
        pass


def callback_timeout_stream(
    events: DataFrame, ts: str, delay: str = "1 minute", timeout_ms: int = CALLBACK_MS, groups: int = GROUPS
) -> DataFrame:
    """Hand-offs (job_id, handed_off_ms) that saw no completion within the timeout.

    ``events``: job_id, kind (handoff or completed), and the event time ``ts``; those without a time are left out.
    A hand-off is held until the next completion of its job or the watermark has passed its timeout. Jobs are
    dealt over ``groups`` groups, in each of which a micro-batch is decided at once.
    """
    use_rocksdb(events.sparkSession)
    df = events.withWatermark(ts, delay).select(
        F.pmod(F.xxhash64("job_id"), F.lit(groups)).alias("_group"), F.coalesce(F.col("job_id").cast("long"), F.lit(0)).alias("job"),
        F.col("job_id").isNotNull().alias("known"), F.unix_millis(ts).alias("at_ms"), "kind", ts,
    )
    return df.groupBy("_group").transformWithStateInPandas(
        CallbackTimeout(timeout_ms),
        outputStructType="job_id bigint, handed_off_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def callback_timeouts(events: DataFrame, at_ms: str, now_ms: int | None = None, timeout_ms: int = CALLBACK_MS) -> DataFrame:
    """The same on a table: hand-offs without a completion up to the timeout, as of ``now_ms``.

    The completion that decides a hand-off is the next one of its job. It is found by one ordered pass
    from the last event to the first, cut into blocks of time, so a busy job is neither paired with all
    its events nor kept in one task. A hand-off without a job has no completion.
    """
    done = (F.col("kind") == "completed") & F.col("job_id").isNotNull()
    rows = events.where(F.col("kind").isin("handoff", "completed")).select("job_id", "kind", F.col(at_ms).cast("long").alias("_at"))
    # Backwards in time; of one moment, completions come first.
    rows = rows.withColumn("_o", -2 * F.col("_at") + (F.col("kind") == "handoff").cast("long"))
    block = F.floor(F.col("_o") / (2 * timeout_ms))
    rows = forward_fill(rows, ["job_id"], "_o", F.when(done, F.col("_at")), "_next", block)
    ok = F.coalesce(F.col("_next") <= F.col("_at") + timeout_ms, F.lit(False))
    late = rows.where((F.col("kind") == "handoff") & ~ok).select("job_id", F.col("_at").alias("handed_off_ms")).distinct()
    return late if now_ms is None else late.where(F.col("handed_off_ms") + timeout_ms <= now_ms)
