"""Late hand-offs of a table, against all pairs; and a job of many events."""

import random
import tempfile

from pyspark.sql import functions as F

from corpusloom.streaming.callbacks import CALLBACK_MS, callback_timeout_stream, callback_timeouts


def by_hand(rows, now=None):
    late = set()
    for job, kind, at in rows:
        if kind == "handoff":
            done = job is not None and at is not None and any(
                j == job and k == "completed" and z is not None and at <= z <= at + CALLBACK_MS for j, k, z in rows
            )
            if not done and (now is None or (at is not None and at + CALLBACK_MS <= now)):
                late.add((job, at))
    return late


def test_equals_all_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["handoff", "completed", "other"]), rng.choice([None, 0, *range(-3_000_000, 3_000_000, 60_000)])) for _ in range(400)]
    rows += [(9, "handoff", 5), (9, "completed", 5), (10, "handoff", 0), (10, "completed", CALLBACK_MS), (11, "handoff", 0), (11, "completed", CALLBACK_MS + 1)]
    events = spark.createDataFrame(rows, "job_id long, kind string, t long")
    assert sorted(map(tuple, callback_timeouts(events, "t").collect()), key=repr) == sorted(by_hand(rows), key=repr)
    got = callback_timeouts(events, "t", now_ms=500_000).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(by_hand(rows, 500_000), key=repr)


def test_one_busy_job(spark):
    n = 100_000
    events = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), F.lit("handoff").alias("kind"), (F.col("id") * 1000).alias("t"))
    done = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), F.lit("completed").alias("kind"), (F.col("id") * 1000 + 10).alias("t"))
    # Without the completions of the last quarter, hand-offs from ten minutes before them on are late.
    out = callback_timeouts(events.unionByName(done.where(f"id < {3 * n // 4}")), "t")
    assert out.count() == n // 4


def test_stream_equals_the_table(spark):
    rng = random.Random(3)
    rows = [(rng.choice([*range(12), None]), rng.choice(["handoff", "completed", "other"]), rng.randrange(60_000, 9_000_000, 60_000)) for _ in range(300)]
    # Handed off twice and never completed; a job beyond 53 bits.
    rows += [(20, "handoff", 500), (20, "handoff", 1000), (2**60 + 1, "handoff", 5), (2**60, "completed", 6), (30, "other", 9_000_000), (31, "other", None)]
    rows.sort(key=lambda r: -1 if r[2] is None else r[2])
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k in range(3):
        part = spark.createDataFrame(rows[k * 102 : (k + 1) * 102], "job_id long, kind string, t long")
        part.withColumn("ts", F.timestamp_millis("t")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    schema = "job_id long, kind string, t long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    late = callback_timeout_stream(stream, "ts", groups=5)
    late.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    got = sorted(map(tuple, spark.read.schema(late.schema).parquet(f"{path}/out").collect()), key=repr)
    end = 9_000_000 - 60_000
    known = {(j, a) for j, k, a in rows if k == "handoff" and any(x == j and j is not None and y == "completed" and z is not None and z > a for x, y, z in rows)}
    want = [r for r in by_hand([r for r in rows if r[2] is not None]) if r in known or r[1] + CALLBACK_MS <= end]
    assert got == sorted(want, key=repr) and (20, 500) in got and (2**60 + 1, 5) in got
