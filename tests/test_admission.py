"""Eviction and lateness of the admission streams."""

import tempfile

from corpusloom.streaming import admission

SECOND = 1_000_000
START = 1_000_000 * SECOND


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def decide(spark, batches, make, flag):
    """Feed batches one after the other; the decisions, and the state that is left."""
    source, out, state = folder() + "/in", folder(), folder()
    schema = "u long, k string, id long, at_us long"
    for rows in batches:
        spark.createDataFrame([(u, k, i, START + int(t * SECOND)) for u, k, i, t in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = make(stream).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
    decided = {r["id"]: r[flag] for r in spark.read.parquet(out).collect()}
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "times").load()
    return decided, left.count()


def limiter(stream):
    return admission.rate_limit_stream(stream, "u", "at_us", "id", limit=2, window=60 * SECOND, delay="30 seconds")


def test_admitted_times_go_with_the_watermark(spark):
    first = [(u, "", u, u / 100) for u in range(40)]
    late = [(99, "", 99, 500.0)]
    decided, left = decide(spark, [first, late, [(99, "", 100, 500.0)]], limiter, "admitted")
    assert all(decided.values()) and len(decided) == 42
    assert left == 2  # the forty users are gone, both times of the last one are still in its window


def test_out_of_order_requests(spark):
    batches = [
        [(1, "", 1, 100), (1, "", 2, 101)],
        # Before both: they don't count against it. After them: refused. Behind the watermark (71): dropped.
        [(1, "", 3, 90), (1, "", 4, 110)],
        [(1, "", 5, 20), (1, "", 6, 165)],
    ]
    decided, _ = decide(spark, batches, limiter, "admitted")
    assert decided == {1: True, 2: True, 3: True, 4: False, 6: True}


def applier(stream):
    return admission.idempotent_apply_stream(stream, "u", "k", "at_us", "id", ttl=60 * SECOND, delay="120 seconds")


def test_applied_keys_go_with_the_watermark(spark):
    batches = [
        [(1, "a", 1, 100), (1, "a", 2, 159), (1, " ", 3, 100), (2, "a", 4, 100)],
        # 60 s after the last is applied again; one close to an applied one isn't; one far before is.
        [(1, "a", 5, 160), (1, "a", 6, 130), (2, "a", 7, 61), (2, "a", 8, 40)],
        [(3, "b", 9, 400)],
        [(3, "b", 10, 400)],
    ]
    decided, left = decide(spark, batches, applier, "applied")
    assert decided == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: False, 8: True, 9: True, 10: False}
    assert left == 1
