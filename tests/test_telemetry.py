import random

from pyspark.sql import functions as F

from corpusloom.operators import intervals
from corpusloom.operators import telemetry as tm
from corpusloom.operators.ordered import forward_fill, running_max, running_sums
from corpusloom.operators.percentiles import exact_percentiles
from corpusloom.sources.readers import parse_stage_log


def test_percentile_goldens(spark):
    df = spark.createDataFrame([("a", v) for v in (40.0, 10.0, 30.0, 20.0)] + [("b", 7.0), ("c", None), ("d", float("nan"))], "k string, v double")
    out = {r["k"]: (r["p50"], r["p95"]) for r in exact_percentiles(df, ["k"], "v", {"p50": 50, "p95": 95}).collect()}
    assert out == {"a": (25.0, 38.5), "b": (7.0, 7.0)}


def test_percentiles_equal_builtin(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([rng.gauss(0, 1), 5.0, rng.random() * 1e6])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    mine = {r["k"]: tuple(r)[1:] for r in exact_percentiles(df, ["k"], "v", {"a": 1, "b": 50, "c": 99.5}).collect()}
    ref = df.groupBy("k").agg(*[F.percentile("v", p) for p in (0.01, 0.5, 0.995)])
    for r in ref.collect():
        assert all(abs(x - y) < 1e-6 for x, y in zip(mine[r["k"]], tuple(r)[1:]))


def test_saturation_golden(spark):
    levels = spark.createDataFrame(
        [("search", 1, 0.0, 10.0, 100.0), ("search", 2, 0.0, 10.4, 125.0), ("search", 4, 0.0, 10.5, 150.0)],
        "operation string, concurrency int, error_rate double, throughput double, p95_ms double",
    )
    out = tm.detect_saturation(levels).collect()
    assert [(r["concurrency"], r["previous_concurrency"], r["reason"]) for r in out] == [(2, 1, "throughput_plateau_with_latency_growth")]


def test_intervals_against_brute_force(spark):
    rng = random.Random(4)
    samples = [(rng.randint(0, 5000), rng.choice([None, rng.random()])) for _ in range(400)] + [(777, 1.0)] * 50
    spans = []
    for i in range(200):
        a = rng.randint(0, 5200)
        spans.append((i, a, a + rng.choice([0, 1, 3, 64, 65, 1000, 4999])))
    s = spark.createDataFrame(samples, "at long, m double")
    e = spark.createDataFrame(spans, "id int, a long, b long")
    for span in (5000, 1 << 40):
        got = {r["id"]: (r["sample_count"], r["m_mean"], r["m_max"]) for r in intervals.interval_stats(e, s, ["id"], "a", "b", "at", ["m"], span).collect()}
        for i, a, b in spans:
            inside = [m for t, m in samples if a <= t <= b]
            known = [m for m in inside if m is not None]
            n, mean, top = got[i]
            assert n == len(inside) and top == (max(known) if known else None)
            assert (mean is None) == (not known) and (not known or abs(mean - sum(known) / len(known)) < 1e-9)


def test_intervals_longer_than_the_declared_span(spark):
    s = spark.createDataFrame([(t,) for t in range(100)], "at long").withColumn("m", F.lit(1.0))
    e = spark.createDataFrame([(1, 0, 99)], "id int, a long, b long")
    assert intervals.interval_stats(e, s, ["id"], "a", "b", "at", ["m"], 4).first()["sample_count"] == 100


def test_capacity_prefix(spark):
    rows = [
        ("search", "ramp", 1, 1, "s1", "passed", None),
        ("search", "ramp", 4, 3, "s3", "degraded", None),
        ("search", "ramp", 8, 4, "s4", "failed", "p95_latency_exceeded"),
        ("search", "ramp", 16, 5, "s5", "passed", None),
        ("search", "burst", 99, 6, "s6", "passed", None),
        ("ingest", "burst", 2, 7, "s7", "passed", None),
    ]
    df = spark.createDataFrame(rows, "operation string, mode string, concurrency int, sequence int, stage_id string, status string, stop_reason string")
    out = {r["operation"]: tuple(r)[1:] for r in tm.capacity_boundaries(df.withColumn("first_error_type", F.lit(None).cast("string"))).collect()}
    assert out["search"] == (4, 8, "s4", "p95_latency_exceeded", False, 4)
    assert out["ingest"] == (2, None, None, None, True, 1)


def test_blocks_do_not_show(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.randint(0, 9), rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, n int, v int")
    sums = running_sums(df, ["k"], "o", {"s": F.col("n")}, block=F.col("o") / 7)
    tops = running_max(df, ["k"], "o", {"m": F.col("v")}, block=F.col("o") / 7)
    fill = forward_fill(df, ["k"], "o", F.col("v"), "f", block=F.col("o") / 7)
    s, m, f = ({(r["k"], r["o"]): r[c] for r in d.collect()} for d, c in ((sums, "s"), (tops, "m"), (fill, "f")))
    for k in "ab":
        total, top, last = 0, None, None
        for _, o, n, v in (r for r in rows if r[0] == k):
            assert s[k, o] == total and m[k, o] == top
            last = v if v is not None else last
            assert f[k, o] == last
            total += n
            top = v if top is None else max(top, v) if v is not None else top


def test_cpu_and_counters(spark):
    times = spark.createDataFrame(
        [("t", 0, 1, 1.0), ("t", 10, 1, 3.0), ("t", 10, 2, 9.0), ("t", 20, 2, 8.0), ("t", 20, 1, 4.0)], "target string, sampled_at int, pid int, cpu_time double"
    )
    out = tm.cpu_percent(times, "target", F.col("sampled_at") / 10).orderBy("sampled_at").collect()
    assert [r["cpu_percent"] for r in out] == [0.0, 20.0, 10.0]


def test_stage_log(spark):
    good = '{"event":"file_download_completed","file_idx":3,"duration_ms":1.5,"stage":"s"}'
    rows = [
        good,
        good.replace('"file_idx":3', '"file_idx":true'),
        good.replace('"duration_ms":1.5', '"duration_ms":null,"total_duration_ms":2'),
        good.replace('"duration_ms"', '"total_duration_ms"'),
        good.replace("file_download", "file_other"),
        "file_download_completed is no json",
    ]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    assert [(r["file_idx"], r["duration_ms"], r["file_type"]) for r in parse_stage_log(df).collect()] == [(3, 1.5, "unknown"), (3, 1.5, "unknown")]


def test_failures(spark):
    rows = [(1, False, "ReadTimeout", None), (2, False, "X", "CUDA OOM"), (3, False, "Odd", None), (4, True, "ReadTimeout", None), (1, False, "timed out", None)]
    df = spark.createDataFrame(rows, "request_id int, success boolean, error_type string, error_message string")
    df = df.select("*", F.monotonically_increasing_id().alias("request_index"), F.lit("search").alias("operation"), F.lit(500).alias("status_code"), F.lit(1.0).alias("duration_ms"))
    assert {(r["category"], r["request_id"]) for r in tm.classify_failures(df).collect()} == {("timeout", 1), ("oom", 2)}


def test_cells_are_not_broadcast(spark):
    spans = spark.createDataFrame([(1, 0, 50), (2, 40, 40)], "event_id long, start_us long, end_us long")
    samples = spark.createDataFrame([(10, 1.0), (40, 3.0)], "at_us long, m double")
    out = intervals.interval_stats(spans, samples, ["event_id"], "start_us", "end_us", "at_us", ["m"], 1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_level" in plan and "HashJoin [_level" not in plan
    assert {r["event_id"]: (r["sample_count"], r["m_mean"]) for r in out.collect()} == {1: (2, 2.0), 2: (1, 3.0)}
