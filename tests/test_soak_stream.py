"""The soak stream against the batch operator, on windows that are over."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.telemetry import soak_windows
from corpusloom.streaming import soak

RECORDS = "case_id string, started_epoch double, completed_epoch double, duration_ms double, success boolean"
SAMPLES = "case_id string, epoch double, target_rss_bytes bigint, target_gpu_bytes bigint, threads int, handles int"


@pytest.mark.parametrize("seed", range(20))
def test_percentile_of_counts(seed):
    rng = random.Random(seed)
    values = [rng.choice([1.0, 2.5, 7.0, -3.0, 100.0]) for _ in range(rng.randint(1, 30))]
    counts = sorted((v, values.count(v)) for v in set(values))
    for p in (0, 50, 95, 99, 100):
        assert soak.percentile_of_counts(counts, p) == pytest.approx(float(np.percentile(values, p)))
    assert soak.percentile_of_counts([], 50) is None


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def as_stream(spark, rows, schema, parts):
    """Rows as files that are read one in each micro-batch."""
    path = folder() + "/in"
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_closed_windows_equal_the_batch(spark):
    rng = random.Random(4)
    start = 1_000_000.0
    records, samples = [], []
    for w in range(6):
        case, at = f"soak-window-{w}", start + w * 1000
        for i in range(40):
            began = at + rng.random() * 300
            ms = None if i == 7 else float(rng.choice([10, 20, 20, 35, 400]))
            records.append((case, began, began + 0.5, ms, rng.choice([True, True, False, None])))
        if w != 2:  # a window without samples
            for i in range(50):
                samples.append((case, at - 100 + i * 10, rng.choice([5, 7, 9]) * 1000, rng.choice([None, 3]), rng.randint(1, 4), 8))
    samples.append(("soak-window-99", start, 1, 1, 1, 1))  # samples without requests
    records.append(("other", start, start + 1, 5.0, True))
    # Later rows, so that the watermarks pass the first windows.
    records.append(("soak-window-9", start + 9000, start + 9001, 5.0, True))
    samples.append(("soak-window-9", start + 9000, 1, 1, 1, 1))
    records.sort(key=lambda r: r[2])
    samples.sort(key=lambda r: r[1])

    asked, sampled = as_stream(spark, records, RECORDS, 3), as_stream(spark, samples, SAMPLES, 3)
    out, state = folder(), folder()
    stream = soak.soak_case_stream(asked, sampled, delay="2 hours", pause=500.0)
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = {r.case_id: r.asDict() for r in spark.read.schema(stream.schema).parquet(out).collect()}
    batch = soak_windows(spark.createDataFrame(records, RECORDS), spark.createDataFrame(samples, SAMPLES))
    over = start + 9000 - 7200 - 500
    want = {r.case_id: r.asDict() for r in batch.where(F.col("completed_epoch") < over).collect()}
    assert len(want) >= 1 and got.keys() == want.keys()
    for case, row in want.items():
        assert got[case].keys() == row.keys()
        for name, value in row.items():
            other = got[case][name]
            assert (value is None and other is None) or value == other or math.isclose(value, other, rel_tol=1e-12), (case, name, value, other)
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "latencies").load()
    cases = {r.key.case_id for r in left.select("key").distinct().collect()}
    assert not cases & want.keys() and "soak-window-9" in cases


def test_state_holds_equal_rows_once():
    """A batch of rows is one block of the state, in which equal rows and missing values count."""
    rows = np.array([[1.0, np.nan], [1.0, np.nan], [2.0, 5.0], [1.0, np.nan]])
    back = soak._rows([(soak._block(rows),), (soak._block(rows[2:3]),)], 3)
    assert sorted(map(str, back)) == sorted(map(str, np.array([[1.0, np.nan, 3.0], [2.0, 5.0, 1.0], [2.0, 5.0, 1.0]])))
    values, counts = soak._equal(back[:, 1], back[:, 2])
    assert values.tolist() == [5.0] and counts.tolist() == [2]
    assert soak._equal(*soak._rows([], 2).T)[0].tolist() == [] and soak._mean(values, counts) == 5.0
