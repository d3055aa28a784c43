"""Exact percentiles on groups of odd distributions."""

import random

import numpy as np
import pytest

from corpusloom.operators.percentiles import exact_percentiles

PERCENTS = {"p0": 0, "p50": 50, "p95": 95, "p99": 99, "p100": 100}


def groups():
    rng = random.Random(3)
    return {
        "heavy": [rng.paretovariate(0.3) * rng.choice([-1, 1]) for _ in range(3000)],
        "equal": [7.25] * 500,
        "two": [1.0, 2.0],
        "one": [-3.5],
        "close": [1000 + rng.random() * 1e-6 for _ in range(2000)],
        "zeros": [0.0, -0.0, 0.0, 1e-300, -1e-300],
        "steps": [float(rng.randrange(5)) for _ in range(1000)],
        "wide": [1.7e308, -1.7e308, 0.0, 1.0],
        "uniform": [rng.random() * 1e6 for _ in range(5000)],
    }


def test_all_distributions(spark):
    made = groups()
    rows = [(g, v) for g, values in made.items() for v in values] + [("null", None), ("heavy", None), ("two", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", PERCENTS).collect()}
    assert got.keys() == made.keys()
    for g, values in made.items():
        for name, p in PERCENTS.items():
            want = float(np.percentile(values, p)) if g != "wide" or p != 95 and p != 99 else None
            if want is not None:
                assert got[g][name] == pytest.approx(want, rel=1e-12, abs=1e-300), (g, name)


def test_without_keys(spark):
    values = groups()["heavy"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_percentiles(df, [], "v", PERCENTS).first()
    assert [row[n] for n in PERCENTS] == pytest.approx([float(np.percentile(values, p)) for p in PERCENTS.values()], rel=1e-12)
    assert exact_percentiles(df.limit(0), [], "v", PERCENTS).count() == 0
