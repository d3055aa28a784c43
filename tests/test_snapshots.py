"""Snapshot commits of the index and compaction of the logs, with losses between the steps."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.index import metadata_version_upsert
from corpusloom.sources import sinks, snapshots
from corpusloom.streaming import upserts


class Lost(Exception):
    pass


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def lose(monkeypatch, step, after=0):
    """The named step of the snapshots module fails at its call number ``after``."""
    calls, plain = [0], getattr(snapshots, step)

    def failing(*args, **kwargs):
        calls[0] += 1
        if calls[0] > after:
            raise Lost
        return plain(*args, **kwargs)

    monkeypatch.setattr(snapshots, step, failing)


def index_rows(spark, path):
    return sorted(map(tuple, sinks.read_index(spark, path).collect()))


def test_a_lost_write_leaves_the_earlier_index(spark, monkeypatch):
    path = folder() + "/index"
    columns = "chunk_id string, users_idx bigint, n int"
    sinks.write_index(spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, 1)], columns), path, buckets=4)
    before = index_rows(spark, path)
    opened = sinks.read_index(spark, path)
    change = spark.createDataFrame([("a", 2, 2), ("d", 9, 2)], columns)
    with monkeypatch.context() as m:
        lose(m, "publish")
        with pytest.raises(Lost):
            sinks.write_index(change, path, buckets=4)
    assert index_rows(spark, path) == before
    sinks.write_index(change, path, buckets=4)
    after = [("a", 2, 2), ("b", 2, 1), ("c", 3, 1), ("d", 9, 2)]
    assert index_rows(spark, path) == after
    assert sorted(map(tuple, opened.collect())) == before  # a reader from before still reads
    for lost in range(3):
        with monkeypatch.context() as m:
            lose(m, "remove_folder", lost)
            try:
                sinks.clean_index(spark, path)
            except Lost:
                pass
        assert index_rows(spark, path) == after
    sinks.clean_index(spark, path)
    assert index_rows(spark, path) == after and sorted(map(tuple, opened.collect())) == before
    assert sinks.read_index(spark, path, owners=[1]).count() == 0
    assert sorted(r.chunk_id for r in sinks.read_index(spark, path, owners=[2, 9]).collect()) == ["a", "b", "d"]


def test_a_number_is_published_once(spark):
    path = folder() + "/snapshots"
    snapshots.publish(spark, path, 1, {"a": "ü"})
    with pytest.raises(FileExistsError):
        snapshots.publish(spark, path, 1, {"a": 2})
    assert snapshots.current(spark, path) == (1, {"a": "ü"})
    for n in range(2, 12):
        snapshots.publish(spark, path, n, {"a": n})
    assert snapshots.current(spark, path) == (11, {"a": 11})
    assert snapshots.retire(spark, path) == [{"a": 10}, {"a": 11}]


def test_an_index_keeps_its_buckets(spark):
    path = folder() + "/index"
    points = spark.createDataFrame([("a", 1)], "chunk_id string, users_idx bigint")
    with pytest.raises(FileNotFoundError):
        sinks.read_index(spark, path)
    sinks.write_index(points, path, buckets=4)
    with pytest.raises(ValueError):
        sinks.write_index(points, path, buckets=8)


LOG = "file_idx bigint, index_version bigint, chunk_id string"


def versions(rng, batch):
    return [(f, rng.randint(1, 6), f"{batch}-{f}-{i}") for f in rng.sample(range(8), 3) for i in range(2)]


def newest(base, batches):
    """State by hand: per file the rows of the version that last was not older."""
    state = {f: (v, [c]) for f, v, c in base}
    for rows in batches:
        best = {}
        for f, v, c in rows:
            best.setdefault(f, {}).setdefault(v, []).append(c)
        for f, by in best.items():
            v = max(by)
            if f not in state or v >= state[f][0]:
                state[f] = (v, by[v])
    return sorted((f, v, c) for f, (v, cs) in state.items() for c in cs)


@pytest.mark.parametrize("step, at", [("publish", 0), ("retire", 0), ("remove_folder", 0), ("remove_folder", 1), (None, 0)])
def test_compaction_can_be_lost_at_each_step(spark, monkeypatch, step, at):
    rng = random.Random(5)
    base_rows = [(0, 3, "base"), (20, 1, "base")]
    base = spark.createDataFrame(base_rows, LOG)
    path, outcomes = folder(), folder()
    fn = upserts.versioned_chunk_batch(base, path, outcomes, compact_every=2)
    batches = [versions(rng, b) for b in range(7)]
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, LOG)
        if step and b in (2, 4):
            with monkeypatch.context() as m:
                lose(m, step, at)
                try:
                    fn(df, b)
                except Lost:
                    assert sorted(map(tuple, upserts.chunk_state(base, path).collect())) == newest(base_rows, batches[:b])
        fn(df, b)
        if b == 5:
            fn(df, b)  # a batch that runs again
    assert sorted(map(tuple, upserts.chunk_state(base, path).collect())) == newest(base_rows, batches)
    held = snapshots.names_in(spark, path, "batch=*")
    assert len(held) <= 6 and len(snapshots.names_in(spark, f"{path}/snapshots", "[0-9]*.json")) <= 3


def test_compacted_callbacks_give_the_same_state(spark):
    rng = random.Random(2)
    schema = "file_idx bigint, seq bigint, success boolean, index_version bigint, summary string"
    base = spark.createDataFrame(
        [(f, f"old {f}", "PENDING", f if f % 3 else None) for f in range(6)], "file_idx bigint, summary string, extraction_status string, index_version bigint"
    )
    rows = [(rng.randrange(7), n, rng.random() < 0.6, rng.choice([None, 1, 2, 3, 4, 5]), f"s{n}") for n in range(60)]
    whole = spark.createDataFrame(rows, schema)
    path = folder()
    fn = upserts.metadata_batch(base, path, compact_every=2)
    for b in range(6):
        fn(whole.where(F.col("seq").between(10 * b, 10 * b + 9)), b)
    want = sorted(map(tuple, metadata_version_upsert(base, whole, ["summary"]).collect()))
    assert sorted(map(tuple, upserts.metadata_state(base, path, ["summary"], whole.schema).collect())) == want
    assert upserts.read_log(spark, path, whole.schema).count() <= 20 + 3 * 7 < 60


def test_compacted_uploads_and_updates(spark):
    schema = "u int, k string, n int"
    path, updates = folder(), folder()
    first = upserts.unique_upload_batch(path, spark.createDataFrame([], schema).schema, ["u", "k"], "n", compact_every=2)
    latest = upserts.update_batch(updates, ["u"], compact_every=2)
    for b in range(7):
        df = spark.createDataFrame([(1, "a", b), (1, None, b), (2, f"k{b // 2}", b)], schema)
        first(df, b)
        latest(df.where("k <> 'a'"), b)
    kept = sorted((r.u, r.k or "", r.n) for r in upserts.read_log(spark, path, df.schema).collect())
    assert kept == sorted([(1, "a", 0), *[(1, "", b) for b in range(7)], *[(2, f"k{b}", 2 * b) for b in range(4)]])
    assert [tuple(r) for r in upserts.latest_rows(spark, updates, df.schema, ["u"]).collect()] == [(2, "k3", 6)]
