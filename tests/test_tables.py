import datetime as dt
import random

from pyspark.sql import functions as F

from corpusloom.operators import catalog as ct
from corpusloom.operators import index as ix
from corpusloom.operators import quality as dq
from corpusloom.operators import tasks as tk
from corpusloom.operators import trees as tr

OLD, NEW = dt.datetime(2001, 1, 1), dt.datetime(2002, 1, 1)


def test_closure_survives_cycles_and_missing_parents(spark):
    f = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 4), (7, 99)], "folder_idx long, parent_folder_idx long")
    pairs = {(r["ancestor"], r["descendant"], r["depth"]) for r in tr.folder_closure(f).collect()}
    assert {p for p in pairs if p[1] == 3} == {(3, 3, 0), (2, 3, 1), (1, 3, 2)}
    assert {p for p in pairs if p[1] == 6} == {(6, 6, 0), (4, 6, 1), (5, 6, 2)}
    assert {p for p in pairs if p[1] == 7} == {(7, 7, 0)}


def test_restore_matches_exact_stamps(spark):
    folders = spark.createDataFrame(
        [(1, None, "a", OLD), (2, 1, "b", NEW), (3, 2, "c", NEW), (4, 2, "d", OLD)], "folder_idx long, parent_folder_idx long, name string, deleted_at timestamp_ntz"
    )
    files = spark.createDataFrame(
        [(10, 3, 1, "DELETED", NEW), (11, 3, 1, "DELETED", OLD), (12, 2, 1, "DELETED", NEW)], "file_idx long, folder_idx long, uploads_idx long, status string, deleted_at timestamp_ntz"
    )
    chunks = spark.createDataFrame([(10,)], "file_idx long")
    new_folders, new_files, again = tr.restore_subtree(folders, files, chunks, tr.folder_closure(folders), spark.createDataFrame([(2,)], "folder_idx long"))
    got = {r["folder_idx"]: (r["parent_folder_idx"], r["deleted_at"]) for r in new_folders.collect()}
    assert got == {1: (None, OLD), 2: (None, None), 3: (2, None), 4: (2, OLD)}
    assert {r["file_idx"]: r["status"] for r in new_files.collect()} == {10: "READY", 11: "DELETED", 12: "UPLOADED"}
    assert [r["file_idx"] for r in again.collect()] == [12]


def test_best_folder_prefers_leaf_and_first(spark):
    folders = spark.createDataFrame([(1, None, "Legal", 1), (2, 1, "Contracts", 1), (3, None, "Tax", 1), (4, 1, "x", 1)], "folder_idx long, parent_folder_idx long, name string, users_idx long")
    docs = spark.createDataFrame([(1, 1, "legal contracts of x"), (2, 1, "tax and legal"), (3, 1, "nothing"), (4, 2, "legal")], "doc_id int, users_idx long, text string")
    out = {r["doc_id"]: (r["folder_idx"], r["score"]) for r in tr.best_matching_folder(docs, folders, tr.folder_closure(folders)).collect()}
    assert out == {1: (2, 3), 2: (1, 2)}


def test_search_matches_literally(spark):
    files = spark.createDataFrame(
        [(1, 1, None, "a%b.pdf", "pdf", NEW, None), (2, 1, None, "aXb.pdf", "pdf", NEW, None), (3, 1, None, "a%b.pdf", "pdf", NEW, OLD)],
        "file_idx long, users_idx long, folder_idx long, name string, file_type string, created_at timestamp_ntz, deleted_at timestamp_ntz",
    )
    meta = spark.createDataFrame([(1, '["tagger"]', "t"), (2, '["tag"]', "t")], "file_idx long, tags string, document_type string")
    assert [r["file_idx"] for r in ct.search_files(files, meta, keyword="a%b").collect()] == [1]
    assert [r["file_idx"] for r in ct.search_files(files, meta, tag="tag").collect()] == [2]
    assert ct.search_files(files, meta, date_from="2002-01-01", date_to="2002-01-01").count() == 2


def test_quota_goes_on_after_a_refusal(spark):
    batches = spark.createDataFrame(
        [(1, 1, "k", 50), (1, 2, None, 60), (1, 3, "k", 50), (1, 4, None, 40)], "users_idx long, arrival long, idempotency_key string, incoming_bytes long"
    )
    usage = spark.createDataFrame([(1, 10)], "users_idx long, used_bytes long")
    out = ct.quota_check(batches, usage, 100).orderBy("arrival").collect()
    assert [r["outcome"] for r in out] == ["accepted", "rejected", "existing", "accepted"]


def test_next_title_fills_the_gap(spark):
    titles = spark.createDataFrame([(1, "대화 1"), (1, "대화 3"), (2, "대화 02"), (3, "대화 99999999999")], "users_idx long, title string")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "users_idx long")
    assert {r["users_idx"]: r["number"] for r in ct.next_default_title(titles, users).collect()} == {1: 2, 2: 1, 3: 1, 4: 1}


def test_snapshot_ignores_newer_failures(spark):
    docs = spark.createDataFrame(
        [(1, 7, 9, 1, "INDEXED", 1, None), (2, 7, 9, 2, "INDEXED", 1, None), (3, 7, 9, 3, "INDEXED", 1, OLD)],
        "rag_document_idx long, users_idx long, file_idx long, index_version int, index_status string, chunk_count int, deleted_at timestamp_ntz",
    )
    runs = spark.createDataFrame(
        [(10, 1, 7, 9, "SUCCESS"), (11, 2, 7, 9, "SUCCESS"), (12, 2, 7, 9, "FAILED"), (13, 3, 7, 9, "SUCCESS"), (14, 1, 7, 9, "RUNNING")],
        "run_id long, rag_document_idx long, users_idx long, file_idx long, status string",
    )
    chunks = spark.createDataFrame([("a", 1, 1, 0), ("b", 2, 2, 0), ("c", 2, 1, 0)], "chunk_id string, rag_document_idx long, index_version int, chunk_index int")
    snap = ix.latest_successful_snapshot(docs, runs, chunks)
    assert [r["chunk_id"] for r in snap.collect()] == ["b"]
    assert ix.validate_snapshot(snap).count() == 0


def test_versions_guard(spark):
    stored = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "file_idx long, index_version int")
    incoming = spark.createDataFrame([(1, 4, 2), (2, 5, 2), (3, 6, 0), (4, 1, 1)], "file_idx long, index_version int, n_chunks long")
    out = {r["file_idx"]: r["outcome"] for r in ix.stale_version_guard(stored, incoming).collect()}
    assert out == {1: "STALE", 2: "STORED", 3: "NO_DATA", 4: "STORED"}


def test_metadata_versions_in_order(spark):
    stored = spark.createDataFrame([(1, "s", "READY", 3)], "file_idx long, summary string, extraction_status string, index_version int")
    incoming = spark.createDataFrame(
        [(1, 1, True, 2, "old"), (1, 2, True, 4, "new"), (1, 3, False, None, None), (1, 4, True, 3, "late"), (2, 1, False, 1, None)],
        "file_idx long, seq long, success boolean, index_version int, summary string",
    )
    out = {r["file_idx"]: tuple(r)[1:] for r in ix.metadata_version_upsert(stored, incoming, ["summary"]).collect()}
    assert out == {1: ("new", "FAILED", 4), 2: (None, "FAILED", 1)}


def test_metadata_json_rules(spark):
    rows = [(None,), ('{"a":true}',), ('{"a":{}}',), ('{" b":1,"b":2}',), ("[1]",), (" ",), ('{"a":[{"x":1}]}',)]
    df = ix.merge_snapshot_metadata(spark.createDataFrame(rows, "j string"), "j", {"page": F.lit("3")})
    assert [(r["metadata"], r["problem"]) for r in df.collect()] == [
        ('{"page":3}', None),
        ('{"a":true,"page":3}', None),
        (None, "nested_object"),
        (None, "duplicate_key"),
        (None, "not_an_object"),
        (None, "empty_json"),
        (None, "nested_object"),
    ]


def test_backoff(spark):
    df = spark.createDataFrame([(1,), (3,), (500,)], "n int")
    assert [r[0] for r in df.select(tk.exponential_backoff_ms(F.col("n"), 1000, 60_000)).collect()] == [1000, 4000, 60000]


def test_constraints_pass_nulls(spark):
    df = spark.createDataFrame([(1, "READY", 3), (2, "LOST", None)], "i int, s string, n int")
    out = dq.check_constraints(df, ["i"], [dq.one_of("s", *dq.FILE_STATES), dq.at_least("n", 4)])
    assert {tuple(r) for r in out.collect()} == {(1, "n_minimum"), (2, "s_allowed")}
    assert dq.unique_violations(spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int"), ["k"]).count() == 1


def test_fold_keeps_large_ids_and_null_keys(spark):
    from corpusloom.operators.units import budget_select

    big = 2**60
    rows = [(big + 1, 1, 60, None), (big + 2, 1, 60, big + 1), (None, 1, 60, 5), (None, 2, 60, 6), (None, 3, 40, 7), (1, 1, None, 8), (1, 2, -5, 9)]
    df = spark.createDataFrame(rows, "doc bigint, at int, size bigint, other bigint")
    got = {(r.doc, r.at): (r.selected, r.other) for r in budget_select(df, ["doc"], ["at"], "size", 10, 100).collect()}
    assert got == {
        (big + 1, 1): (True, None), (big + 2, 1): (True, big + 1), (None, 1): (True, 5), (None, 2): (False, 6),
        (None, 3): (True, 7), (1, 1): (False, 8), (1, 2): (False, 9),
    }


def test_null_amounts_do_not_open_quotas(spark):
    from corpusloom.operators.catalog import quota_check
    from corpusloom.operators.retrieval import budget_audit

    rows = [(2**60 + 1, 1, None, None), (2**60 + 1, 2, None, 10**9), (2**60 + 1, 3, "k", 60), (2**60 + 1, 4, "k", 60), (2**60 + 1, 5, None, -1), (None, 6, None, 1)]
    batches = spark.createDataFrame(rows, "users_idx bigint, arrival int, idempotency_key string, incoming_bytes bigint")
    usage = spark.createDataFrame([(2**60 + 1, 20)], "users_idx bigint, used_bytes bigint")
    got = {r.arrival: r.outcome for r in quota_check(batches, usage, 100).collect()}
    assert got == {1: "invalid", 2: "rejected", 3: "accepted", 4: "existing", 5: "invalid", 6: "invalid"}
    calls = [(1, 0, None, None, 5, 5), (1, 1, 900_000_000, None, 5, 5), (1, 2, 10, None, 5, 5), (None, 0, 1, 1, 1, 1)]
    calls = spark.createDataFrame(
        calls, "request_id bigint, call_index int, estimated_input bigint, requested_output bigint, input_tokens bigint, output_tokens bigint"
    )
    got = [(r.call_index, r.output_limit, r.exceeded) for r in budget_audit(calls, 50).collect() if r.request_id]
    assert sorted(got) == [(0, None, "invalid_amount"), (1, None, "input_tokens"), (2, 50, None)]


def test_chunk_ids_are_unique_inside_a_document(spark):
    from corpusloom.operators.chunks import validate_chunks

    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc bigint")
    rows = [(1, 0, "a"), (2, 0, "a"), (2, 1, "b"), (2, 2, "b"), (3, 0, "c")]
    chunks = spark.createDataFrame(
        [(d, i, 0, 1, "x", c) for d, i, c in rows], "doc bigint, chunk_index int, start_offset int, end_offset int, content string, chunk_id string"
    )
    got = sorted((r.doc, r.rule, r.detail) for r in validate_chunks(docs, chunks, "doc").collect())
    assert got == [(1, "shared_chunk_id", 1), (2, "duplicate_chunk_id", 1), (2, "shared_chunk_id", 1)]


def test_percentiles_of_heavy_tails(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from corpusloom.operators.percentiles import exact_percentiles

    df = spark.range(20_000).select(
        (F.col("id") % 3).alias("g"), F.when(F.col("id") == 7, 1e9).otherwise(F.pow(F.col("id") % 6007, F.lit(3.0))).alias("v")
    )
    percents = {"p0": 0.0, "p50": 50.0, "p95": 95.0, "p99": 99.0, "p100": 100.0}
    data = df.toPandas()
    for r in exact_percentiles(df, ["g"], "v", percents).collect():
        values = data[data.g == r.g].v
        for name, p in percents.items():
            assert np.isclose(r[name], np.percentile(values, p))


def test_index_upserts_touch_only_their_buckets(spark, tmp_path):
    import os

    from corpusloom.sources import sinks, snapshots

    path = str(tmp_path / "index")
    rows = [(f"c{i}", i % 10, i) for i in range(200)]
    sinks.write_index(spark.createDataFrame(rows, "chunk_id string, users_idx bigint, n bigint"), path, buckets=8)
    named = lambda: snapshots.current(spark, f"{path}/snapshots")[1]["folders"]
    before = named()
    # One point changes, one is new, and one moves to another owner.
    update = [("c3", 3, -1), ("x", 3, 7), ("c4", 3, 4)]
    sinks.write_index(spark.createDataFrame(update, "chunk_id string, users_idx bigint, n bigint"), path, buckets=8)
    want = {r[0]: r for r in rows} | {r[0]: r for r in update}
    assert {r.chunk_id: tuple(r) for r in sinks.read_index(spark, path).collect()} == want
    # Buckets of other owners are read from where they were.
    after = named()
    rewritten = {b for b in after if after[b] != before.get(b)}
    place = lambda owner: str(spark.range(1).select(sinks.owner_bucket(F.lit(owner), 8).alias("b")).first()["b"])
    assert rewritten == {place(3), place(4)} and set(before) - rewritten and set(after) == set(before)
    own = sinks.read_index(spark, path, owners=[3])
    assert {r.chunk_id for r in own.collect()} == {k for k, r in want.items() if r[1] == 3}
    assert {os.path.basename(os.path.dirname(f)) for f in own.inputFiles()} == {f"owner_bucket={place(3)}"}


def test_index_buckets_that_an_upsert_empties_go(spark, tmp_path):
    from corpusloom.sources import sinks

    path, columns = str(tmp_path / "index"), "chunk_id string, users_idx bigint, n bigint"
    place = lambda owner: spark.range(1).select(sinks.owner_bucket(F.lit(owner), 8).alias("b")).first()["b"]
    old, other = 3, next(o for o in range(100) if place(o) != place(3))
    sinks.write_index(spark.createDataFrame([("a", old, 1), ("b", old, 2), ("c", other, 3)], columns), path, buckets=8)
    # The one owner of a bucket hands over all points.
    sinks.write_index(spark.createDataFrame([("a", other, 4), ("b", other, 5)], columns), path, buckets=8)
    assert sorted(map(tuple, sinks.read_index(spark, path).collect())) == [("a", other, 4), ("b", other, 5), ("c", other, 3)]
    assert sinks.read_index(spark, path, owners=[old]).count() == 0


def test_quota_forgets_keys_after_their_last_arrival(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(3), n // 2, f"k{rng.randrange(n // 2, n // 2 + 12)}" if rng.random() < 0.8 else None, rng.randrange(50)) for n in range(600)]
    batches = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "users_idx long, arrival long, idempotency_key string, incoming_bytes long, n int")
    out = ct.quota_check(batches.orderBy("n"), spark.createDataFrame([(1, 10)], "users_idx long, used_bytes long"), 2500).collect()
    # Batches of one moment come in any order, so the order that was taken is replayed.
    added, seen = {0: 0, 1: 10, 2: 0}, set()
    for user in range(3):
        for r in [r for r in out if r.users_idx == user]:
            if r.idempotency_key is not None and (user, r.idempotency_key) in seen:
                want = "existing"
            elif added[user] + r.incoming_bytes > 2500:
                want = "rejected"
            else:
                want = "accepted"
                added[user] += r.incoming_bytes
                seen.add((user, r.idempotency_key) if r.idempotency_key is not None else None)
            assert r.outcome == want
    state, most = ct._QuotaState(), 0
    for n in range(10_000):
        state.decide(10**9, n, f"k{n // 2}", True, n | 1, 1, 0)
        most = max(most, len(state.open))
    assert most <= 2
