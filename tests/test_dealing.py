"""What a task holds is bounded: shuffles have as many partitions as the rows need, not the session's number."""

import pytest

import __spark_entry__ as entry
from corpusloom.operators import dealing, index, ordered

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def dealt(spark, monkeypatch):
    """Small partitions, and no table small enough to be broadcast."""
    monkeypatch.setattr(dealing, "ROWS_PER_PARTITION", 400)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_owned_row_counts_are_dealt(dealt, capsys):
    """The counts are single rows, so the plan tells how their join was dealt."""
    entry.queries()["owned_row_counts"](dealt, SMALL).explain(True)
    plan = capsys.readouterr().out
    lines = dealt.read.parquet(f"{SMALL}/lineitem.parquet").count()
    n = dealing.partitions_for(dealt, lines)
    assert n >= lines // 400 and f"RepartitionByExpression [users_idx" in plan and f", {n}" in plan


@pytest.mark.parametrize(
    "name",
    [
        "versioned_chunk_stream",
        "mark_success_if_current",
        "mark_document_indexed_if_current",
        "soft_delete_superseded",
        "stale_version_guard",
        "metadata_version_upsert",
        "versioned_metadata_stream",
    ],
)
def test_partitions_follow_rows(dealt, name):
    lines = dealt.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert entry.queries()[name](dealt, SMALL).rdd.getNumPartitions() >= lines // 400


def test_folders_of_proposals_are_dealt(dealt, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_PER_PARTITION", 150)
    orders = dealt.read.parquet(f"{SMALL}/orders.parquet").count()
    assert entry.queries()["needed_new_folders"](dealt, SMALL).rdd.getNumPartitions() >= orders // 150


def test_small_and_large_files_agree(spark, monkeypatch):
    """Callbacks give the same metadata whether a file's versions run in one window or in blocks."""
    stored = spark.createDataFrame([(1, "a", "READY", 2), (2, None, "PROCESSING", None)], "file_idx bigint, summary string, extraction_status string, index_version int")
    calls = [(1, 10, True, 1, "old"), (1, 9000, True, 3, "b"), (1, 20000, False, 2, "late"), (1, 30000, False, None, "x"), (2, 5, True, 4, "c"), (3, 1, True, 1, "none")]
    incoming = spark.createDataFrame(calls, "file_idx bigint, seq bigint, success boolean, index_version int, summary string")
    want = [(1, "b", "FAILED", 3), (2, "c", "READY", 4), (3, "none", "READY", 1)]
    for most in (0, 3, 100):
        monkeypatch.setattr(ordered, "LARGE_GROUP", most)
        for n in (None, 5):
            assert sorted(map(tuple, index.metadata_version_upsert(stored, incoming, ["summary"], n).collect())) == want
