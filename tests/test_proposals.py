"""The check of proposals: what its rounds write, how its rows are dealt, and what it counts."""

import random

import pytest

import __spark_entry__ as entry
from corpusloom.operators import dealing
from corpusloom.operators import trees as tr

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def written(spark, monkeypatch):
    """Rows of each checkpoint."""
    kind, rows = type(spark.range(1)), []
    plain = kind.checkpoint

    def counted(self, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        rows.append(out.count())
        return out

    monkeypatch.setattr(kind, "checkpoint", counted)
    return rows


def tables(spark, proposed, mappings=()):
    proposed = spark.createDataFrame(proposed, "proposal_id long, temp_id string, name string, parent_temp_id string, parent_folder_id long")
    mappings = spark.createDataFrame(
        list(mappings), "proposal_id long, file_id long, target_folder_id long, target_temp_id string, new_name string, confidence double"
    )
    owners = spark.createDataFrame([(7, 70), (8, 80)], "proposal_id long, users_idx long")
    files = spark.createDataFrame([(1, 70, None), (2, 80, None), (3, 70, "x")], "file_idx long, users_idx long, deleted_at string")
    folders = spark.createDataFrame([(10, 70, None), (11, 80, None), (12, 70, "x")], "folder_idx long, users_idx long, deleted_at string")
    return proposed, mappings, owners, files, folders


def test_rounds_write_open_ways_only(spark, written):
    roots = [(7, f"r{n}", "n", None, None) for n in range(200)]
    chain = [(7, f"c{n}", "n", f"c{n - 1}" if n else None, None) for n in range(8)]
    ring = [(8, f"o{n}", "n", f"o{(n + 1) % 3}", None) for n in range(3)]
    out = tr.validate_proposal(*tables(spark, roots + chain + ring)).collect()
    assert sorted(map(tuple, out)) == [(8, "cycle", 3)]
    assert max(written) <= 7 + 3 and written[-1] == 3


@pytest.mark.parametrize("partitions", [None, 5])
def test_each_rule_counts_its_rows(spark, partitions):
    proposed = [
        (7, "a", "n", None, None), (7, "a", "n", "b", None), (7, "b", " ", "a", 10), (7, " ", "n", "gone", 11), (7, "d", None, "gone", 12),
        (7, None, "n", None, 99), (8, "e", "n", "a", None), (8, "f", "n", None, 11), (9, "g", " ", "gone", None),
    ]
    mappings = [
        (7, 1, 10, None, None, 0.5), (7, 1, 11, "a", None, 2.0), (7, 2, None, "gone", None, None), (7, 3, None, "gone", None, -1.0),
        (7, None, 12, None, None, 1.0), (7, None, None, "gone", None, 1.0), (8, 2, 11, "e", None, 0.0), (8, 4, None, "a", None, 0.0),
    ]
    got = {(r.proposal_id, r.rule): r.detail for r in tr.validate_proposal(*tables(spark, proposed, mappings), partitions).collect()}
    assert got == {
        (7, "duplicate_temp_id"): 1, (7, "blank_temp_id"): 2, (7, "blank_name"): 2, (7, "two_parents"): 3, (7, "unknown_parent"): 2,
        (7, "foreign_parent_folder"): 3, (7, "cycle"): 2, (7, "missing_file"): 2, (7, "foreign_file"): 2, (7, "duplicate_file"): 1,
        (7, "two_targets"): 1, (7, "unknown_target"): 3, (7, "foreign_target_folder"): 2, (7, "confidence_range"): 2,
        (8, "unknown_parent"): 1, (8, "unknown_target"): 1, (8, "foreign_file"): 1, (8, "two_targets"): 1,
    }


def test_proposals_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_PER_PARTITION", 150)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.read.parquet(f"{SMALL}/orders.parquet").count()
        assert entry.queries()["validate_proposal"](spark, SMALL).rdd.getNumPartitions() >= orders // 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed", range(2))
def test_endless_ways_are_those_that_climb_calls_cyclic(spark, seed):
    rng = random.Random(seed)
    rows = [(k, n, rng.choice([None, 1000, rng.randrange(60), n - 1 if n else None])) for k in range(4) for n in range(60)]
    nodes = spark.createDataFrame(rows, "k int, n long, p long")
    want = {(r.k, r.n) for r in tr.climb(nodes, "n", "p", ["k"]).where("cyclic").collect()}
    assert want and {(r.k, r.n) for r in tr.endless(nodes, "n", "p", ["k"]).collect()} == want
