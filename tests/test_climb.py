"""Roots, depths and cycles by doubling, against walks one step at a time."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import trees as tr


def walk(parent, node):
    """Depth and root, or nothing if the way never ends."""
    seen, depth = {node}, 0
    while parent[node] is not None and parent[node] in parent:
        node = parent[node]
        if node in seen:
            return None, None
        seen.add(node)
        depth += 1
    return depth, node


@pytest.mark.parametrize("seed", range(3))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    rows, parents = [], {}
    for key in range(4):
        own = {}
        for n in range(60):
            own[n] = rng.choice([None, 1000, rng.randrange(n) if n else None, rng.randrange(60) if key == 3 else None, n - 1 if n else None])
        parents[key] = own
        rows += [(key, n, p) for n, p in own.items()]
    nodes = spark.createDataFrame(rows, "k int, n long, p long")
    got = {(r.k, r.n): (r.depth, r.root) if not r.cyclic else (None, None) for r in tr.climb(nodes, "n", "p", ["k"]).collect()}
    assert got == {(k, n): walk(own, n) for k, own in parents.items() for n in own}


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    kind = type(spark.range(1))
    rounds, plain = [0], kind.checkpoint

    def counted(self, *args, **kwargs):
        rounds[0] += 1
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(kind, "checkpoint", counted)
    chain = spark.range(10_000).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    out = tr.climb(chain, "n", "p")
    assert out.where("depth = n AND root = 0 AND NOT cyclic").count() == 10_000
    assert rounds[0] <= 16


def test_purge_counts_from_the_highest_root(spark):
    parent = {1: None, 2: 1, 3: 2, 4: 3, 5: 1, 6: 6, 7: 8, 8: 9, 9: 7, 10: 9, 11: 10}
    folders = spark.createDataFrame(list(parent.items()), "folder_idx long, parent_folder_idx long")
    roots = spark.createDataFrame([(2,), (3,), (8,), (99,)], "folder_idx long")
    got = {r.folder_idx: r.depth for r in tr.purge_order(folders, roots).collect()}
    assert {k: got[k] for k in (2, 3, 4)} == {2: 0, 3: 1, 4: 2}
    assert got.keys() == {2, 3, 4, 7, 8, 9, 10, 11}  # of a cycle with a root, all


def test_paths_of_deep_shapes(spark):
    shapes = spark.createDataFrame([(1, n, n - 1 if n else None, n % 3 + 1) for n in range(40)], "s int, shape_id long, parent_id long, ordinal int")
    rows = {r.shape_id: r for r in tr.shape_tree_paths(shapes, ["s"]).collect()}
    assert rows[39].shape_path == ".".join(str(n % 3 + 1) for n in range(40)) and rows[39].shape_depth == 40


def test_proposed_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "d"), ("f", "gone"), ("c2", "c2"), ("t", None), ("t", "u"), ("u", "t"), (None, "a")]
    proposed = spark.createDataFrame([(7, i, p) for i, p in rows], "proposal_id long, temp_id string, parent_temp_id string")
    depths = tr.proposal_depths(proposed)
    assert sorted(r.temp_id for r in tr.proposal_cycles(depths).collect()) == ["c", "c2", "d", "e", "t", "u"]
    assert {r.temp_id: r.wave for r in tr.creation_waves(proposed).collect()} == {"a": 0, "b": 1, "f": 0}
