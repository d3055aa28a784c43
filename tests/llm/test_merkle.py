"""The manifest against trees that are built node by node."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string, leaf string, _k string, proof int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, source, lang, n_chars, text = row[:5]
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest(*values)


def tree(leaves, fanout):
    """Root and, for each leaf, the siblings on its way."""
    level, at, ways = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, place in enumerate(at):
            start = place - place % fanout
            ways[i].append(("".join(level[start:place]), "".join(level[place + 1 : start + fanout])))
        level = [digest(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], ways


def by_hand(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row)))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    made = {k: tree([x[2] for x in sorted(groups[k])], fanout) for k in order}
    root, over = tree([made[k][0] for k in order], fanout)
    found = Counter()
    for place, k in enumerate(order):
        for (known, doc_id, leaf), way in zip(sorted(groups[k]), made[k][1]):
            found[doc_id if known else None, leaf, made[k][0], root, tuple(way + over[place])] += 1
    return found


def planted():
    rows = []
    for lang, n in ((None, 3), ("", 1), ("de", 64), ("en", 65), ("fr", 700), ("é", 17)):
        rows += [(len(rows) * 7 % 5000, "s", lang, i, f"text {i} ü", "x", "y", 1) for i in range(n)]
    rows += [rows[5], rows[5], (rows[5][0], None, "de", None, None, "x", "y", 1), (None, "", "de", 1, "", "x", "y", 1), (-4, "a", "fr", 2, "long " * 50_000, "x", "y", 1)]
    return rows


@pytest.mark.parametrize("fanout, levels", [(2, 2), (2, 8), (3, 2)])
def test_manifest(spark, fanout, levels):
    rows = planted()
    docs = spark.createDataFrame(rows, SCHEMA)
    told = merkle.manifest(docs, fanout=fanout, block_levels=levels, carry=[F.col("n_chars")])
    got = told.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    want = by_hand(rows, fanout)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in got) == want
    assert all(r.folded == r.root for r in got)
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r[0], r[3]) for r in rows)


def test_changed_rows_are_found(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    got = merkle.proof_report(docs, changed, F.col("n_chars") + 1).collect()
    want = Counter((i, leaf, sub, root, digest(*(a + b for a, b in way))) for (i, leaf, sub, root, way), n in by_hand(rows, 2).items() for _ in range(n))
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == want
    null_chars = {leaf_of(r) for r in rows if r[3] is None}
    for r in got:
        assert r.verified == (r.folded_root == r.root) == (r.doc_id is None or r.doc_id % 3 != 0 or r.leaf in null_chars)


@pytest.mark.parametrize("rows", [[], planted()[:1], planted()[:4]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(docs).collect()
    want = by_hand(rows, 2) if rows else Counter()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in got) == want
