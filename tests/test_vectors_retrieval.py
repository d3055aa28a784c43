import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as rt
from corpusloom.operators import vectors as vx


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vx, "POINTS_PER_BLOCK", 7)
    monkeypatch.setattr(vx, "REQUESTS_PER_BLOCK", 3)
    rng = np.random.default_rng(1)
    points = []
    for i in range(120):
        v = rng.normal(size=8) if i % 10 else np.ones(8)
        points.append((i, int(i % 2), int(rng.integers(0, 4)), bool(i % 7), [float(x) for x in v]))
    requests = [(r, r % 2, [0, 1, 1], [float(x) for x in rng.normal(size=8)], 1 + r % 6, 0.1 if r % 3 else None) for r in range(20)]
    p = spark.createDataFrame(points, "chunk_id long, users_idx int, file_idx int, is_active boolean, embedding array<double>")
    q = spark.createDataFrame(requests, "request_id long, user_idx int, file_idxs array<int>, query_vector array<double>, top_k int, score_threshold double")
    want = set()
    for rid, user, files, vec, k, low in requests:
        scored = []
        for cid, owner, file, active, emb in points:
            if owner == user and active and file in files:
                s = round(float(np.dot(vec, emb) / np.linalg.norm(vec) / np.linalg.norm(emb)), 9)
                if low is None or s >= low:
                    scored.append((-s, cid))
        want |= {(rid, cid, n + 1) for n, (_, cid) in enumerate(sorted(scored)[:k])}
    got = {(r["request_id"], r["chunk_id"], r["rank"]) for r in vx.cosine_topk(q, p).collect()}
    assert got == want
    assert vx.validate_hits(vx.cosine_topk(q, p), q).count() == 0


def truncate(s, n):
    return s if len(s) <= n else "…"[:n] if n <= 1 else s[: n - 1].rstrip() + "…"


def test_packing_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for request in range(60):
        for rank in range(1, rng.randint(2, 9)):
            body = "".join(rng.choice("ab  ") for _ in range(rng.randint(1, 40))) + "z"
            rows.append((request, rank, rank, rng.randint(1, 3), body))
    hits = spark.createDataFrame(rows, "request_id int, rank int, chunk_id int, file_idx int, content string")
    for total in (30, 31, 57):
        got = {(r["request_id"], r["chunk_id"]): r["prompt_content"] for r in rt.pack_context_lookup(hits, total, 20).collect()}
        robin = {(r["request_id"], r["chunk_id"]): r["content"] for r in rt.pack_context_round_robin(hits, 2, total, 20).collect()}
        want, want_robin = {}, {}
        for request in range(60):
            mine = [r for r in rows if r[0] == request]
            left, n = total, 0
            for _, _, cid, _, body in mine:
                s = body.strip()
                limit = min(20, left)
                if left <= 0 or (n and len(s) > limit and limit <= 1):
                    break
                n += 1
                want[request, cid] = truncate(s, limit)
                left -= min(len(s), limit)
            groups = {}
            for r in mine:
                groups.setdefault(r[3], []).append(r)
            left, stop = total, False
            for position in range(2):
                for members in groups.values():
                    if left <= 0 or stop or position >= len(members):
                        continue
                    s = members[position][4].strip()
                    cut = truncate(s, min(20, left))
                    if cut == "…" and s != "…":
                        stop = True
                        continue
                    want_robin[request, members[position][2]] = cut
                    left -= len(cut)
        assert got == want
        assert robin == want_robin


def test_citations(spark):
    answers = spark.createDataFrame(
        [
            (1, "a [SOURCE-2] b [SOURCE-1] [SOURCE-2]", None),
            (2, "none", None),
            (3, "[SOURCE-1]", ["SOURCE-2"]),
            (4, "[SOURCE-1][SOURCE-0]", None),
            (5, "[SOURCE-1]", ["SOURCE-1"]),
        ],
        "request_id int, answer string, declared array<string>",
    )
    sources = spark.createDataFrame([(r, f"SOURCE-{i}", f"c{i}") for r in range(1, 6) for i in (1, 2)], "request_id int, source_id string, chunk_id string")
    good, bad = rt.validate_citations(answers, sources)
    assert {(r["request_id"], r["rule"]) for r in bad.collect()} == {
        (2, "citation_required"),
        (3, "declared_citation_mismatch"),
        (4, "unknown_source"),
    }
    assert [r["source_id"] for r in good.where("request_id = 1").orderBy("citation_index").collect()] == ["SOURCE-2", "SOURCE-1"]


def test_remap_swaps_without_collision(spark):
    partials = spark.createDataFrame(
        [(1, 0, 10, "x [SOURCE-2] y [SOURCE-1]"), (1, 1, 11, "[SOURCE-1] z")], "request_id int, group_rank int, file_idx int, answer string"
    )
    out = {r["file_idx"]: (r["answer"], r["source_ids"]) for r in rt.remap_sources(partials).collect()}
    assert out == {10: ("x [SOURCE-1] y [SOURCE-2]", ["SOURCE-1", "SOURCE-2"]), 11: ("[SOURCE-3] z", ["SOURCE-3"])}


def test_budget_audit(spark):
    calls = spark.createDataFrame(
        [(1, 1, 50, None, 40, 10), (1, 2, 70, 5, 1, 1), (1, 3, 20, 5, 20, 6), (1, 4, 10, None, 10, 4)],
        "request_id int, call_index int, estimated_input int, requested_output int, input_tokens int, output_tokens int",
    )
    out = rt.budget_audit(calls, per_call=12, max_calls=3, max_input=100, max_output=20).orderBy("call_index").collect()
    assert [(r["output_limit"], r["exceeded"]) for r in out] == [(12, None), (None, "input_tokens"), (5, "output_tokens"), (4, None)]


def test_classify(spark):
    rows = [("Compare the two files", 2), ("compare", 1), ("문서별로 정리", 3), ("What is compared?", 2)]
    df = spark.createDataFrame(rows, "q string, n int")
    assert [r[0] for r in df.select(rt.classify_query(F.col("q"), F.col("n"))).collect()] == ["synthesis", "lookup", "synthesis", "lookup"]


def test_metadata_merge(spark):
    df = spark.range(1).select(
        vx.metadata_json(
            vx.extract_source_metadata(
                F.create_map(F.lit("page_number"), F.lit("2")),
                F.create_map(F.lit("page"), F.lit("9"), F.lit("a"), F.lit("b"), F.lit("z"), F.lit(None).cast("string")),
            )
        )
    )
    assert df.first()[0] == '{"a":"b","page_number":"2"}'
