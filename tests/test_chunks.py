import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.constants import CHUNK_SEPARATORS
from corpusloom.operators import chunks as ch
from corpusloom.operators import units


def slow_spans(text, size, overlap):
    """The chunk rule, spelled out one position at a time."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            lowest = start + max(overlap + 1, size // 2)
            for sep in CHUNK_SEPARATORS:
                spots = [i for i in range(lowest, end - len(sep) + 1) if text[i : i + len(sep)] == sep]
                if spots:
                    end = spots[-1] + len(sep)
                    break
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out += [a, b]
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.!?;, \n　é", max_size=120), st.integers(1, 25), st.integers(0, 24))
def test_chunk_spans(text, size, overlap):
    if overlap < size:
        assert ch.chunk_spans(text, size, overlap) == slow_spans(text, size, overlap)


def test_bad_sizes():
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            ch._check(size, overlap)


def random_docs(n=30):
    rng = random.Random(3)
    words = ["alpha", "beta.", "gamma,", "\n", "  ", "déjà", "x" * 40, "\n\n"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(n)]


def test_line_documents_equal_general_path(spark):
    docs = spark.createDataFrame(random_docs(), "doc_id int, text string")
    lines = units.text_to_line_units(docs, "doc_id", "text")
    cols = ["doc_id", "chunk_index", "content", "start_offset", "end_offset", "unit_index", "unit_start_offset", "unit_end_offset"]
    general = ch.chunk_units(lines, "doc_id", 60, 10).select(*cols).orderBy("doc_id", "chunk_index").collect()
    fused = ch.chunk_line_documents(docs, "doc_id", "text", 60, 10).select(*cols).orderBy("doc_id", "chunk_index").collect()
    assert general == fused and len(fused) > 100


def test_partitions_do_not_matter(spark, monkeypatch):
    from corpusloom.operators import ordered

    monkeypatch.setattr(ordered, "BLOCK_ROWS", 3)
    docs = spark.createDataFrame(random_docs(), "doc_id int, text string")
    one = ch.chunk_units(units.text_to_line_units(docs.coalesce(1), "doc_id", "text"), "doc_id", 60, 10)
    many = ch.chunk_units(units.text_to_line_units(docs.repartition(8), "doc_id", "text"), "doc_id", 60, 10)
    key = ["doc_id", "chunk_index"]
    assert one.orderBy(*key).collect() == many.orderBy(*key).collect()


def test_line_units(spark):
    docs = spark.createDataFrame([(1, "ab \r\n\r\nc\r")], "doc_id int, text string")
    rows = units.text_to_line_units(docs, "doc_id", "text").orderBy("unit_index").collect()
    got = [(r["text"], r["source_char_start"], r["source_char_end"], r["text_char_end"], r["line_break_end"], r["has_line_break"]) for r in rows]
    assert got == [("ab", 0, 3, 2, 4, True), ("", 4, 4, 4, 5, True), ("c", 5, 6, 6, 7, True), ("", 7, 7, 7, 7, False)]


def test_validate_and_dedup(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    chunks = spark.createDataFrame(
        [(1, 0, "a", 0, 1, "x"), (1, 2, "bb", 1, 4, "y"), (2, 0, "c", 0, 1, "x")],
        "doc_id int, chunk_index int, content string, start_offset int, end_offset int, chunk_id string",
    )
    rules = {(r[0], r[1]) for r in ch.validate_chunks(docs, chunks, "doc_id").collect()}
    # An id that two documents bear is told of both, and is no duplicate inside either.
    assert rules == {
        (1, "index_not_contiguous"), (1, "shared_chunk_id"), (1, "span_length_mismatch"), (2, "shared_chunk_id"), (3, "no_chunks"),
    }
    items = chunks.select(F.lit(1).alias("s"), "doc_id", "chunk_index", F.lit("same").alias("content")).withColumn("o", F.struct("doc_id", "chunk_index"))
    located, counts = ch.dedup_by_content_hash(items, ["s"], "o", lambda u: u.withColumn("result", F.length("content")))
    assert located.count() == 3
    assert counts.first().asDict() == {"s": 1, "candidate_count": 3, "unique_count": 1, "deduplicated_count": 2}


def test_sections_and_headings(spark, monkeypatch):
    from corpusloom.operators import ordered

    monkeypatch.setattr(ordered, "BLOCK_ROWS", 2)
    monkeypatch.setattr(units, "BLOCK_ROWS", 2)
    rows = [
        (1, 0, "heading", " H1 ", 1, False),
        (1, 1, "paragraph", "p", None, False),
        (1, 2, "paragraph", "p", None, True),
        (1, 3, "paragraph", "p", None, False),
        (1, 4, "heading", "H2", None, False),
        (1, 5, "paragraph", "p", None, False),
    ]
    blocks = spark.createDataFrame(rows, "d int, i int, unit_type string, text string, heading_level int, ends boolean")
    df = units.carry_heading(units.section_number(blocks, "d", "i", "ends"), "d", "i").orderBy("i")
    got = [(r["section_index"], r["section_title"], r["section_heading_level"]) for r in df.collect()]
    assert got == [(1, "H1", 1), (1, "H1", 1), (1, "H1", 1), (2, None, None), (2, "H2", None), (2, "H2", None)]


def test_budget_skips_but_goes_on(spark):
    items = spark.createDataFrame([(1, 1, 6), (1, 2, 5), (1, 3, 4), (1, 4, 99), (2, 1, 1)], "k int, o int, n int")
    out = units.budget_select(items, ["k"], ["o"], "n", 2, 10).orderBy("k", "o").collect()
    assert [r["selected"] for r in out] == [True, False, True, False, True]


def test_merge_located_units(spark):
    base = spark.createDataFrame([(1, "p1", 0, "a"), (1, "p2", 1, "b"), (1, "p1", 2, "c")], "doc int, anchor string, ordinal int, text string")
    extra = spark.createDataFrame([(1, "p1", 0, "x"), (1, None, 1, "y"), (1, "p9", 2, "z"), (1, "p2", 3, "w")], "doc int, anchor string, ordinal int, text string")
    out = units.merge_located_units(base, extra, "doc").orderBy("unit_index").collect()
    assert "".join(r["text"] for r in out) == "abwcxzy"


def test_column_letters(spark):
    df = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (16384,)], "n int")
    assert [r[0] for r in df.select(units.column_letters(F.col("n"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_headings_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(units, "BLOCK_ROWS", 3)
    rng = random.Random(9)
    rows = []
    for d in range(20):
        for i in range(30):
            kind = rng.choice(["heading", "p", "p"])
            rows.append((d, i, kind, rng.choice([" ", f"T{i}"]), rng.choice([None, 0, 2]), rng.choice([1, 1, 1, 2, 0, None])))
    df = spark.createDataFrame(rows, "d int, i int, unit_type string, text string, heading_level int, section_index int")
    got = {(r["d"], r["i"]): (r["section_title"], r["section_heading_level"]) for r in units.carry_heading(df, "d", "i").collect()}
    for d in range(20):
        section, held, first = None, (None, None), True
        for _, i, kind, text, level, sec in (r for r in rows if r[0] == d):
            sec = sec if sec and sec >= 1 else None
            if first or sec != section:
                section, held, first = sec, (None, None), False
            if kind == "heading" and text.strip():
                held = (text.strip(), level if level and level >= 1 else None)
            assert got[d, i] == held


def test_gap_segments(spark):
    from corpusloom.operators.ordered import gap_segments

    rng = random.Random(10)
    rows = [(rng.choice("ab"), i, rng.randint(0, 300)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, id int, at int")
    for at_gap in (False, True):
        got = {r["id"]: r["_segment"] for r in gap_segments(df, ["k"], "at", "id", 4, 13, at_gap).collect()}
        for k in "ab":
            segment, last = 0, None
            for at, i in sorted((r[2], r[1]) for r in rows if r[0] == k):
                if last is not None and (at - last >= 4 if at_gap else at - last > 4):
                    segment += 1
                last = at
                assert got[i] == segment
