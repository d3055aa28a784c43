"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(words):
    grams = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]
    return [zlib.crc32(g.encode()) % importance.BUCKETS for g in grams]


def by_hand(docs, target, percent=25, least=20):
    found = [(i, words_of(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, words in found:
        s.update(buckets_of(words))
    for text in target:
        t.update(buckets_of(words_of(text)))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, words in found:
        own = buckets_of(words)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in own)
        weight = total // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=40))
def test_hashes_equal_the_library(pieces):
    sizes = np.array([len(p) for p in pieces])
    slices = importance.Slices(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert slices.hashes().tolist() == [xxhash.xxh64_intdigest(p) for p in pieces]


@pytest.mark.parametrize("equal_hashes", [False, True])
def test_interning_tells_slices_apart_by_their_bytes(equal_hashes):
    rng = np.random.default_rng(3)
    pieces = [b"x" * 20 + bytes([65 + k % 7]) + b"y" * (k % 30) for k in rng.integers(0, 200, 500).tolist()]
    sizes = np.array([len(p) for p in pieces])
    slices = importance.Slices(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes)
    hashes = np.full(len(pieces), 9, np.uint64) if equal_hashes else slices.hashes()
    table = importance.intern(slices, hashes)
    assert len(table.owner) == len(set(pieces))
    assert [pieces[table.owner[s]] for s in table.slot] == pieces
    assert {pieces[o]: n for o, n in zip(table.owner, table.count.tolist())} == Counter(pieces)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.", max_size=120)), max_size=6), st.integers(1, 40))
def test_cut_texts_hold_the_same_ngrams(texts, block):
    before = importance.BLOCK_BYTES
    importance.BLOCK_BYTES = block
    try:
        got, words = Counter(), []
        for first, end, blocks in importance.blocks_of(pa.array(texts, pa.string())):
            own = sum(b.words for b in blocks)
            words += own.tolist()
            for b in blocks:
                got.update(zip((b.text + first).tolist(), b.bucket[b.table.slot].tolist()))
    finally:
        importance.BLOCK_BYTES = before
    assert words == [len(words_of(t)) for t in texts]
    assert got == Counter((i, b) for i, t in enumerate(texts) for b in buckets_of(words_of(t)))


def test_resampling(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, int(n)) % 500) for n in rng.integers(0, 60, 200)]
    docs = [*enumerate(texts), (300, None), (301, ""), (302, "Éa \x85é. A-b_c " * 30), (None, "no id " * 30), (7, texts[7]), (7, texts[7]), (303, "long word" * 40_000)]
    target = ["w1 w2 w3 w4", None, "W9 w9, w9"]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, weight string, _i int")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert Counter(map(tuple, importance.resample(table, wanted).collect())) == by_hand(docs, target)
    assert Counter(map(tuple, importance.resample(table, wanted.limit(0)).collect())) == by_hand(docs, [])
    assert importance.resample(table.limit(0), wanted).count() == 0
