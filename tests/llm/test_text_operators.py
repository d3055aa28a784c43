"""Token counts, byte BPE, packing and language identification against other implementations."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import byte_bpe, language_id, packing, token_counts
from corpusloom.llm.common import fold_of, vocabulary

ODD = [
    None,
    "",
    " ",
    "plain words, it's 12 o'clock",
    "plain words, it's 12 o'clock",
    "\x1c\x1d\x85 \xa0 x\ny\t\r\n  z",
    "日本語の文章 é́ ß ﬁ İ \U0001f600‍",
    "<|endoftext|> is text",
    "ab" * 9000,
    "x " * 3000,
]
SCHEMA = "doc_id bigint, text string, n_tokens string, rank int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1, 0.5) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, ODD[3], "c", 1, 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


def tokens_of(text):
    return token_counts.encoding(vocabulary(token_counts.VOCABULARY)).encode_ordinary(text or "")


def test_length_curve(docs):
    lengths = sorted(len(tokens_of(r.text)) for r in docs.collect())
    rows = {r.n_tokens: r for r in token_counts.token_counts(docs).collect()}
    assert sorted(rows) == sorted(set(lengths))
    for limit, r in rows.items():
        assert r.docs == lengths.count(limit) and r.tokens == limit * r.docs
        assert r.docs_from == sum(n >= limit for n in lengths)
        assert r.tokens_from == sum(n for n in lengths if n >= limit)
        assert (r.docs_all, r.tokens_all) == (len(lengths), sum(lengths))
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert r.quantile == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))


def test_limits_between_lengths_and_groups(docs):
    lengths = [len(tokens_of(r.text)) for r in docs.collect()]
    curve = token_counts.token_counts(docs)
    limits = [0, 1, 5, 1000, 10**6]
    got = {r.limit: r for r in token_counts.at_limits(curve, limits).collect()}
    for limit in limits:
        assert got[limit].docs_over == sum(n > limit for n in lengths)
        assert got[limit].truncated_tokens == sum(min(n, limit) for n in lengths)
    grouped = token_counts.token_counts(docs, groups=["n_tokens_group"]) if "n_tokens_group" in docs.columns else None
    by = token_counts.token_counts(docs.withColumnRenamed("n_tokens", "kind"), groups=["kind"]).collect()
    assert grouped is None and {r.kind for r in by} == {"clash", None, "c"}
    assert sum(r.docs for r in by) == len(lengths)


def test_curve_of_an_empty_table(spark):
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n'1", max_size=120)))
def test_encoding_equals_the_public_library(text):
    own = byte_bpe.codec(vocabulary(byte_bpe.VOCABULARY))
    ids = next(own.encode([text]))
    assert ids == tokens_of(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=30))
def test_both_trees_merge_alike(piece):
    own = byte_bpe.codec(vocabulary(byte_bpe.VOCABULARY))
    assert own.merge_rows([piece], 32)[0] == own.merge_one(piece)


def test_round_trip_digests(docs, spark):
    got = Counter(tuple(r) for r in byte_bpe.round_trip_digests(docs).collect())
    want = Counter()
    for r in docs.collect():
        ids = tokens_of(r.text)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[r.doc_id, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert got == want
    assert byte_bpe.round_trip_digests(docs.limit(0)).count() == 0
    encoded = byte_bpe.encode_documents(docs)
    assert [r.decoded for r in byte_bpe.decode_documents(encoded.where("doc_id = 6")).collect()] == [bytearray(ODD[6].encode())]


def test_word_ids_equal_the_public_library():
    own = packing.WordTokenizer(vocabulary(packing.VOCABULARY))
    whole = Tokenizer.from_file(vocabulary(packing.VOCABULARY))
    texts = [t or "" for t in ODD] + ["a<|endoftext|>b <|startoftext|>", "Σσς ά", "x\x0b\x0cy"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10**9), max_size=20))
def test_plans_hold_each_piece_once(histogram):
    plan = packing.plan_packs(histogram, 64)
    placed = Counter()
    for count, pattern in plan:
        assert sum(pattern) <= 64
        for length in pattern:
            placed[length] += count
    assert placed == Counter(histogram)


def test_packing(docs):
    whole = Tokenizer.from_file(vocabulary(packing.VOCABULARY))
    rows = packing.pack_documents(docs, capacity=256).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 256):
            part = ids[s : s + 256]
            want[r.doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_one_length_may_hold_most_pieces(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'one two three', 'a ' || id) AS text")
    places = packing.pack_documents(rows).select("sequence_id", "offset").collect()
    assert len(places) == 3000 == len(set(places))


def brute_probability(word, pieces, table):
    """Sum over all segmentations, one by one."""
    marked = language_id.START + word
    total = np.zeros(table.shape[1])
    for cuts in itertools.product([False, True], repeat=len(marked) - 1):
        ends = [i + 1 for i, cut in enumerate(cuts) if cut] + [len(marked)]
        p = np.ones(table.shape[1])
        for a, b in zip([0, *ends], ends):
            piece = pieces.ids.get(marked[a:b])
            if piece is None:
                piece = len(pieces.ids) + ord(marked[a]) % language_id.UNKNOWN if b == a + 1 else None
            p = p * (0 if piece is None else table[piece])
        total += p
    return total


def test_forward_sums_all_segmentations():
    pieces = language_id.pieces_of(vocabulary(language_id.VOCABULARY))
    table = np.random.default_rng(0).random((pieces.size, 3))
    table /= table.sum(0)
    words = ["the", "straße", "étion", "漢字x", "a"]
    got = pieces.log_probabilities(words, table)
    for i, word in enumerate(words):
        assert np.exp(got[i]) == pytest.approx(brute_probability(word, pieces, table))


def test_expected_counts_spell_the_word():
    pieces = language_id.pieces_of(vocabulary(language_id.VOCABULARY))
    used = np.zeros(pieces.size)
    pieces.expected_counts(["étion", "the"], np.array([2.0, 1.0]), used)
    chars = sum(used[i] * len(p) for p, i in pieces.ids.items())
    assert chars == pytest.approx(2 * 6 + 4)


def test_language_predictions(spark):
    english = "the cat and the dog were in the house with that man"
    german = "der Hund und die Katze sind nicht in dem Haus gewesen"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(12)]
    rows += [(20, None, "en"), (21, "12 + 34 ²!", "en"), (22, english, None), (23, "", None), (24, "THE DOG " * 5000, None), (None, german, "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"] and np.allclose(model.table.sum(0), 1)
    got = language_id.predict(docs.withColumn("score", fold_of("doc_id", 5)), model).collect()
    assert len(got) == len(rows)
    for r, (_, text, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), rows):
        want = "und" if not text or text.startswith("12") else "en" if text.lower().startswith("the") else "de"
        assert r.lang_pred == want and 0 <= r.score <= 1 and (want != "und" or r.score == 0)
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(fold_of("doc_id", 5) != 0))
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold_of("doc_id", 5) == 0)
    rows = got.collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def packed_one_by_one(histogram, capacity):
    """Fill of each pack when pieces go, longest first, each into the pack that is filled least."""
    fills = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            least = min(range(len(fills)), key=fills.__getitem__, default=None)
            if least is None or fills[least] + length > capacity:
                fills.append(length)
            else:
                fills[least] += length
    return sorted(fills)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 15), max_size=10))
def test_plans_follow_the_shortest_pack_first_rule(histogram):
    plan = packing.plan_packs(histogram, 32)
    assert sorted(sum(p) for n, p in plan for _ in range(n)) == packed_one_by_one(histogram, 32)


def test_packing_reads_special_names_as_the_library(spark):
    whole = Tokenizer.from_file(vocabulary(packing.VOCABULARY))
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> Word, word. it's 3,5 a,.b É,È", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.ids_crc32, r.doc_tokens) for r in packing.document_pieces(docs).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (zlib.crc32(ids.tobytes()), len(ids))
