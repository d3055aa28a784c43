"""The word codec against the public tokenizers library."""

import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import word_bpe
from corpusloom.llm.common import RecentMemory, vocabulary

PATH = vocabulary(word_bpe.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    None,
    "",
    " ",
    "Plain words, it's 12 o'CLOCK",
    "Plain words, it's 12 o'CLOCK",
    "a <|endoftext|> b<|startoftext|><|endoftext|",
    "<|ENDOFTEXT|> <|end oftext|>",
    "\x1c\x1d\x85 \xa0 x\x0by\x0c\tz\r\n",
    "Σσς ΑΣ İ ß ﬁ é ​﻿ 日本語 \U0001f600‍ ² ½",
    "ab" * 9000,
    "x " * 3000,
]


def ids_by(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=50), st.text(alphabet="abE' é\n1<|>", max_size=80), st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=50)))
def test_ids_equal_the_library(text):
    own = word_bpe.word_codec(PATH)
    ids = next(own.encode([text]))
    assert ids == ids_by(LIBRARY, text)
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcnothei", min_size=1, max_size=200))
def test_scanning_and_heap_merge_alike(word):
    own = word_bpe.word_codec(PATH)
    parts = [own.inner[b] for b in word.encode()]
    assert own.merge_short(list(parts)) == own.merge_long(list(parts))


def test_tokens_of_all_bytes_exist():
    own = word_bpe.word_codec(PATH)
    assert len({*own.inner, *own.final}) == 512


def test_a_long_word_is_merged_whole():
    word = "internationalisation" * 3000
    assert next(word_bpe.word_codec(PATH).encode([word])) == ids_by(LIBRARY, word)


def test_documents(spark):
    rows = [(i, t, "clash", 1, 0.5) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, ODD[3], "c", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int, decoded double")
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = ids_by(LIBRARY, text)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, word_bpe.round_trip_digests(docs).collect())) == want
    assert word_bpe.round_trip_digests(docs.limit(0)).count() == 0
    back = word_bpe.decode_documents(word_bpe.encode_documents(docs)).collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter(
        (i, LIBRARY.decode(ids_by(LIBRARY, t), skip_special_tokens=False)) for i, t, *_ in rows
    )


def test_memory_keeps_what_is_asked_for_again():
    memory, made = RecentMemory(chars=10 * 103), []

    def make(keys):
        made.extend(keys)
        return [(k,) for k in keys]

    for k in range(100):
        known = memory.known({"hot", f"w{k:02}"}, make)
        assert known["hot"] == ("hot",) and known[f"w{k:02}"] == (f"w{k:02}",)
        assert len(memory.new) + len(memory.old) <= 26
    assert made.count("hot") == 1 and len(made) == 101
    assert memory.known({"x" * 100}, make)["x" * 100] == ("x" * 100,)
    assert "x" * 100 not in memory.known({"hot"}, make)
