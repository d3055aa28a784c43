"""BPE over words: encoding and decoding with a contiguous array of ranks.

A text is cut at the special tokens, normalised, and split into words by the vocabulary's own
pattern; each distinct word is merged on its own.
A word is held as two contiguous lists: the ids of its parts, whose order stands for the part
boundaries, and the rank of each adjacent pair. The least rank is found by one scan, which takes the
leftmost of equals; its boundary is deleted from both lists, and only the ranks on either side
are looked up again. Nearly all words have a few parts, for which a scan of adjacent numbers is
cheaper than any tree. Scanning is quadratic in the parts, so a word beyond ``SHORT_PARTS`` keeps
its candidate pairs in a heap over linked boundaries, which gives the same merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm.common import LATIN, RecentMemory, once_per_worker, text_groups, vocabulary

VOCABULARY = "word_bpe_49k.json"
#: Parts up to which a word is merged by scanning its ranks.
SHORT_PARTS = 100
#: A pair that no merge joins; above all ranks.
NONE = 1 << 62
#: An id of a pair's key fits into so many bits.
ID_BITS = 24
#: Between these no token reaches, as the pattern drops white space.
GAPS = re.compile("[ \n\t\r]")
#: Characters of text encoded together; a longer text is its own group.
GROUP_CHARS = 1_000_000


def byte_signs() -> list[str]:
    """The printable sign of each byte: itself where it is printable, else the next free sign from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class WordCodec:
    """Ids of texts by one vocabulary file, and texts of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        # Of special tokens that start alike, the longest is the one in the text.
        longest = sorted(special, key=len, reverse=True)
        self.special = special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else lambda t: [t]
        self.tokens = {i: t for t, i in [*ids.items(), *special.items()]}
        self.ids_text = {i: str(i) for i in self.tokens}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Rank of a pair of ids, and the id that each rank makes.
        self.pairs = {ids[a] << ID_BITS | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        signs = byte_signs()
        self.byte_of = {sign: b for b, sign in enumerate(signs)}
        self.inner = [ids[s] for s in signs]
        self.final = [ids[s + (model["end_of_word_suffix"] or "")] for s in signs]
        self.find = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        own = Tokenizer.from_file(path)
        self.normalise, self.pre_tokenise = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.memory = RecentMemory()

    def merge_short(self, parts: list[int]) -> list[int]:
        """Merge by scanning: ``ranks[i]`` belongs to the boundary between parts i and i + 1."""
        get, made = self.pairs.get, self.made
        ranks = [get(a << ID_BITS | b, NONE) for a, b in pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << ID_BITS | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << ID_BITS | new, NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a word of any length, n log n."""
        n, get = len(parts), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = get(parts[i] << ID_BITS | parts[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of its parts has been merged since
            parts[i] = self.made[rank]
            parts[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def ids_of(self, word: str | tuple[int, ...]) -> tuple[int, ...]:
        """Ids of a normalised word; a special token is its own id already."""
        if isinstance(word, tuple):
            return word
        raw = word.encode()
        parts = list(map(self.inner.__getitem__, raw))
        parts[-1] = self.final[raw[-1]]
        return tuple(self.merge_short(parts) if len(parts) <= SHORT_PARTS else self.merge_long(parts))

    def words(self, text: str) -> list:
        """Normalised words of a text in order, and of each special token a tuple of its id."""
        found: list = []
        for k, part in enumerate(self.cut_special(text)):
            if k % 2:
                found.append((self.special[part],))
                continue
            for stretch in (part,) if LATIN(part) else GAPS.split(part):
                if LATIN(stretch):
                    found += self.find(stretch.lower())
                else:
                    signs = self.pre_tokenise(self.normalise(stretch))
                    found += [bytes(map(self.byte_of.__getitem__, word)).decode() for word, _ in signs if word]
        return found

    def encode(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """Ids of each text. Words met before are remembered."""
        found = list(map(self.words, texts))
        known = self.memory.known(set().union(*found), lambda words: map(self.ids_of, words))
        for words in found:
            yield list(chain.from_iterable(map(known.__getitem__, words)))

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary has no decoder of its own: tokens, word ends included, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


def word_codec(path: str) -> WordCodec:
    """The codec of a vocabulary file, built once a worker."""
    return once_per_worker(f"word codec {path}", lambda: WordCodec(path))


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The id column and ``ids`` (array of ints) of each document.

    A null text counts as empty and has an empty array; the names of special tokens in a text
    are those tokens. Repeated rows are encoded each, an empty table gives no rows, and other
    columns are not read, whatever their names.
    """
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_codec(path)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(1), GROUP_CHARS):
                ids = pa.array(own.encode(group), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), ids], names=["id", "ids"])
                at += len(group)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode_documents(encoded: DataFrame, id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """The id column and ``decoded``, the text of each row's ``ids``.

    Null or empty ids decode to an empty text; an id outside the vocabulary raises.
    """
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_codec(path)
        for batch in batches:
            decoded = [own.decode(ids.as_py() or ()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], names=["id", "decoded"])

    rows = encoded.select(F.col(id_column).alias("id"), "ids")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_column)


def round_trip_digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and return the digests of both.

    Returns the id column, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space)
    and ``decoded_sha256``; the ids stay in the task. Nulls, repeated rows, empty tables and
    other columns as in ``encode_documents``.
    """
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_codec(path)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(1), GROUP_CHARS):
                counts, coded, decoded = [], [], []
                for ids in own.encode(group):
                    counts.append(len(ids))
                    coded.append(hashlib.sha256(" ".join(map(own.ids_text.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(group)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
