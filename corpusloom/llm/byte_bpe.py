"""Byte-level BPE encoding and decoding.

A text is cut by the public pattern into pre-tokens, and each is merged on its own. A segment
tree stands over the byte positions of a pre-token; a leaf holds the rank of the pair that
starts there, with the position as tie-breaker, so the root names the leftmost pair of least
rank. A merge removes the right neighbour and sets the leaves of the two live pairs that
change, in logarithmic time each; no list is scanned again, and a pre-token of a megabyte
costs n log n steps.

Short pre-tokens, nearly all of them, are merged many at a time: their trees are the rows of
one numpy array, and each step merges one pair in every row that still has one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import MANY_WORDS, MEMORY_KEY_CHARS, Memory, once_per_worker, vocabulary

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Leaves of the trees that are merged together; a longer pre-token has a tree of its own.
ROW_LEAVES = (4, 8, 16, 32)
#: Rows merged at a time.
ROWS = 8192
#: A leaf is rank << POSITION_BITS | position; texts stay far below 2**40 bytes.
POSITION_BITS = 40
NONE = (1 << 62) - 1
#: Tokens of two files' ids are told apart in a pair's key by this many bits.
ID_BITS = 20


class Codec:
    """Ranks of one vocabulary, and the merges that they allow."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The empty token that some files carry never comes from a text.
        self.tokens = {rank: token for token, rank in self.ranks.items() if token}
        self.ids_text = {rank: str(rank) for rank in self.tokens}
        self.bytes_id = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << ID_BITS | right] = rank
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], NONE)
        self.pair_ranks = np.append(np.fromiter(self.pairs.values(), np.int64, len(keys))[order], -1)
        self.byte_ids = np.array(self.bytes_id, np.int64)
        # Unicode's white space, as the pattern's own library reads it.
        pattern = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}")
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(pattern).findall
        self.memory = Memory(MANY_WORDS)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        keys = left << ID_BITS | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_one(self, piece: bytes) -> list[int]:
        """Merge one pre-token of any length with a segment tree of its own."""
        n = len(piece)
        ids = [self.bytes_id[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(1, (n - 1).bit_length())
        tree = [NONE] * (2 * size)
        get = self.pairs.get
        for i in range(n - 1):
            rank = get(ids[i] << ID_BITS | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << POSITION_BITS | i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                low = value if value < other else other
                if tree[node] == low:
                    return
                tree[node] = value = low

        def pair_at(i: int) -> int:
            j = after[i]
            rank = get(ids[i] << ID_BITS | ids[j]) if j < n else None
            return NONE if rank is None else rank << POSITION_BITS | i

        mask = (1 << POSITION_BITS) - 1
        while tree[1] != NONE:
            i = tree[1] & mask
            j = after[i]
            ids[i] = tree[1] >> POSITION_BITS
            ids[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, NONE)
            put(i, pair_at(i))
            if before[i] >= 0:
                put(before[i], pair_at(before[i]))
        return [x for x in ids if x >= 0]

    def merge_rows(self, pieces: Sequence[bytes], size: int) -> list[list[int]]:
        """Merge pre-tokens of at most ``size`` bytes, a tree in each row."""
        count = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        ids = self.byte_ids[raw]
        ids[np.arange(size) >= lengths[:, None]] = -1
        after = np.tile(np.arange(1, size + 1), (count, 1))
        before = np.tile(np.arange(-1, size - 1), (count, 1))
        tree = np.full((count, 2 * size), NONE, np.int64)
        rank = self._ranks_of(ids[:, :-1], ids[:, 1:])
        rank[ids[:, 1:] < 0] = -1
        tree[:, size : 2 * size - 1] = np.where(rank >= 0, rank << POSITION_BITS | np.arange(size - 1), NONE)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] != NONE)

        def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
            node = size + at
            tree[rows, node] = values
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pairs_at(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            right = after[rows, at]
            inside = right < lengths[rows]
            rank = self._ranks_of(ids[rows, at], ids[rows, np.where(inside, right, 0)])
            return np.where(inside & (rank >= 0), rank << POSITION_BITS | at, NONE)

        mask = (1 << POSITION_BITS) - 1
        while len(live):
            root = tree[live, 1]
            i = root & mask
            j = after[live, i]
            ids[live, i] = root >> POSITION_BITS
            ids[live, j] = -1
            far = after[live, j]
            after[live, i] = far
            has = far < size
            before[live[has], far[has]] = i[has]
            put(live, j, np.full(len(live), NONE))
            put(live, i, pairs_at(live, i))
            left = before[live, i]
            has = left >= 0
            if has.any():
                put(live[has], left[has], pairs_at(live[has], left[has]))
            live = live[tree[live, 1] != NONE]
        kept = ids >= 0
        ends = np.cumsum(kept.sum(1)).tolist()
        flat = ids[kept].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, pieces: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of each pre-token. One that is a token itself needs no merge."""
        done: dict[bytes, tuple[int, ...]] = {}
        rows: dict[int, list[bytes]] = {size: [] for size in ROW_LEAVES}
        for piece in pieces:
            if piece in self.ranks:
                done[piece] = (self.ranks[piece],)
                continue
            size = next((s for s in ROW_LEAVES if len(piece) <= s), None)
            if size:
                rows[size].append(piece)
            else:
                done[piece] = tuple(self.merge_one(piece))
        for size, wanted in rows.items():
            for k in range(0, len(wanted), ROWS):
                part = wanted[k : k + ROWS]
                done.update(zip(part, map(tuple, self.merge_rows(part, size))))
        return done

    def encode(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """Ids of each text. Pre-tokens met before are remembered."""
        found = [self.find(t) for t in texts]
        raw = {p: p.encode() for p in self.memory.missing(set().union(*found))}
        merged = self.merge(set(raw.values()))
        known, long = self.memory.known, {}
        for p, b in raw.items():
            (known if len(p) <= MEMORY_KEY_CHARS else long)[p] = merged[b]
        for pieces in found:
            if long:
                yield list(chain.from_iterable(known[p] if p in known else long[p] for p in pieces))
            else:
                yield list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of a sequence of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str) -> Codec:
    """The codec of a rank file, built once a worker."""
    return once_per_worker(f"codec {path}", lambda: Codec(path))


#: Characters of text encoded together; a longer text is its own group.
GROUP_CHARS = 2_000_000


def _grouped(texts: Sequence[str]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``ids``, the token ids of each document, in row order of the input.

    Returns the id column and ``ids`` (array of ints). A null text counts as empty and has an
    empty array; repeated rows are encoded each; other columns are not read.
    """
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            at = 0
            for group in _grouped([t or "" for t in batch.column(1).to_pylist()]):
                ids = pa.array(own.encode(group), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), ids], names=["id", "ids"])
                at += len(group)

    return _two(docs, id_column, text).mapInArrow(run, f"id {_type(docs, id_column)}, ids array<int>").select(
        F.col("id").alias(id_column), "ids"
    )


def decode_documents(encoded: DataFrame, id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """``decoded``, the bytes of each row's ``ids``; null ids decode to no bytes.

    An id outside the vocabulary raises.
    """
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            decoded = [own.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=["id", "decoded"])

    rows = encoded.select(F.col(id_column).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {_type(encoded, id_column)}, decoded binary").select(
        F.col("id").alias(id_column), "decoded"
    )


def round_trip_digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and return the digests of both.

    Returns the id column, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas)
    and ``decoded_sha256``. The ids stay in the task, where they are counted, decoded and
    hashed; a null text counts as empty. Repeated rows are encoded each, an empty table gives no
    rows, and other columns are not read.
    """
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            at = 0
            for group in _grouped([t or "" for t in batch.column(1).to_pylist()]):
                out: tuple[list, list, list] = ([], [], [])
                for ids in own.encode(group):
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(",".join(map(own.ids_text.__getitem__, ids)).encode()).hexdigest())
                    out[2].append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(group)

    schema = f"id {_type(docs, id_column)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    out = _two(docs, id_column, text).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_column), "n_tokens", "ids_sha256", "decoded_sha256")


def _two(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
