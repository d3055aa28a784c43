"""Importance resampling of a corpus towards a target distribution of n-grams.

Texts and target texts are counted over hashed n-gram buckets. A bucket's gain is the logarithm of
how much likelier it is in the target than in the corpus; a document's weight is the mean gain of
its n-grams, and documents are drawn without replacement by adding Gumbel noise to the weight and
taking the highest scores.

The counting is array work. The bytes of a batch of texts become one buffer in which words are
lower-cased and a single space apart, so that each n-gram is a slice of it. Slices are hashed by
xxhash64, many at a time, and interned in an open-addressed numpy table: a slot belongs to the
first n-gram that claims it, and another is of the same slot only if hash, length and bytes agree;
otherwise it probes on. A slot stores its count and, worked out once, its bucket; occurrences keep
slot numbers, by which gains are gathered and summed per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keep, numbered

BUCKETS = 10_000
ORDERS = (1, 2)
#: A document with fewer words is never drawn.
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text whose n-grams are interned in one table; a longer text is cut between words.
BLOCK_BYTES = 1_000_000
#: Slots for each n-gram of a block, at least.
SLOTS_EACH = 2

SPACE = 0x20
#: What each byte becomes: letters, digits and bytes of other scripts are parts of words.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else SPACE for b in range(256)
)

# The five primes of xxhash64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


class Slices:
    """Slices of one buffer, read eight bytes at a time."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.start, self.length = start, length
        self.padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
        self.raw = self.padded.tobytes()
        self.eights = np.ndarray((len(self.padded) - 7,), "<u8", self.padded, strides=(1,))

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.start[i] + self.length[i]]

    def lane(self, which: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes from ``at`` of each slice; bytes beyond its end are zero."""
        rest = np.minimum(self.length[which] - at, 8).astype(np.uint64)
        kept = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        return self.eights[self.start[which] + at] & kept

    def hashes(self) -> np.ndarray:
        """xxhash64 of each slice, with seed 0. Slices below 32 bytes go together, step by step."""
        out = np.empty(len(self.start), np.uint64)
        length = self.length
        for i in np.flatnonzero(length >= 32).tolist():
            out[i] = xxhash.xxh64_intdigest(self.bytes_of(i))
        rows = np.flatnonzero(length < 32)
        rows = rows[np.argsort(length[rows], kind="stable")]
        size = length[rows]
        first = np.searchsorted(size, np.arange(33))  # rows from first[n] on are at least n long
        h = size.astype(np.uint64) + P5
        start = self.start[rows]
        for step in range(3):
            k = first[8 * step + 8]
            lane = _rotated(self.eights[start[k:] + 8 * step] * P2, 31) * P1
            h[k:] = _rotated(h[k:] ^ lane, 27) * P1 + P4
        done = size & ~7
        four = np.flatnonzero(size & 4)
        word = self.eights[start[four] + done[four]] & np.uint64(0xFFFFFFFF)
        h[four] = _rotated(h[four] ^ word * P1, 23) * P2 + P3
        done = size & ~3
        for step in range(3):
            some = np.flatnonzero((size & 3) > step)
            byte = self.padded[start[some] + done[some] + step].astype(np.uint64)
            h[some] = _rotated(h[some] ^ byte * P5, 11) * P1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        out[rows] = h ^ h >> np.uint64(32)
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether slices ``a`` and ``b``, of one length each, hold the same bytes."""
        equal = np.ones(len(a), bool)
        left = np.arange(len(a))
        at = 0
        while len(left):
            equal[left] &= self.lane(a[left], at) == self.lane(b[left], at)
            at += 8
            left = left[(self.length[a[left]] > at) & equal[left]]
        return equal


class Interned(NamedTuple):
    slot: np.ndarray  # of each slice, from 0 in the order of the table
    owner: np.ndarray  # of each slot, a slice that it stands for
    count: np.ndarray  # of each slot


def intern(slices: Slices, hashes: np.ndarray) -> Interned:
    """Give equal slices the same slot number by open addressing with linear probing."""
    n = len(hashes)
    size = 1 << max(1, (SLOTS_EACH * n - 1).bit_length())
    mask = np.uint64(size - 1)
    table = np.full(size, -1, np.int64)
    at = (hashes & mask).astype(np.int64)
    left = np.arange(n)
    while len(left):
        free = left[table[at[left]] < 0]
        table[at[free]] = free  # of several that claim a place, one gets it
        holder = table[at[left]]
        fits = (hashes[holder] == hashes[left]) & (slices.length[holder] == slices.length[left])
        check = np.flatnonzero(fits & (holder != left))
        fits[check] = slices.same(left[check], holder[check])
        left = left[~fits]
        at[left] = at[left] + 1 & (size - 1)
    used = table >= 0
    number = np.cumsum(used) - 1
    slot = number[at]
    return Interned(slot, table[used], np.bincount(slot, minlength=int(used.sum())))


class Block(NamedTuple):
    """N-grams of some texts, interned."""

    text: np.ndarray  # of each n-gram, the number of its text
    words: np.ndarray  # of each text
    table: Interned
    bucket: np.ndarray  # of each slot


def _cut(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of a folded text between words, and how many words of its head each part repeats."""
    signs = np.frombuffer(raw, np.uint8)
    inside = signs != SPACE
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    raw = signs[kept].tobytes()  # words, a single space apart
    overlap = max(ORDERS) - 1
    at, repeated = 0, 0
    while len(raw) - at > BLOCK_BYTES:
        end = raw.rfind(b" ", at, at + BLOCK_BYTES)
        if end < 0:  # a word longer than a block
            end = raw.find(b" ", at + BLOCK_BYTES)
        while end >= 0 and raw.count(b" ", at, end) < overlap:
            end = raw.find(b" ", end + 1)
        if end < 0:
            break
        yield raw[at:end], repeated
        # The next part begins with the last words of this one, for the n-grams across the cut.
        at = end
        for _ in range(overlap):
            at = raw.rfind(b" ", 0, at)
        at, repeated = at + 1, overlap
    yield raw[at:], repeated


def _block(parts: Sequence[tuple[int, bytes, int]], texts: int) -> Block:
    """Intern the n-grams of parts (number of the text, folded bytes, repeated words)."""
    folded = np.frombuffer(b" ".join(p for _, p, _ in parts) + b" ", np.uint8)
    sizes = np.array([len(p) + 1 for _, p, _ in parts])
    inside = folded != SPACE
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    starts, ends = edges[::2], edges[1::2]
    length = ends - starts
    part = np.searchsorted(np.cumsum(sizes), starts, side="right")
    # One space stays after each word.
    kept = inside.copy()
    kept[ends] = True
    buffer = folded[kept]
    place = np.cumsum(length + 1) - length - 1
    first = np.searchsorted(part, np.arange(len(parts)))
    new = np.arange(len(part)) - first[part] >= np.array([r for _, _, r in parts])[part]
    owner = np.array([t for t, _, _ in parts])
    found = []
    for n in ORDERS:
        last = np.arange(n - 1, len(part))
        head = last - (n - 1)
        # An n-gram counts in the part where its last word is new.
        keep = (part[last] == part[head]) & new[last]
        last, head = last[keep], head[keep]
        found.append((owner[part[last]], place[head], place[last] + length[last] - place[head]))
    text, start, size = (np.concatenate(x) for x in zip(*found))
    slices = Slices(buffer, start, size)
    table = intern(slices, slices.hashes())
    begin = start[table.owner]
    ranges = zip(begin.tolist(), (begin + size[table.owner]).tolist())
    bucket = np.fromiter((crc32(slices.raw[a:b]) for a, b in ranges), np.int64, len(begin)) % BUCKETS
    return Block(text, np.bincount(owner[part[new]], minlength=texts), table, bucket)


def blocks_of(column: pa.Array) -> Iterator[tuple[int, int, list[Block]]]:
    """Runs of rows (from, to) of a column of texts, each with its blocks. A null text has no words."""
    rows: list[tuple[int, bytes, int]] = []
    first = size = at = 0
    for value in column:
        raw = (value.as_py() or "").encode().translate(FOLD)
        if rows and size + len(raw) > BLOCK_BYTES:
            yield first, at, [_block(rows, at - first)]
            rows, size, first = [], 0, at
        if len(raw) > BLOCK_BYTES:
            yield at, at + 1, [_block([(0, part, repeated)], 1) for part, repeated in _cut(raw)]
            first = at + 1
        else:
            rows.append((at - first, raw, 0))
            size += len(raw)
        at += 1
    if rows:
        yield first, at, [_block(rows, at - first)]


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """N-grams in each bucket over all rows. A task tells at most a number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, blocks in blocks_of(batch.column(0)):
                for b in blocks:
                    np.add.at(total, b.bucket, b.table.count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of smoothed shares of each bucket, floored."""
    s_all, t_all = float(source.sum()), float(target.sum())
    n = float(len(source))
    ratios = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratios], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id column, ``n_words``, ``n_features`` and ``weight``, the floored mean gain (0 without any)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, end, blocks in blocks_of(batch.column(1)):
                words, features, total = np.zeros((3, end - first), np.int64)
                for b in blocks:
                    words += b.words
                    features += np.bincount(b.text, minlength=end - first)
                    np.add.at(total, b.text, own[b.bucket][b.table.slot])
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *map(pa.array, (words, features, weight))], names=names
                )

    names = ["id", "n_words", "n_features", "weight"]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def resample(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text",
    target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Draw ``percent`` of the documents with enough words, likelier the more they resemble ``target``.

    Returns every document's id, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1, null
    where it isn't drawn). Null and empty texts have no features and weight 0. Ties go to the
    smaller id, nulls last; the noise depends on seed and id alone, a null id's on the seed, so
    repeated rows have equal scores and take ranks one after the other. Without target texts
    all gains come from the corpus alone; an empty table gives no rows. Other columns are not read.

    Two passes read the texts, and what is shuffled is a number for each bucket and task, and a
    few numbers for each document, which are ranked by ranges of the score.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    share = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(share)))
    # Kept, as the bounds of the ranges are sampled from the rows before these are sorted.
    told = keep(weights(docs, gain, id_column, text)).withColumn("score", score)
    told = told.select(F.col(id_column).alias("_id"), "n_features", "weight", "score", (F.col("n_words") < least_words).alias("_short"))
    # Documents that may be drawn come first, so their places are their ranks.
    placed = numbered(told, ["_short"], [F.desc("score"), F.asc_nulls_last("_id")])
    drawn = ~F.col("_short") & (F.col("_i") < F.floor(percent * F.col("_n") / 100))
    return placed.select(F.col("_id").alias(id_column), "n_features", "weight", "score", F.when(drawn, F.col("_i") + 1).alias("rank"))
