"""Packing documents into sequences of a fixed number of tokens.

Documents are tokenised once and cut into pieces of at most a sequence; a long document gives
full pieces and one remainder. The lengths of all pieces form a histogram with a bin for each
length, however many documents there are. Shortest-pack-first works on this histogram: lengths
are placed longest first, each into the open packs that are filled least, and what is tracked
are patterns of lengths with the number of packs that follow each. Documents then meet
their place by rank: the r-th piece of a length takes the r-th slot of that length.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm.common import LATIN, RecentMemory, keep, once_per_worker, text_groups, vocabulary

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
#: Pieces of one length are ranked in blocks of about this many rows.
RANK_BLOCK_ROWS = 20_000
#: Characters between which no token of this vocabulary reaches: its pattern drops white
#: space, and these are white space to every part of the tokenizer.
GAPS = ("\n", "\t", "\r")
#: Signs before which a word ends, unless they stand in a run of signs, which may be one token.
STOPS = (",", ".", ";", ":", "!", "?")
RUN_OF_SIGNS = re.compile("[^\\w\\s][,.;:!?]|_[,.;:!?]").search
#: A special token of the vocabulary, which cuts a text before anything else is done to it.
SEPARATOR = "<|endoftext|>"
#: Words joined into a text, and texts tokenised in one call.
WORDS_PER_TEXT = 200
TEXTS_PER_CALL = 200


class WordTokenizer:
    """Ids of a text as little-endian 32-bit integers, from the ids of its words.

    The names of special tokens in a text are these tokens, as for the library itself.
    """

    def __init__(self, path: str):
        # Tasks share the cores already; threads of the library's own would only add to them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.memory = RecentMemory()

    def _bytes_of(self, words: Sequence[str]) -> Iterator[bytes]:
        """Ids of each word. Words go to the tokenizer many at a time, with its end token between."""
        plain = [w for w in words if "<|" not in w]
        own = (w for w in words if "<|" in w)
        alone = {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in own}
        groups = [plain[k : k + WORDS_PER_TEXT] for k in range(0, len(plain), WORDS_PER_TEXT)]
        found: list[bytes] = []
        for k in range(0, len(groups), TEXTS_PER_CALL):
            texts = [SEPARATOR.join(g) for g in groups[k : k + TEXTS_PER_CALL]]
            for group, e in zip(groups[k:], self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == self.separator)
                raw, size = ids.tobytes(), len(ids)
                starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), size]
                assert len(starts) == len(group)
                found.extend(raw[4 * a : 4 * b] for a, b in zip(starts, ends))
        if not alone:
            return iter(found)
        rest = iter(found)
        return (alone[w] if w in alone else next(rest) for w in words)

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        found = []
        for text in texts:
            for gap in GAPS:
                text = text.replace(gap, " ")
            # The fewer different words there are, the fewer have to be tokenised: a Latin text can be
            # lower-cased here as well as later, and signs after a word be words of their own.
            if LATIN(text) and "<|" not in text:
                text = text.lower()
                if not RUN_OF_SIGNS(text):
                    for stop in STOPS:
                        text = text.replace(stop, " " + stop)
            found.append(text.split(" "))
        known = self.memory.known(set().union(*found), self._bytes_of)
        for words in found:
            yield b"".join(map(known.__getitem__, words))


def word_tokenizer(path: str) -> WordTokenizer:
    return once_per_worker(f"word tokenizer {path}", lambda: WordTokenizer(path))


#: Characters of text tokenised together; a longer text is its own group.
GROUP_CHARS = 2_000_000


def document_pieces(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, path: str | None = None,
) -> DataFrame:
    """Tokenise each text once, add the end id, and cut it into pieces of at most ``capacity``.

    Returns per piece: the id column, ``start``, ``length``, ``ids_crc32`` and ``doc_tokens``.
    A null text counts as empty and is one piece with the end id alone. Repeated rows give
    pieces each. The ids themselves never leave the task.
    """
    path = path or vocabulary(VOCABULARY)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(path)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(1), GROUP_CHARS):
                row, start, length, crc, total = [], [], [], [], []
                for k, ids in enumerate(own.encode(group), at):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, capacity):
                        piece = ids[4 * s : 4 * (s + capacity)]
                        row.append(k)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), *longs],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens"],
                )
                at += len(group)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: patterns of lengths, each with the number of packs that follow it.

    Its work depends on the number of bins and patterns, not on the number of pieces.
    """
    done: list[tuple[int, tuple[int, ...]]] = []
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by free space
    frees: list[int] = []  # heap of negated free spaces

    def add(free: int, count: int, pattern: tuple[int, ...]) -> None:
        if not free:
            done.append((count, pattern))
            return
        if free not in open_packs:
            open_packs[free] = []
            heapq.heappush(frees, -free)
        open_packs[free].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not frees or -frees[0] < length:
                # Nothing fits: new packs, each with as many pieces of this length as it holds.
                each = min(left, capacity // length)
                add(capacity - each * length, left // each, (length,) * each)
                left %= each
                continue
            free = -frees[0]
            count, pattern = open_packs[free].pop()
            if not open_packs[free]:
                del open_packs[free]
                heapq.heappop(frees)
            # The same number of pieces goes into each of these packs, until they are no
            # longer the ones filled least.
            second = -frees[0] if frees else 0
            each = max(1, min(left // count, (free - second) // length))
            used = min(count, left // each)
            if used < count:
                add(free, count - used, pattern)
            add(free - each * length, used, pattern + (length,) * each)
            left -= used * each
    for packs in open_packs.values():
        done.extend(packs)
    return sorted(done, key=lambda x: (x[1], x[0]), reverse=True)


def slots_by_length(plan: Sequence[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length its runs of slots: first rank, first sequence, and offset of each run."""
    runs: dict[int, list[list[int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for count, pattern in plan:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            runs.setdefault(length, []).append([rank, sequence, offset])
            taken[length] = rank + count
            offset += length
        sequence += count
    return {k: tuple(np.array(v, np.int64).T) for k, v in runs.items()}


def ranked(pieces: DataFrame, order: Sequence[Column], blocks: int) -> DataFrame:
    """Add ``rank``, the place of each piece among those of its length, from 0.

    A length that holds a third of all pieces is cut into ``blocks`` by a hash, ranked inside
    each, and shifted by the sizes of the blocks before.
    """
    rows = pieces.withColumn("_block", F.pmod(F.xxhash64(*pieces.columns), F.lit(blocks)))
    sizes = rows.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_block").orderBy(*order)
    numbered = rows.withColumn("_i", F.row_number().over(inside))
    return numbered.join(bases, ["length", "_block"]).select(
        *pieces.columns, (F.col("_base") + F.col("_i") - 1).alias("rank")
    )


def pack_documents(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, path: str | None = None,
) -> DataFrame:
    """Pack all documents; one row for each piece.

    Returns the id column, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset``. An empty table packs into no rows; ties between pieces of
    one length are settled by id, start and crc, and equal rows take any of their slots.

    The pieces are kept in the shared folder, so the histogram and the join see the same rows.
    The plan has at most ``capacity`` lengths; it is made on the driver and sent to the tasks.
    """
    pieces = keep(document_pieces(docs, id_column, text, capacity, end_id, path))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_by_length(plan_packs(histogram, capacity))
    blocks = max(64, -(-sum(histogram.values()) // RANK_BLOCK_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            ranks = batch.column(5).to_numpy()
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    first, base, at = shared.value[int(lengths[rows[0]])]
                    run = np.searchsorted(first, ranks[rows], side="right") - 1
                    sequence[rows] = base[run] + ranks[rows] - first[run]
                    offset[rows] = at[run]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)], names=names
            )

    names = [*pieces.columns, "sequence_id", "offset"]
    names[0] = "id"
    order = [F.col(id_column), F.col("start"), F.col("ids_crc32")]
    rows = ranked(pieces, order, blocks).withColumnRenamed(id_column, "id")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names[1:])
    return rows.mapInArrow(place, schema).withColumnRenamed("id", id_column)
