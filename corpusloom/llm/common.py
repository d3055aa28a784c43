"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

#: Entries that a worker's memory of words holds before it is emptied and filled anew.
MEMORY_WORDS = 250_000
#: Where a word is dear to work out.
MANY_WORDS = 500_000
#: Longer keys are worked out each time, so that a memory stays small.
MEMORY_KEY_CHARS = 64

#: Characters of keys, with an allowance for each entry, that a generation of a memory holds: about 50 MB.
RECENT_CHARS = 24_000_000
RECENT_ENTRY_CHARS = 100

#: Texts of these only need no normaliser but lower-casing: letters, digits and signs of the Latin
#: blocks are composed already, lower-cased one by one, and of the same class in every version of
#: Unicode.
LATIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*").fullmatch
#: Letters of any script; digits of other kinds are told apart with ``str.isalpha``.
LETTER_RUN = re.compile(r"[^\W\d_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file: in ``folder``, else where the package keeps it."""
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def keep(df: DataFrame) -> DataFrame:
    """Write a result to the shared checkpoint folder, and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``_i``, the place of a row in its group from 0, and ``_n``, the rows of the group.

    Rows are sorted by ranges of (group, order) and kept; a group of any size spreads over the
    ranges, and only a first row and a count of each range and group are added up. The columns
    of ``groups`` hold no nulls.
    """
    by = [*map(F.col, groups), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    placed = keep(placed)
    part = F.shiftrightunsigned("_m", 33).alias("_p")
    parts = placed.groupBy(*groups, part).agg(F.min("_m").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *groups, "_p", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n")
    )
    joined = placed.withColumn("_p", part).join(parts, [*groups, "_p"])
    return joined.select(*rows.columns, (F.col("_m") + F.col("_shift")).alias("_i"), "_n")


class Memory:
    """Results by key, emptied when full; what it forgets is worked out again."""

    def __init__(self, limit: int = MEMORY_WORDS):
        self.known: dict = {}
        self.limit = limit

    def missing(self, wanted: set) -> set:
        """The keys still to be worked out, after making room for them."""
        new = wanted.difference(self.known)
        if self.known and len(self.known) + len(new) > self.limit:
            self.known.clear()
            return wanted
        return new


class RecentMemory:
    """Results by key in two generations, bounded by the characters of their keys.

    When the newer generation is full it becomes the older one, and what that held goes, except
    for keys that are asked for again: those move to the newer one. So frequent keys stay.
    """

    def __init__(self, chars: int = RECENT_CHARS):
        self.chars = chars
        self.held = 0
        self.new: dict = {}
        self.old: dict = {}
        self.long: list = []

    def known(self, wanted: set, make: Callable[[list], Iterable]) -> dict:
        """Results by key, of all ``wanted`` keys at least, until the next call.

        ``make`` gives those that are not remembered, in order. Long keys are forgotten at the next call.
        """
        for key in self.long:
            del self.new[key]
        if self.held > self.chars:
            self.old, self.new, self.held = self.new, {}, 0
        new, old = self.new, self.old
        absent = wanted.difference(new)
        again = absent.intersection(old)
        new.update(zip(again, map(old.__getitem__, again)))
        missing = list(absent.difference(again))
        new.update(zip(missing, make(missing)))
        self.long = [key for key in missing if len(key) > MEMORY_KEY_CHARS]
        self.held += sum(map(len, absent)) + RECENT_ENTRY_CHARS * len(absent)
        return new


#: Things that a worker keeps between tasks. The one used longest ago goes for a new one, so the
#: memories of operators that run one after the other do not add up.
KEPT_PER_WORKER = 2


def give_back() -> None:
    """Return memory that is no longer used to the system: Python's, Arrow's and the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def once_per_worker(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a Python worker and found again by its later tasks.

    Task functions travel by value, with module variables of their own; a module that is
    registered with the interpreter outlives them.
    """
    state = sys.modules.setdefault("_corpusloom_worker", types.ModuleType("_corpusloom_worker")).__dict__
    kept = state.setdefault("kept", {})
    if key in kept:
        kept[key] = kept.pop(key)  # now the latest
        return kept[key]
    if len(kept) >= KEPT_PER_WORKER:
        while len(kept) >= KEPT_PER_WORKER:
            del kept[next(iter(kept))]
        give_back()
    kept[key] = made = make()
    return made


def text_groups(column: pa.Array, chars: int) -> Iterator[list[str]]:
    """Texts of a column in groups of about so many characters; a longer text is its own group.

    Only one group at a time is held as Python strings. A null text counts as empty.
    """
    group: list[str] = []
    size = 0
    for value in column:
        text = value.as_py() or ""
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
