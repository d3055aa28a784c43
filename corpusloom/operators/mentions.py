"""Which of an owner's names a text mentions, for many owners, names and texts at once.

Names are cut into blocks of one owner, texts of a busy owner are dealt over several salts, and
the two meet in one shuffle by (owner, salt, block). Each task reads its sorted rows as a stream: the names of a
block come first and become a multi-pattern automaton, by which each text after them is read once,
however many names there are and however alike they begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

#: Names in one automaton at most.
BLOCK_NAMES = 50_000
#: Characters of an owner's texts that one task reads, about.
TASK_CHARS = 8_000_000
#: Up to so many owners with several blocks or salts are sent to all tasks.
BROADCAST_OWNERS = 100_000


class _Matcher:
    """The automaton of the names that came last, and what it finds."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.automaton = ahocorasick.Automaton()
        self.made = False

    def start(self, key: tuple) -> None:
        if key != self.key:
            self.key, self.automaton, self.made = key, ahocorasick.Automaton(), False

    def add(self, name: str) -> None:
        self.automaton.add_word(name, name)

    def found(self, text: str) -> set[str]:
        if not self.made:
            self.automaton.make_automaton()
            self.made = True
        # An automaton without names has nothing to run.
        return {name for _, name in self.automaton.iter(text)} if len(self.automaton) else set()


def mentioned_names(
    texts: DataFrame, names: DataFrame, block_names: int = BLOCK_NAMES, task_chars: int = TASK_CHARS
) -> DataFrame:
    """Pairs (doc_id, users_idx, name) of a text and a name of its owner that it contains, each once.

    ``texts``: doc_id, users_idx, text. ``names``: users_idx, name; empty names are in no text. Null
    owners, texts and names match nothing.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    texts = texts.select("doc_id", "users_idx", "text").where("users_idx IS NOT NULL AND text IS NOT NULL")
    names = names.select("users_idx", "name").where("users_idx IS NOT NULL AND name <> ''").distinct()
    load = texts.groupBy("users_idx").agg(F.ceil(F.sum(F.length("text")) / task_chars).alias("_salts"))
    sizes = names.groupBy("users_idx").agg(F.ceil(F.count("*") / block_names).alias("_blocks"))
    # One row for each owner that has both; most need one block and one salt, and are left out.
    several = load.join(sizes, "users_idx").where("_salts > 1 OR _blocks > 1").checkpoint()
    if several.count() <= BROADCAST_OWNERS:
        several = F.broadcast(several)

    def dealt(rows: DataFrame, own: str, other: str, key: str) -> DataFrame:
        """A row's own part by a hash of its key, and a copy for each part of the other side."""
        parts = rows.join(several, "users_idx", "left").fillna(1, ["_salts", "_blocks"])
        parts = parts.withColumn(f"_{own}", F.pmod(F.xxhash64(key), F.col(f"_{own}s")))
        return parts.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_{other}s") - 1)))

    where = ["users_idx", "_salt", "_block"]
    id_type = texts.schema["doc_id"].dataType
    text_rows = dealt(texts, "salt", "block", "doc_id").select(*where, F.lit(1).alias("_kind"), "doc_id", F.col("text").alias("_value"))
    name_rows = dealt(names, "block", "salt", "name").select(
        *where, F.lit(0).alias("_kind"), F.lit(None).cast(id_type).alias("doc_id"), F.col("name").alias("_value")
    )
    rows = name_rows.unionByName(text_rows).repartition(*where).sortWithinPartitions(*where, "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher()
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            at, name = [], []
            for i, (key, kind, value) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(5))):
                matcher.start(key)
                if kind == 0:
                    matcher.add(value.as_py())
                else:
                    found = matcher.found(value.as_py())
                    at.extend([i] * len(found))
                    name.extend(found)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(4).take(taken), batch.column(0).take(taken), pa.array(name, pa.string())], names=["doc_id", "users_idx", "name"]
            )

    schema = f"doc_id {id_type.simpleString()}, users_idx {texts.schema['users_idx'].dataType.simpleString()}, name string"
    return rows.mapInArrow(run, schema).distinct()
