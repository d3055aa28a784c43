"""Exact duplicates of whole texts, by skew-safe combining in plain DataFrame operations.

A group of copies may hold a third of all rows, so no stage gathers a group in one task:

1. *Locally*: rows of a group are combined in the task that reads them, before any shuffle.
   The grouping key is the digest, the full normalised content and a salt.
2. *Salted*: the partial groups of one salt meet, again under digest and full content.
3. *Globally*: the salts of a group, a few rows each, meet under digest and full content.

The winner then travels back the same way: a row for each salt, and from there to the rows of
the salt. Contents are compared at every grouping stage. The way back compares digests, and
where contents of one digest were found to differ, contents again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keep

#: At most 62, as the salts of a group are kept as the bits of one long.
SALTS = 48

#: What is left out before texts are compared: space and the controls from tab to return.
_LEFT_OUT = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space of the ASCII kind; null counts as empty."""
    # replace() searches bytes, which is much cheaper than a mapping of characters.
    text = F.coalesce(text.cast("string"), F.lit(""))
    for char in _LEFT_OUT:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


# The better row has more code points, then the smaller id, and a null id comes last. Both are
# packed into one decimal, as a buffer of fixed width keeps the combining in the hash aggregate.
_SHIFT = 1 << 65
_ID_TOP = 1 << 63


def _number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _rank_of(points: Column, doc_id: Column) -> Column:
    low = F.coalesce(_number(_ID_TOP) - doc_id.cast("decimal(19,0)"), _number(0).cast("decimal(21,0)"))
    return (points.cast("decimal(10,0)") * _number(_SHIFT) + low).cast("decimal(38,0)")


def _judged(docs: DataFrame, id_column: str, text: str, digest, salts: int) -> DataFrame:
    """Rows of equal id, size and text as one: id, points, n, best, group_size, text_sha256."""
    original = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        normalised(F.col(text)).alias("content"),
        F.length(original).cast("long").alias("points"),
    )
    rows = rows.withColumns({"digest": digest(F.col("content")), "salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")})
    bit = F.expr("shiftleft(1L, salt)")
    salted = rows.groupBy("digest", "content", "salt").agg(
        F.count("*").alias("n"), F.max(_rank_of(F.col("points"), F.col("id"))).alias("best")
    )
    whole = salted.groupBy("digest", "content").agg(
        F.sum("n").alias("group_size"), F.max("best").alias("best"), F.bit_or(bit).alias("bits")
    )
    whole = whole.withColumn("text_sha256", F.sha2("content", 256))
    winners = keep(whole.drop("content"))
    keys = ["digest", "salt"]
    if winners.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").isEmpty():
        rows = rows.drop("content")
    else:  # a digest that stands for several contents: the way back compares contents too
        winners, keys = whole, [*keys, "content"]
    held = F.expr(f"filter(sequence(0, {salts - 1}), s -> shiftright(bits, s) & 1L = 1L)")
    back = winners.withColumn("salt", F.explode(held)).drop("bits")
    repeats = rows.repartition(*keys).groupBy(*keys, "id", "points").agg(F.count("*").alias("n"))
    return repeats.join(back, keys).select("id", "points", "n", "best", "group_size", "text_sha256")


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", digest=sha256_hex, salts: int = SALTS
) -> DataFrame:
    """One row for each document: which row of its group of equal texts stays.

    ``id_column`` is an integer column. Returns it with ``keep_id``, ``group_size``, ``kept``
    and ``text_sha256``. The row with the most code points in its original text stays, then
    the smallest id; a null id comes last. A null text counts as empty, so null and empty
    texts are copies of each other. Rows that repeat id and text all count in ``group_size``,
    and one of them is kept. An empty table gives an empty result; other columns are not read.

    ``digest`` maps a normalised content to a short text. It only speeds up: a weak one gives
    the same groups.
    """
    rows = _judged(docs, id_column, text, digest, salts)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    low = F.col("best") % _number(_SHIFT)
    return rows.select(
        F.col("id").alias(id_column),
        F.when(low > 0, _number(_ID_TOP) - low).cast("long").alias("keep_id"),
        "group_size",
        (_is_best() & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; nulls and ties as in `exact_duplicates`."""
    stay = keep(_judged(docs, id_column, text, sha256_hex, SALTS).where(_is_best()))
    # Names of this call's own, as the documents may have columns of any name.
    own_id, own_points, own_sha = (f"_{name}_{uuid.uuid4().hex}" for name in ("id", "points", "sha"))
    stay = stay.select(F.col("id").alias(own_id), F.col("points").alias(own_points), "n", F.col("text_sha256").alias(own_sha))
    once, again = stay.where("n = 1").drop("n"), stay.where("n > 1").drop("n")
    original = F.coalesce(F.col(text).cast("string"), F.lit(""))
    match = (
        F.col(id_column).cast("long").eqNullSafe(F.col(own_id))
        & (F.length(original) == F.col(own_points))
        & (sha256_hex(normalised(F.col(text))) == F.col(own_sha))
    )
    kept = docs.join(once, match, "left_semi")
    if again.isEmpty():
        return kept
    # Rows repeated with id and text: any one of them.
    repeated = docs.join(again, match, "inner").dropDuplicates([own_id, own_sha])
    return kept.unionByName(repeated.select(*[repeated[c] for c in docs.columns]))


def _is_best() -> Column:
    return _rank_of(F.col("points"), F.col("id")) == F.col("best")
