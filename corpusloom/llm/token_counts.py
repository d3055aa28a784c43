"""Token counts of a corpus from an exact histogram of encoded lengths.

Documents are encoded once and aggregated by length. The histogram has a row for each
distinct length and group, however many documents there are. Suffix sums over it answer, for
every context limit, how many documents are longer, how many tokens they hold, and how many
tokens remain when each document is cut at the limit.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator, Sequence

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keep, once_per_worker, vocabulary
from corpusloom.operators.ordered import running_sums

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Lengths per block of the suffix sums; a block's rows meet in one task.
BLOCK_LENGTHS = 4096

#: Columns of a curve besides its groups.
CURVE = (
    "n_tokens", "docs", "tokens", "docs_from", "tokens_from", "docs_all", "tokens_all", "truncated_tokens", "quantile",
)


def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once a worker."""

    def load() -> tiktoken.Encoding:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return once_per_worker(f"encoding {path}", load)


def document_lengths(
    docs: DataFrame, text: str = "text", groups: Sequence[str] = (), path: str | None = None
) -> DataFrame:
    """One row for each document: its groups and ``n_tokens``. Null and empty texts have 0 tokens.

    Control strings in a text are ordinary text. Other columns are not read.
    """
    path = path or vocabulary(VOCABULARY)
    columns = [F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]
    rows = docs.select(*columns, F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"]
            )

    schema = ", ".join([*[f"{c} {t}" for c, t in rows.dtypes[:-1]], "n_tokens bigint"])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(groups)], "n_tokens")


def length_histogram(lengths: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Documents by length: ``n_tokens``, ``docs``. Counts are combined before the shuffle."""
    return lengths.groupBy(*groups, "n_tokens").agg(F.count("*").alias("docs"))


def length_curve(histogram: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The histogram with its suffix sums, a row for each group and distinct length.

    - ``docs``, ``tokens``: documents of exactly this length, and their tokens
    - ``docs_from``, ``tokens_from``: of this length or more
    - ``docs_all``, ``tokens_all``: of any length
    - ``truncated_tokens``: what remains when every document is cut at this length
    - ``quantile``: share of documents of this length or less

    Groups may be null. An empty histogram has an empty curve. The sums run over blocks of
    lengths, so no task holds more than a block, also where one group has very many lengths.
    """
    # One struct as key: null groups then join with themselves, and no group at all is a key too.
    parts = [c for g in groups for c in (F.col(g).isNull(), F.coalesce(F.col(g).cast("string"), F.lit("")))]
    rows = histogram.select(
        F.struct(F.lit(0), *parts).alias("_k"),
        *groups,
        "n_tokens",
        "docs",
        (F.col("docs") * F.col("n_tokens")).alias("tokens"),
        F.floor(F.col("n_tokens") / BLOCK_LENGTHS).alias("_at"),
    )
    rows = keep(rows)  # small, and read several times
    summed = running_sums(
        rows, ["_k"], "n_tokens", {"_d": F.col("docs"), "_t": F.col("tokens")}, block=F.col("_at")
    )
    totals = rows.groupBy("_k").agg(F.sum("docs").alias("docs_all"), F.sum("tokens").alias("tokens_all"))
    joined = summed.join(totals, "_k")
    docs_from, tokens_from = F.col("docs_all") - F.col("_d"), F.col("tokens_all") - F.col("_t")
    return joined.select(
        *groups,
        "n_tokens",
        "docs",
        "tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        "docs_all",
        "tokens_all",
        (F.col("_t") + docs_from * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("_d") + F.col("docs")) / F.col("docs_all")).alias("quantile"),
    )


def at_limits(curve: DataFrame, limits: Sequence[int], groups: Sequence[str] = ()) -> DataFrame:
    """Answers for any context limits: documents that are longer, and tokens after cutting.

    A limit between two lengths takes the suffix sums of the next longer one; above the
    longest, nothing is cut.
    """
    wanted = curve.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    longer = F.when(F.col("n_tokens") > F.col("limit"), F.col("n_tokens"))
    next_row = F.min_by(F.struct("docs_from", "tokens_from"), longer)
    found = wanted.groupBy(*groups, "limit").agg(
        F.when(F.min(longer).isNotNull(), next_row).alias("next"), F.max("tokens_all").alias("tokens_all")
    )
    over, cut = F.coalesce("next.docs_from", F.lit(0)), F.coalesce("next.tokens_from", F.lit(0))
    return found.select(
        *groups,
        "limit",
        over.alias("docs_over"),
        (F.col("tokens_all") - cut + over * F.col("limit")).alias("truncated_tokens"),
    )


def token_counts(docs: DataFrame, text: str = "text", groups: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Encode ``docs`` once and return the length curve of each group.

    Groups named like columns of the curve are returned with ``_group`` after their names.
    """
    names: dict[str, str] = {}
    for g in groups:
        name = g
        while name in CURVE or name in names.values():
            name += "_group"
        names[g] = name
    own = f"_text_{uuid.uuid4().hex}"
    renamed = docs.select(*[F.col(g).alias(n) for g, n in names.items()], F.col(text).alias(own))
    grouped = list(names.values())
    return length_curve(length_histogram(document_lengths(renamed, own, grouped, path), grouped), grouped)
