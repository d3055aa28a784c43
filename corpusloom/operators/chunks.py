"""Overlapping chunks with exact offsets and deterministic ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import (
    CHUNK_OVERLAP,
    CHUNK_SEPARATORS,
    CHUNK_SIZE,
    UNIT_SEPARATOR_LENGTH,
    WS_CHARS,
)
from corpusloom.functions.identity import chunk_id, content_hash
from corpusloom.functions.text import unify_newlines
from corpusloom.operators.ordered import running_sums

STRATEGY_NAME = "structure-preserving-character"
STRATEGY_VERSION = "1"


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[int]:
    """Chunk bounds of one text as a flat list: start, end, start, end, ...

    Every chunk takes up to ``size`` characters and prefers to stop after the last
    separator found late enough in it. The next one starts ``overlap`` before that stop.
    """
    reach = max(overlap + 1, size // 2)
    spans: list[int] = []
    begin, length = 0, len(text)
    while begin < length:
        stop = begin + size
        if stop >= length:
            stop = length
        else:
            for separator in CHUNK_SEPARATORS:
                at = text.rfind(separator, min(begin + reach, stop), stop)
                if at != -1:
                    stop = at + len(separator)
                    break
        piece = text[begin:stop].rstrip()
        body = piece.lstrip()
        if body:
            end = begin + len(piece)
            spans += (end - len(body), end)
        if stop == length:
            break
        begin = max(stop - overlap, begin + 1)
    return spans


_PIECES = "array<struct<start:int,end:int,content:string>>"


def _piece_lists(rows: list[list[tuple] | None], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Nested Arrow array of per-row tuples."""
    offsets = np.cumsum([0, *[len(r or ()) for r in rows]]).astype(np.int32)
    flat = [piece for r in rows for piece in r or ()]
    columns = list(zip(*flat)) or [()] * len(fields)
    struct = pa.StructArray.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields)], fields=[pa.field(n, t) for n, t in fields]
    )
    return pa.ListArray.from_arrays(pa.array(offsets), struct)


def chunk_pieces(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """``array<struct<start,end,content>>`` of the chunks of a text.

    A text of at most ``size`` characters is one trimmed chunk and is answered in the
    JVM; only longer texts cross to Python, in Arrow batches.
    """
    _check(size, overlap)

    def pieces(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            spans = chunk_spans(t, size, overlap) if t is not None else []
            rows.append([(a, b, t[a:b]) for a, b in zip(spans[::2], spans[1::2])])
        return _piece_lists(rows, [("start", pa.int32()), ("end", pa.int32()), ("content", pa.string())])

    short = F.length(text) <= size
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(WS_CHARS)))
    body = F.btrim(text, F.lit(WS_CHARS))
    one = F.array(F.struct(lead.alias("start"), (lead + F.length(body)).alias("end"), body.alias("content")))
    one = F.when(body != "", one).otherwise(F.array().cast(_PIECES))
    return F.when(short, one).otherwise(F.arrow_udf(pieces, _PIECES)(F.when(~short, text)))


def chunk_text(
    docs: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Chunks of one text per row: (key, slice_index, start_offset, end_offset, content)."""
    df = docs.select(key, F.posexplode(chunk_pieces(F.col(text), size, overlap)).alias("slice_index", "_s"))
    return df.select(
        key,
        "slice_index",
        F.col("_s.start").alias("start_offset"),
        F.col("_s.end").alias("end_offset"),
        F.col("_s.content").alias("content"),
    )


def chunk_units(
    units: DataFrame,
    doc: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Chunks of located units; a chunk never crosses a unit.

    ``units`` has the document key, unit_index and text. Units are chunked independently
    of each other; document offsets and the contiguous chunk_index come from running sums
    over unit totals, cut into blocks so that one huge document spreads over many tasks.
    """
    sized = units.where(F.length("text") > 0).select(
        doc, "unit_index", F.length("text").alias("_length"), *carry,
        chunk_pieces(F.col("text"), size, overlap).alias("_b"),
    )
    placed = running_sums(
        sized,
        [doc],
        "unit_index",
        {
            "_offset": (F.col("_length") + UNIT_SEPARATOR_LENGTH).cast("long"),
            "_first": F.size("_b").cast("long"),
        },
    )
    rows = placed.select(doc, "unit_index", *carry, "_offset", "_first", F.posexplode("_b").alias("_i", "_s"))
    start, end = F.col("_s.start"), F.col("_s.end")
    return rows.select(
        doc,
        (F.col("_first") + F.col("_i")).alias("chunk_index"),
        F.col("_s.content").alias("content"),
        (F.col("_offset") + start).alias("start_offset"),
        (F.col("_offset") + end).alias("end_offset"),
        "unit_index",
        start.alias("unit_start_offset"),
        end.alias("unit_end_offset"),
        *carry,
    )


_LINE_PIECES = (
    "array<struct<unit_index:int,unit_start:int,unit_end:int,line_start:bigint,offset:bigint,content:string>>"
)


def _line_chunks(text: str, size: int, overlap: int) -> list[tuple]:
    """Chunks of every line of a text file, with the offsets the general path computes."""
    out, line_start, offset = [], 0, 0
    for index, raw in enumerate(text.split("\n")):
        line = raw.rstrip()
        if line:
            spans = chunk_spans(line, size, overlap)
            out += [(index, a, b, line_start, offset, line[a:b]) for a, b in zip(spans[::2], spans[1::2])]
            offset += len(line) + UNIT_SEPARATOR_LENGTH
        line_start += len(raw) + 1
    return out


def chunk_line_documents(
    docs: DataFrame, doc: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Line units and their chunks in one pass, for text files held as one row each.

    Gives the rows of ``text_to_line_units`` followed by ``chunk_units``. As a document
    never leaves its row, nothing is shuffled.
    """
    _check(size, overlap)
    kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.string()]
    names = ["unit_index", "unit_start", "unit_end", "line_start", "offset", "content"]

    def pieces(texts: pa.Array) -> pa.Array:
        rows = [_line_chunks(t, size, overlap) if t is not None else [] for t in texts.to_pylist()]
        return _piece_lists(rows, list(zip(names, kinds)))

    found = F.arrow_udf(pieces, _LINE_PIECES)(unify_newlines(F.col(text)))
    df = docs.select(doc, *carry, F.posexplode(found).alias("_i", "_s"))
    s = F.col("_s")
    return df.select(
        doc,
        F.col("_i").cast("long").alias("chunk_index"),
        s["content"].alias("content"),
        (s["offset"] + s["unit_start"]).alias("start_offset"),
        (s["offset"] + s["unit_end"]).alias("end_offset"),
        s["unit_index"].alias("unit_index"),
        s["unit_start"].alias("unit_start_offset"),
        s["unit_end"].alias("unit_end_offset"),
        s["line_start"].alias("text_char_start"),
        *carry,
    )


def with_identity(
    chunks: DataFrame,
    owner: Column,
    file: Column,
    file_hash: Column,
    file_type: Column,
    parser_version: str,
    embedding_model: str,
    index_version: Column,
) -> DataFrame:
    """Add content_hash and chunk_id."""
    hashed = chunks.withColumn("content_hash", content_hash(F.col("content")))
    return hashed.withColumn(
        "chunk_id",
        chunk_id(
            owner,
            file,
            file_hash,
            file_type,
            F.lit(parser_version),
            F.lit(embedding_model),
            index_version,
            F.col("chunk_index"),
            F.col("content_hash"),
        ),
    )


def decorate_chunks(chunks: DataFrame, file_type: Column, text_char_start: Column | None = None) -> DataFrame:
    """Name the strategy; for text files add the character range in the source."""
    out = chunks.withColumn("chunking_strategy", F.lit(STRATEGY_NAME)).withColumn(
        "chunking_strategy_version", F.lit(STRATEGY_VERSION)
    )
    if text_char_start is None:
        return out
    base = F.when((file_type == "txt") & (text_char_start >= 0), text_char_start)
    return out.withColumn("chunk_source_char_start", base + F.col("unit_start_offset")).withColumn(
        "chunk_source_char_end", base + F.col("unit_end_offset")
    )


def validate_chunks(docs: DataFrame, chunks: DataFrame, doc: str) -> DataFrame:
    """Broken chunk contracts as (doc, rule, detail) rows.

    Ids are unique inside a document (``duplicate_chunk_id``); one that several documents
    bear is told of each of them (``shared_chunk_id``). Uniqueness counts (doc, id) groups, so
    no per-document set of ids is built.
    """
    span = F.col("end_offset") - F.col("start_offset")
    per_doc = chunks.groupBy(doc).agg(
        F.count("*").alias("n"),
        F.min("chunk_index").alias("lo"),
        F.max("chunk_index").alias("hi"),
        F.count_if(span != F.length("content")).alias("bad_span"),
    )
    index_copies = (
        chunks.groupBy(doc, "chunk_index").count().where("count > 1").groupBy(doc).agg(F.count("*").alias("dup_index"))
    )
    ids = chunks.groupBy(doc, "chunk_id").agg(F.count("*").alias("c"))
    id_copies = ids.where("c > 1").groupBy(doc).agg(F.count("*").alias("dup_id"))
    shared = ids.groupBy("chunk_id").agg(F.count("*").alias("docs")).where("docs > 1").select("chunk_id")
    shared = ids.join(shared, "chunk_id", "left_semi").groupBy(doc).agg(F.count("*").alias("shared_id"))
    df = docs.select(doc).join(per_doc, doc, "left").join(index_copies, doc, "left")
    df = df.join(id_copies, doc, "left").join(shared, doc, "left")
    df = df.fillna(0, ["n", "dup_index", "dup_id", "shared_id", "bad_span"])
    gap = (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("dup_index") > 0)
    rules = [
        ("no_chunks", F.col("n") == 0, F.lit(0).cast("long")),
        ("index_not_contiguous", gap, F.col("n")),
        ("duplicate_chunk_id", F.col("dup_id") > 0, F.col("dup_id")),
        ("shared_chunk_id", F.col("shared_id") > 0, F.col("shared_id")),
        ("span_length_mismatch", F.col("bad_span") > 0, F.col("bad_span")),
    ]
    return reject_rows(df, [doc], rules)


def reject_rows(df: DataFrame, keys: list[str], rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row per broken rule: the keys, the rule name and a numeric detail."""
    broken = F.filter(
        F.array(
            *[
                F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("long").alias("detail")))
                for name, bad, detail in rules
            ]
        ),
        lambda x: x.isNotNull(),
    )
    return df.select(*keys, F.explode(broken).alias("_r")).select(*keys, "_r.rule", "_r.detail")


def chunk_counts(units: DataFrame, chunks: DataFrame, doc: str) -> DataFrame:
    """Source units, units with text, and chunks per document."""
    u = units.groupBy(doc).agg(
        F.count("*").alias("source_unit_count"),
        F.count_if(F.length("text") > 0).alias("text_unit_count"),
    )
    c = chunks.groupBy(doc).agg(F.count("*").alias("chunk_count"))
    return u.join(c, doc, "left").fillna(0, ["chunk_count"])


def dedup_by_content_hash(items: DataFrame, scope: list[str], order: str, process) -> tuple[DataFrame, DataFrame]:
    """Process each distinct content once and fan the result back to every location.

    ``process`` maps a DataFrame of (scope, sha256, content) to (scope, sha256, result).
    Returns the located results and the counts per scope. Copies are reduced map-side by
    hash, so a content that makes up much of the table costs one row per map task.
    """
    hashed = items.withColumn("sha256", content_hash(F.col("content")))
    unique = hashed.groupBy(*scope, "sha256").agg(
        F.min_by("content", order).alias("content"), F.count("*").alias("copies")
    )
    results = process(unique.select(*scope, "sha256", "content"))
    located = hashed.drop("content").join(results, [*scope, "sha256"])
    counts = unique.groupBy(*scope).agg(
        F.sum("copies").alias("candidate_count"),
        F.count("*").alias("unique_count"),
        (F.sum("copies") - F.count("*")).alias("deduplicated_count"),
    )
    return located, counts
