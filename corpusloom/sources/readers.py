"""Typed readers for corpora, text files, load-run tables and service logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.constants import STAGE_EVENTS
from corpusloom.functions import binary
from corpusloom.functions.text import strip
from corpusloom.operators.locators import as_float, as_int, as_string, meta_fields


def read_corpus(
    spark: SparkSession, path: str, key: str = "doc_id", owner: str = "source", language: str = "lang", text: str = "text"
) -> DataFrame:
    """Documents as (doc_id, owner, language, text); only these columns are scanned."""
    df = spark.read.parquet(path)
    return df.select(
        F.col(key).alias("doc_id"), F.col(owner).alias("owner"), F.col(language).alias("language"), F.col(text).alias("text")
    )


def read_text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text files as decoded documents, and the files that are no text as rejects."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), "content")
    return decode_files(raw, ["path", "size_bytes"])


def decode_files(raw: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split raw bytes (column ``content``) into decoded texts and rejects."""
    c = F.col("content")
    df = raw.withColumn("encoding", binary.detect_encoding(c)).withColumn("byte_order_mark", binary.has_bom(c))
    df = df.withColumn("text", binary.decode_bytes(c, F.col("encoding")))
    bad = binary.looks_binary(c, F.col("text"), F.col("encoding"), F.col("byte_order_mark"))
    problem = (
        F.when(F.octet_length(c) == 0, F.lit("empty_file"))
        .when(F.col("text").isNull(), F.lit("undecodable"))
        .when(bad, F.lit("binary_content"))
        .when(strip(F.col("text")) == "", F.lit("no_text"))
    )
    df = df.withColumn("problem", problem)
    good = df.where(F.col("problem").isNull()).select(*keys, "encoding", "byte_order_mark", "text")
    return good, df.where(F.col("problem").isNotNull()).select(*keys, "problem")


def _strict_boolean(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that convert to ``schema``, and the others with the first bad column.

    Blank fields are null; a byte order mark before the header is skipped, because the
    header row is not used for names. A boolean must be true or false.
    """
    names = [f.name for f in schema.fields]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.csv(path, schema=text, header=True, nullValue="", enforceSchema=True, encoding="UTF-8", multiLine=False)
    typed, problem = [], F.lit(None).cast("string")
    for f in reversed(schema.fields):
        c = F.col(f.name)
        value = _strict_boolean(c) if isinstance(f.dataType, T.BooleanType) else c.try_cast(f.dataType)
        typed.insert(0, value.alias(f.name))
        bad = (strip(c) != "") & value.isNull()
        if not f.nullable:
            bad = F.coalesce(value.isNull(), F.lit(True)) | bad
        problem = F.when(F.coalesce(bad, F.lit(False)), F.lit(f.name)).otherwise(problem)
    df = raw.withColumn("_problem", problem)
    good = df.where(F.col("_problem").isNull()).select(*typed)
    rejects = df.where(F.col("_problem").isNotNull()).select(F.col("_problem").alias("bad_column"), *names)
    return good, rejects


def read_request_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read_csv(spark, path, schemas.REQUEST_RECORDS)


def read_level_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read_csv(spark, path, schemas.LEVEL_SUMMARIES)


def parse_stage_log(lines: DataFrame, text: str = "value", keep: tuple[str, ...] = (), arrived: Column | None = None) -> DataFrame:
    """Stage events of a JSON-lines service log; works on batch and streaming input.

    Lines that are no JSON object, name another event, or lack a positive file id or a
    numeric duration are dropped. ``arrived`` is the completion time of events without a
    usable timestamp.
    """
    counts = ("chunk_count", "structure_unit_count", "text_unit_count", "size_bytes")
    names = ("event", "file_idx", "duration_ms", "total_duration_ms", "stage", "file_type", "timestamp", *counts)
    # A line that names none of the events cannot be kept; testing that is cheaper than parsing it.
    named = F.array_contains(F.array(*[F.col(text).contains(e) for e in STAGE_EVENTS]), True)
    df = lines.where(named).withColumn("_v", meta_fields(F.try_parse_json(F.col(text)), names))
    v = F.col("_v")
    declared = v["duration_ms"].isNotNull()
    duration = F.when(declared, as_float(v["duration_ms"])).otherwise(as_float(v["total_duration_ms"]))
    event, stage = as_string(v["event"]), as_string(v["stage"])
    done = F.when(event == "file_processing_completed", F.lit("file_processing")).otherwise(event)
    when = F.try_to_timestamp(as_string(v["timestamp"]))
    row = F.struct(
        as_int(v["file_idx"], 1).alias("file_idx"),
        F.coalesce(as_string(v["file_type"]), F.lit("unknown")).alias("file_type"),
        F.coalesce(F.when(stage != "", stage), done).alias("stage"),
        event.alias("event"),
        (when if arrived is None else F.coalesce(when, arrived.cast("timestamp"))).alias("completed_at"),
        duration.alias("duration_ms"),
        *[as_int(v[n], 0).alias(n) for n in counts],
    )
    # A filter on top would be pushed down and parse the line again for each condition.
    valid = F.filter(
        F.array(row),
        lambda r: r["event"].isin(*STAGE_EVENTS) & r["file_idx"].isNotNull() & r["duration_ms"].isNotNull(),
    )
    return df.select(*keep, F.inline(valid))
