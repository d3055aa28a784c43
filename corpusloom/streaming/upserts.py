"""Version-guarded upserts and unique keys per micro-batch, as a compacted log.

A micro-batch only adds its own folder, named by the batch id, so a batch that runs again
after a failure writes the same folder again and nothing else. Every ``COMPACT_EVERY`` batches the
log of all batches before the running one is resolved into one folder, and a snapshot file that names
it is published. A reader opens the folder of the latest snapshot and the batches after it, so their
number is bounded. Folders that two snapshots have replaced are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.dealing import deal
from corpusloom.operators.index import metadata_version_upsert, stale_version_guard, summarize_applicable
from corpusloom.sources import snapshots

#: Batches after a snapshot before there is a new one.
COMPACT_EVERY = 20

Resolve = Callable[[DataFrame], DataFrame]


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in snapshots.names_in(spark, path, "batch=*"))


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches that still matter, with the number of their batch; none before the first."""
    wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    _, held = snapshots.current(spark, f"{path}/snapshots")
    later = [f"{path}/batch={b}" for b in _batches(spark, path) if b > held.get("upto", -1)]
    log = spark.read.schema(wide).parquet(f"{path}/{held['folder']}") if held else spark.createDataFrame([], wide)
    if later:
        log = log.unionByName(spark.read.schema(wide).option("basePath", path).parquet(*later))
    return log


def compact(spark: SparkSession, path: str, schema: T.StructType, before: int, resolve: Resolve | None = None) -> None:
    """Resolve all batches below ``before``, which is running and may run again, into one folder.

    ``resolve`` keeps the rows that later reads need, with their batch numbers; all rows stay without it.
    A loss between any two steps leaves the log as it was or as it will be.
    """
    number, held = snapshots.current(spark, f"{path}/snapshots")
    log = read_log(spark, path, schema).where(F.col("batch") < before)
    folder = f"data/{uuid.uuid4().hex}"
    (resolve(log) if resolve else log).select(*schema.names, "batch").write.parquet(f"{path}/{folder}")
    snapshots.publish(spark, f"{path}/snapshots", number + 1, {"folder": folder, "upto": before - 1})
    used = {content["folder"] for content in snapshots.retire(spark, f"{path}/snapshots")}
    for name in snapshots.names_in(spark, f"{path}/data", "*"):
        if f"data/{name}" not in used:
            snapshots.remove_folder(spark, f"{path}/data/{name}")
    for batch in _batches(spark, path):
        if batch <= held.get("upto", -1):
            snapshots.remove_folder(spark, f"{path}/batch={batch}")


def _maybe_compact(spark: SparkSession, path: str, schema: T.StructType, batch: int, every: int, resolve: Resolve | None) -> None:
    _, held = snapshots.current(spark, f"{path}/snapshots")
    if sum(held.get("upto", -1) < b < batch for b in _batches(spark, path)) >= every:
        compact(spark, path, schema, batch, resolve)


def _newest_version(partitions: int | None) -> Resolve:
    """Of each file the rows of its highest version, of equal ones those of the later batch."""

    def resolve(log: DataFrame) -> DataFrame:
        keys = ["file_idx", "index_version", "batch"]
        best = deal(log.select(*keys), ["file_idx"], partitions).groupBy("file_idx").agg(F.max(F.struct("index_version", "batch")).alias("_v"))
        best = best.select("file_idx", "_v.index_version", "_v.batch")
        return deal(log, keys, partitions).join(deal(best, keys, partitions), keys, "left_semi")

    return resolve


def chunk_state(base: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Chunks after all batches.

    The log holds accepted documents only, so a logged file is replaced by its highest
    logged version (of equal ones by the later batch); other files are untouched.
    ``partitions`` is the number that rows are dealt into by file.
    """
    current = _newest_version(partitions)(read_log(base.sparkSession, path, base.schema)).select(*base.columns)
    logged = deal(current.select("file_idx").distinct(), ["file_idx"], partitions)
    kept = deal(base, ["file_idx"], partitions).join(logged, "file_idx", "left_anti")
    return kept.select(*base.columns).unionByName(current)


def versioned_chunk_batch(
    base: DataFrame, path: str, outcomes: str, compact_every: int = COMPACT_EVERY, partitions: int | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that applies synchronised chunks and counts the outcomes.

    The batch is reduced to the highest version of each file first. Stale documents are
    counted and not stored; only versions are read from the state for that. ``partitions`` is the number
    that rows are dealt into by file.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        _maybe_compact(base.sparkSession, path, base.schema, batch_id, compact_every, _newest_version(partitions))
        counted = deal(batch.select("file_idx", "index_version"), ["file_idx"], partitions)
        counted = counted.groupBy("file_idx", "index_version").agg(F.count("*").alias("n_chunks"))
        newest = counted.groupBy("file_idx").agg(F.max_by(F.struct("index_version", "n_chunks"), "index_version").alias("v"))
        log = read_log(base.sparkSession, path, base.schema).where(F.col("batch") < batch_id)
        versions = base.select("file_idx", "index_version").unionByName(log.select("file_idx", "index_version"))
        versions = deal(versions, ["file_idx"], partitions)
        judged = stale_version_guard(versions, newest.select("file_idx", "v.*"))
        judged.groupBy("outcome").agg(F.count("*").alias("files")).write.mode("overwrite").parquet(f"{outcomes}/batch={batch_id}")
        keys = ["file_idx", "index_version"]
        stored = deal(judged.where("outcome = 'STORED'").select(*keys), keys, partitions)
        rows = deal(batch, keys, partitions).join(stored, keys, "left_semi").select(*base.columns)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def _deciding_callbacks(base: DataFrame, partitions: int | None) -> Resolve:
    """Of each file the callbacks that its state rests on.

    These are the last that applies, the last success that applies, and one of the highest
    version, against which later callbacks are judged. They give the same state as all.
    """

    def resolve(log: DataFrame) -> DataFrame:
        row = F.struct(*log.columns)
        aggs = [
            F.max_by(row, "seq").alias("a"),
            F.max_by(row, F.when(F.col("success"), F.col("seq"))).alias("b"),
            F.max_by(row, F.struct("index_version", "seq")).alias("c"),
        ]
        kept = summarize_applicable(base, log, aggs, partitions)
        rows = F.array_distinct(F.array_compact(F.array("a", "b", "c")))
        return kept.select(F.explode(rows).alias("r")).select("r.*")

    return resolve


def metadata_batch(
    base: DataFrame, path: str, compact_every: int = COMPACT_EVERY, partitions: int | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that logs callbacks (file_idx, seq, success, index_version, values)."""
    return append_batch(path, _deciding_callbacks(base, partitions), compact_every)


def metadata_state(base: DataFrame, path: str, values: list[str], schema, partitions: int | None = None) -> DataFrame:
    """Metadata after all callbacks, applied in order of batch and sequence."""
    log = read_log(base.sparkSession, path, schema)
    # The sequence restarts in no batch, so (batch, seq) order is a plain number.
    return metadata_version_upsert(base, log.drop("batch"), values, partitions)


def append_batch(
    path: str, resolve: Resolve | None = None, compact_every: int = COMPACT_EVERY
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps each batch in its own folder until it is compacted."""

    def run(batch: DataFrame, batch_id: int) -> None:
        _maybe_compact(batch.sparkSession, path, batch.schema, batch_id, compact_every, resolve)
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def _latest(keys: list[str]) -> Resolve:
    def resolve(log: DataFrame) -> DataFrame:
        rest = [c for c in log.columns if c not in keys]
        return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")

    return resolve


def update_batch(path: str, keys: list[str], compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for rows that replace earlier ones of the same keys."""
    return append_batch(path, _latest(keys), compact_every)


def latest_rows(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Of the rows that batches have added for each key, those of the last batch."""
    return _latest(keys)(read_log(spark, path, schema)).select(*schema.names)


def unique_upload_batch(
    path: str, schema, keys: list[str], order: str, compact_every: int = COMPACT_EVERY
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the first row of each key for ever.

    Rows without a key are all kept. Earlier batches are looked up by an anti join.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        _maybe_compact(batch.sparkSession, path, schema, batch_id, compact_every, None)
        has_key = F.col(keys[-1]).isNotNull()
        rest = [c for c in batch.columns if c not in keys]
        first = batch.where(has_key).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
        first = first.select(*keys, "_r.*").select(*batch.columns)
        seen = read_log(batch.sparkSession, path, schema).where(F.col("batch") < batch_id).select(*keys)
        fresh = first.join(seen, keys, "left_anti").unionByName(batch.where(~has_key))
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run
