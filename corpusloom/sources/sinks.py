"""Sinks: index tables laid out by owner, and report files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources import snapshots

OWNER_BUCKETS = 64


def owner_bucket(owner: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(owner.cast("long")), F.lit(buckets)).cast("int")


def _points(spark: SparkSession, path: str, held: dict, wanted: Sequence[int] | None = None) -> DataFrame:
    """Points of the buckets that a snapshot names, or of those of them that are wanted."""
    schema = T.StructType.fromJson(json.loads(held["schema"]))
    named = {int(b): folder for b, folder in held["folders"].items()}
    places = [f"{path}/{folder}/owner_bucket={b}" for b, folder in sorted(named.items()) if wanted is None or b in wanted]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read_index(spark: SparkSession, path: str, owners: Sequence[int] | None = None) -> DataFrame:
    """The index as of its latest snapshot, or the points of ``owners`` only: then no other bucket is opened."""
    _, held = snapshots.current(spark, f"{path}/snapshots")
    if not held:
        raise FileNotFoundError(f"{path} holds no index")
    if owners is None:
        return _points(spark, path, held)
    numbers = F.array(*[owner_bucket(F.lit(int(o)), held["buckets"]) for o in owners])
    wanted = spark.range(1).select(numbers.alias("b")).first()["b"] if owners else []
    return _points(spark, path, held, wanted).where(F.col("users_idx").isin(list(owners)))


def write_index(points: DataFrame, path: str, buckets: int = OWNER_BUCKETS) -> None:
    """Upsert points by chunk_id. Only the owner buckets that the points concern are rewritten.

    These are the buckets of the points' owners, and those where points of the same id lie so
    far. They are written to a new folder, and the snapshot that is published after that takes them
    from there and all other buckets from where they were; a bucket that no point is left in is no longer named.
    Whatever is lost before, readers keep the earlier index. The rebalance hint splits the
    bucket of a very large owner and merges small ones. ``clean_index`` deletes folders no longer in use.
    """
    spark = points.sparkSession
    number, held = snapshots.current(spark, f"{path}/snapshots")
    if held and held["buckets"] != buckets:
        raise ValueError(f"the index has {held['buckets']} buckets")
    placed = points.withColumn("owner_bucket", owner_bucket(F.col("users_idx"), buckets))
    folders = dict(held.get("folders", {}))
    if folders:
        ids = points.select("chunk_id")
        earlier = _points(spark, path, held).select("chunk_id", owner_bucket(F.col("users_idx"), buckets).alias("owner_bucket"))
        # At most one number for each bucket.
        met = placed.select("owner_bucket").union(earlier.join(ids, "chunk_id", "left_semi").select("owner_bucket"))
        touched = {r[0] for r in met.distinct().collect()}
        kept = _points(spark, path, held, touched).join(ids, "chunk_id", "left_anti")
        placed = kept.withColumn("owner_bucket", owner_bucket(F.col("users_idx"), buckets)).unionByName(placed)
        folders = {b: f for b, f in folders.items() if int(b) not in touched}
    folder = f"data/{uuid.uuid4().hex}"
    placed.hint("rebalance", "owner_bucket").write.partitionBy("owner_bucket").parquet(f"{path}/{folder}")
    for name in snapshots.names_in(spark, f"{path}/{folder}", "owner_bucket=*"):
        folders[name.split("=")[1]] = folder
    content = {"buckets": buckets, "schema": placed.drop("owner_bucket").schema.json(), "folders": folders}
    snapshots.publish(spark, f"{path}/snapshots", number + 1, content)


def clean_index(spark: SparkSession, path: str) -> None:
    """Delete bucket folders that neither of the last two snapshots names. No write may be under way."""
    held = snapshots.retire(spark, f"{path}/snapshots")
    used = {(f, int(b)) for content in held for b, f in content["folders"].items()}
    for name in snapshots.names_in(spark, f"{path}/data", "*"):
        for bucket in snapshots.names_in(spark, f"{path}/data/{name}", "owner_bucket=*"):
            if (f"data/{name}", int(bucket.split("=")[1])) not in used:
                snapshots.remove_folder(spark, f"{path}/data/{name}/{bucket}")
        if not snapshots.names_in(spark, f"{path}/data/{name}", "owner_bucket=*"):
            snapshots.remove_folder(spark, f"{path}/data/{name}")


def write_reports(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each result table as CSV, and one JSON summary with their row counts, which is returned.

    The rows are counted while they are written, so each table is evaluated once.
    """
    counts = []
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        counts.append((name, seen.get["n"]))
    spark = df.sparkSession
    schema = "table_name string, row_count bigint"
    spark.createDataFrame(counts, schema).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return spark.read.schema(schema).json(f"{path}/summary")
