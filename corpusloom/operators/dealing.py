"""Shuffles whose number of partitions follows the rows.

With a session's fixed number of shuffle partitions, what a task sorts or hashes grows with the
tables. A caller that knows how many rows there are deals them by key into as many partitions as keep
each at about ``ROWS_PER_PARTITION`` rows, whatever the session's number is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_PARTITION = 250_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows; at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PARTITION))


def deal(df: DataFrame, keys: Sequence[str], partitions: int | None) -> DataFrame:
    """Rows dealt by key into ``partitions``; without a number Spark's own shuffles do it."""
    return df if partitions is None else df.repartition(partitions, *keys)
