"""Ordered work inside groups of any size.

A window over ``partition by key`` puts a whole group in one task. When one key may hold
a large share of the rows, the group is cut into blocks of its order column first: block
totals are pre-aggregated map-side, a narrow window runs over the totals, and the full
rows only meet their own block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: Rows from which a key counts as large.
LARGE_GROUP = 100_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join in which a null key meets a null key; the keys appear once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, match).drop(*[f"_r_{k}" for k in keys])


def _running(df, keys, order, exprs, block, inclusive, total, combine):
    """Running aggregate per key, block totals first; ``combine`` merges base and inner part."""
    block = F.floor(F.col(order) / BLOCK_ROWS) if block is None else block
    rows = df.withColumn("_block", block.cast("long"))
    totals = rows.groupBy(*keys, "_block").agg(*[total(e).alias(f"_t_{n}") for n, e in exprs.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *keys, "_block", *[total(F.col(f"_t_{n}")).over(before).alias(f"_b_{n}") for n in exprs]
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return join_null_safe(rows, bases, [*keys, "_block"]).select(
        *df.columns,
        *[combine(F.col(f"_b_{n}"), total(e).over(inside)).alias(n) for n, e in exprs.items()],
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    block: Column | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Add, per key, the running sum of each expression in ``order``.

    ``order`` must be unique inside a key. ``block`` maps rows to blocks that follow the
    order; by default an integer order column is cut every ``BLOCK_ROWS`` values.
    """

    def plus(base: Column, inner: Column) -> Column:
        return F.coalesce(base, F.lit(0)) + F.coalesce(inner, F.lit(0))

    return _running(df, keys, order, sums, block, inclusive, F.sum, plus)


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    maxima: dict[str, Column],
    block: Column | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Add, per key, the running maximum of each expression; null before any value."""
    return _running(df, keys, order, maxima, block, inclusive, F.max, F.greatest)


def by_group_size(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of keys with up to ``LARGE_GROUP`` rows, and those of the few larger keys."""
    large = df.groupBy(*keys).count().where(F.col("count") > LARGE_GROUP).select(*keys)
    return df.join(F.broadcast(large), list(keys), "left_anti"), df.join(F.broadcast(large), list(keys), "left_semi")


def running_max_small(df: DataFrame, keys: Sequence[str], order: str, maxima: dict[str, Column]) -> DataFrame:
    """``running_max`` in one window, for keys of few rows: no shuffle where rows are dealt by key."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(*df.columns, *[F.max(e).over(before).alias(n) for n, e in maxima.items()])


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: Column | None = None
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its key."""
    block = F.floor(F.col(order) / BLOCK_ROWS) if block is None else block
    rows = df.withColumn("_v", value).withColumn("_block", block.cast("long"))
    lasts = rows.groupBy(*keys, "_block").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_block", F.last("_last", True).over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    return join_null_safe(rows, carried, [*keys, "_block"]).select(
        *df.columns, F.coalesce(F.last("_v", True).over(inside), F.col("_carry")).alias(out)
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], block: Column
) -> DataFrame:
    """Add ``prev_<value>``: the values of the row just before, per key, across blocks."""
    rows = df.withColumn("_block", block.cast("long"))
    last = F.max_by(F.struct(*values), F.col(order)).alias("_last")
    lasts = rows.groupBy(*keys, "_block").agg(last)
    by_block = Window.partitionBy(*keys).orderBy("_block")
    carried = lasts.select(*keys, "_block", F.lag("_last").over(by_block).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    joined = join_null_safe(rows, carried, [*keys, "_block"])
    joined = joined.withColumn("_prev", F.lag(F.struct(*values)).over(inside))
    joined = joined.withColumn("_prev", F.coalesce("_prev", "_carry"))
    return joined.select(*df.columns, *[F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values])


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, tuple], tuple[object, object]],
    inputs: Sequence[str],
    out: str,
    out_type: str,
) -> DataFrame:
    """A left fold per key in a given order, one output value per row.

    For decisions that depend on earlier decisions, where no window can express the
    result. Rows are shuffled by key and sorted by Spark; each task streams its sorted
    batches and keeps only the state of the current key, so memory does not grow with a
    group. Callers cut keys as finely as the decision allows.

    All columns pass through as Arrow data, so ids keep their 64 bits and a null key is a
    key of its own. Null inputs reach ``step`` as None.
    """
    keys, inputs = list(keys), list(inputs)
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T._parse_datatype_string(out_type)
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    names = df.columns
    arrow_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            picked = {c: columns[names.index(c)].to_pylist() for c in {*keys, *inputs}}
            results = []
            for i in range(batch.num_rows):
                key = [picked[k][i] for k in keys]
                if key != current:
                    current, state = key, start()
                state, result = step(state, tuple(picked[c][i] for c in inputs))
                results.append(result)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(results, arrow_type)], names=[*names, out])

    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(run, schema)


def gap_segments(
    df: DataFrame, keys: Sequence[str], at: str, tie: str, gap: int, block: int, at_gap: bool = False
) -> DataFrame:
    """Number the stretches of each key that a pause longer than ``gap`` separates.

    Adds ``_segment`` and ``_o`` (the order, time then ``tie``). State that expires within
    ``gap`` never crosses a stretch, so stretches of one key can run on different tasks.
    With ``at_gap`` a pause of exactly ``gap`` separates too. ``block`` is the time span
    of one block of the running count.
    """
    rows = df.withColumn("_o", F.struct(at, tie)).withColumn("_block", F.floor(F.col(at) / block).cast("long"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_o")

    def pauses(before: Column) -> Column:
        pause = F.col(at) - before
        return F.coalesce(pause >= gap if at_gap else pause > gap, F.lit(False)).cast("int")

    # Per block: its ends, and the pauses that lie wholly inside it.
    marked = rows.select(*keys, "_block", "_o", at, pauses(F.lag(at).over(inside)).alias("_p"))
    totals = marked.groupBy(*keys, "_block").agg(F.min(at).alias("_a"), F.max(at).alias("_z"), F.sum("_p").alias("_n"))
    blocks = Window.partitionBy(*keys).orderBy("_block")
    entered = F.coalesce(
        (F.col("_a") - F.lag("_z").over(blocks) >= gap) if at_gap else (F.col("_a") - F.lag("_z").over(blocks) > gap),
        F.lit(False),
    ).cast("int")
    totals = totals.withColumn("_entered", entered)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col("_n") + F.col("_entered")).over(earlier), F.lit(0)) + F.col("_entered")
    bases = totals.select(*keys, "_block", base.alias("_base"))
    joined = join_null_safe(rows, bases, [*keys, "_block"]).withColumn("_p", pauses(F.lag(at).over(inside)))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, "_o", (F.col("_base") + F.sum("_p").over(upto)).alias("_segment"))
