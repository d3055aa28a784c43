"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cells per unit of the logarithm in the first round, and equal parts of a cell in the second.
LOG_CELLS = 64
PARTS = 4096


def _inside(start: Column, size: Column):
    return lambda r: (r >= start) & (r < start + size)


def _narrow(rows: DataFrame, group: Sequence[str], cell: str, base: Column | None = None) -> DataFrame:
    """Cells of each group that hold wanted ranks: their first rank, those ranks, and their least and greatest value.

    ``rows``: the group, ``cell``, _v, _c; with _ranks and _before of the cell around, which is
    then part of the group, unless ``base`` gives the ranks of a whole group from its size _n.
    """
    outer = [] if base is not None else [F.max("_before").alias("_before"), F.first("_ranks").alias("_ranks")]
    cells = rows.groupBy(*group, cell).agg(F.sum("_c").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *outer)
    upto = Window.partitionBy(*group).orderBy(cell)
    cells = cells.withColumn("_sum", F.sum("_in").over(upto) - F.col("_in"))
    if base is not None:
        cells = cells.withColumn("_n", F.sum("_in").over(Window.partitionBy(*group))).withColumn("_ranks", base)
        cells = cells.withColumn("_before", F.col("_sum"))
    else:
        cells = cells.withColumn("_before", F.col("_before") + F.col("_sum"))
    cells = cells.withColumn("_ranks", F.filter("_ranks", _inside(F.col("_before"), F.col("_in"))))
    return cells.where(F.size("_ranks") > 0).drop("_sum", "_in")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation at (n - 1) * p / 100, one row per group.

    The built-in exact percentile keeps all distinct values of a group in one buffer. Here equal
    values are counted first, and the wanted ranks are narrowed down as in a radix selection: a
    histogram over cells that grow with the logarithm of the value finds the cells that hold them, a second
    one cuts each of these into equal parts between its own least and greatest value, and only the values of
    the parts with wanted ranks are ordered. The cells decide how much is ordered, never what is
    returned. Every step but the last handles pre-aggregated rows, and no step puts a whole
    group in one task. Null and NaN values do not count; a group without values has no row.
    """
    group = keys or ["_all"]
    if not keys:
        # One group: a key that the optimizer does not fold, so that the joins stay equi-joins.
        df = df.withColumn("_all", F.pmod(F.xxhash64(value), F.lit(1)))
    v = F.col("_v")
    counted = (
        df.select(*group, F.col(value).cast("double").alias("_v"))
        .where(v.isNotNull() & ~F.isnan("_v"))
        .groupBy(*group, "_v")
        .agg(F.count("*").alias("_c"))
        # Of one sign and rising with the value; infinities are cells of their own.
        .withColumn("_cell", F.when(F.abs("_v") == float("inf"), F.signum("_v") * 1e6).otherwise(F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * LOG_CELLS)).cast("int"))
    )
    ranks = []
    for p in percents.values():
        at = (F.col("_n") - 1) * (p / 100.0)
        ranks += [F.floor(at), F.ceil(at)]
    cells = _narrow(counted, group, "_cell", F.array_distinct(F.array(*ranks)))
    chosen = counted.join(cells, [*group, "_cell"])
    span = F.col("_hi") - F.col("_lo")
    # Equal values, and spans beyond all numbers, are one part.
    part = F.when((span > 0) & (span < float("inf")), F.floor((v - F.col("_lo")) / span * PARTS)).otherwise(0).cast("int")
    chosen = chosen.withColumn("_part", part).drop("_lo", "_hi")
    parts = _narrow(chosen, [*group, "_cell", "_n"], "_part").drop("_lo", "_hi", "_n")
    chosen = chosen.drop("_ranks", "_before").join(parts, [*group, "_cell", "_part"])
    order = Window.partitionBy(*group, "_cell", "_part").orderBy("_v")
    chosen = chosen.withColumn("_start", F.col("_before") + F.sum("_c").over(order) - F.col("_c"))
    found = chosen.select(*group, "_v", "_n", F.explode(F.filter("_ranks", _inside(F.col("_start"), F.col("_c")))).alias("_rank"))
    # At most two ranks per percentile.
    out = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"), F.max("_n").alias("_n"))
    columns = []
    for name, p in percents.items():
        at = (F.col("_n") - 1) * (p / 100.0)
        low, high = F.element_at("_m", F.floor(at)), F.element_at("_m", F.ceil(at))
        columns.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return out.select(*keys, *columns)
