"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite_vector(a: Column, dim: int | Column) -> Column:
    size = F.lit(dim) if isinstance(dim, int) else dim
    return F.coalesce(
        (F.size(a) == size)
        & F.forall(
            a,
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
        ),
        F.lit(False),
    )
