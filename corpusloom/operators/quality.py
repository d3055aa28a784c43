"""Data-quality rules: every violation becomes a reject row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import MAX_QUERY_CHARS, MAX_REFERENCE_FILES, MAX_TOP_K
from corpusloom.functions.text import strip


@dataclass(frozen=True)
class Rule:
    """``ok`` must not be false; null passes, as in a CHECK constraint."""

    name: str
    ok: Column


def one_of(column: str, *allowed: str) -> Rule:
    return Rule(f"{column}_allowed", F.col(column).isin(*allowed))


def in_range(column: str, low, high) -> Rule:
    return Rule(f"{column}_range", F.col(column).between(low, high))


def at_least(column: str, low) -> Rule:
    return Rule(f"{column}_minimum", F.col(column) >= low)


def not_after(first: str, second: str) -> Rule:
    return Rule(f"{first}_before_{second}", F.col(first) <= F.col(second))


def max_length(column: str, n: int) -> Rule:
    return Rule(f"{column}_length", F.length(column) <= n)


def required(column: str) -> Rule:
    return Rule(f"{column}_required", F.col(column).isNotNull())


# The states that the catalog's enumerations allow. A job may also wait for
# its callback, a state that is written although the schema does not list it.
FILE_STATES = ("UPLOADED", "PROCESSING", "READY", "FAILED", "DELETED")
JOB_STATES = ("PENDING", "RUNNING", "SUCCESS", "FAILED", "RETRY_WAIT", "CANCELLED", "WAITING_CALLBACK")


def check_constraints(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """All broken rules of a table in one pass: (keys, rule)."""
    broken = F.filter(
        F.array(*[F.when(~r.ok, F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def foreign_key_violations(
    df: DataFrame, keys: list[str], column: str, parents: DataFrame, parent: str
) -> DataFrame:
    """Rows whose reference has no parent; null references pass."""
    ids = parents.select(F.col(parent).alias(column)).distinct()
    lost = df.where(F.col(column).isNotNull()).join(ids, column, "left_anti")
    return lost.select(*keys, F.lit(f"{column}_missing_parent").alias("rule"))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; null keys never collide."""
    present = df.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x))
    return present.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def validate_reference_list(requests: DataFrame, key: str, files: str = "file_idxs") -> DataFrame:
    """Reference lists that are empty, too long, not positive, or not unique."""
    c = F.col(files)
    return check_constraints(
        requests,
        [key],
        [
            Rule("reference_count", F.coalesce(F.size(c), F.lit(0)).between(1, MAX_REFERENCE_FILES)),
            Rule("reference_positive", ~F.exists(c, lambda x: x.isNull() | (x <= 0))),
            Rule("reference_unique", F.size(F.array_distinct(c)) == F.size(c)),
        ],
    )


def validate_search_params(requests: DataFrame, key: str) -> DataFrame:
    """Requests with a top_k, threshold or query outside the limits."""
    t = F.col("score_threshold")
    return check_constraints(
        requests,
        [key],
        [
            Rule("top_k_range", F.coalesce(F.col("top_k"), F.lit(0)).between(1, MAX_TOP_K)),
            Rule("threshold_range", t.isNull() | (~F.isnan(t) & t.between(-1, 1))),
            Rule("query_length", F.length(strip(F.coalesce("query", F.lit("")))).between(1, MAX_QUERY_CHARS)),
        ],
    )
