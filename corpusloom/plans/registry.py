"""Query registry: each entry pairs a Spark query with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.constants import LINE_BREAKS, WS, WS_INLINE
from corpusloom.operators.dealing import partitions_for
from corpusloom.plans.derived import DERIVED

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")
# The spellings that differ between the engines in the derived tables.
_EPOCH_US = re.compile(r"EPOCH_US\(([^()]+)\)")
_SPARK_EPOCH_US = (
    r"unix_micros(CAST(convert_timezone('UTC', current_timezone(), \1) AS TIMESTAMP))"
)


class Tables:
    """The input tables of one folder, and the domain tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        if name in DERIVED:
            return self.sql(DERIVED[name])
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        names = set(_PLACEHOLDER.findall(text))
        text = _EPOCH_US.sub(_SPARK_EPOCH_US, text)
        # Braces that are no placeholder are literal text.
        parts = re.split(r"(\{\w+\})", text)
        text = "".join(p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts))
        return self.spark.sql(text, **{name: self(name) for name in names})

    def partitions(self, name: str) -> int:
        """Shuffle partitions that follow the rows of an input table; the count reads file footers only."""
        return partitions_for(self.spark, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").count())


class DealtTables(Tables):
    """The derived tables on top of input tables dealt by key into a number of partitions."""

    def __init__(self, t: Tables, keys: dict[str, str], partitions: int):
        super().__init__(t.spark, t.sf_dir)
        self.keys, self.number = keys, partitions

    def __call__(self, name: str) -> DataFrame:
        df = super().__call__(name)
        return df.repartition(self.number, self.keys[name]) if name in self.keys else df


def by_order(t: Tables) -> tuple[DealtTables, int]:
    """Order lines with their orders, dealt by order; and the number of partitions."""
    n = t.partitions("lineitem")
    return DealtTables(t, {"lineitem": "l_orderkey", "orders": "o_orderkey"}, n), n


def _oracle_with_derived(sql: str) -> str:
    ctes: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in _PLACEHOLDER.findall(text):
            if name in DERIVED and name not in ctes:
                visit(DERIVED[name])
                ctes[name] = _PLACEHOLDER.sub(r"\1", DERIVED[name])

    for token, chars in (("@WS@", WS), ("@WSI@", WS_INLINE), ("@LB@", LINE_BREAKS)):
        sql = sql.replace(token, chars)
    visit(sql)
    body = _PLACEHOLDER.sub(lambda m: m.group(1) if m.group(1) in DERIVED or m.group(1) in BASE_TABLES else m.group(0), sql).strip()
    body = body.replace("TIMESTAMP_NTZ", "TIMESTAMP")
    body = _EPOCH_US.sub(r"epoch_us(\1)", body)
    if not ctes:
        return body
    head = ",\n".join(f"{name} AS ({text})" for name, text in ctes.items())
    head = _EPOCH_US.sub(r"epoch_us(\1)", head).replace("TIMESTAMP_NTZ", "TIMESTAMP")
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[len('WITH'):]}"
    return f"WITH {head}\n{body}"


def query(name: str, covers: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``covers`` lists the inventory ids the query exercises. In ``oracle``, ``{table}``
    stands for an input or derived table.
    """

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        assert name not in QUERIES, name
        QUERIES[name] = run
        COVERS[name] = tuple(covers.split())
        if oracle is not None:
            ORACLES[name] = _oracle_with_derived(oracle)
        return fn

    return wrap
