"""Nearest neighbours by multi-index hashing over learned binary codes.

Vectors are centred, rotated by a learned rotation and cut to signs. A code is split into
substrings, each with an index of its own. By the pigeonhole principle, codes within Hamming
radius r agree within r // m in one of m substrings, so probing these buckets finds every code
within the radius; the codes found are compared whole, and those inside the radius are reranked
by exact distances in double precision.

The rotation and the radius are learned from bounded samples: the rotation by iterative
quantisation on sampled vectors, the radius so that it holds the stated share of the true
neighbours of sampled queries, which are found among all vectors.

The index is cut into blocks of a bounded number of vectors, and queries into blocks too. A task
has one of each, holds the substring indexes of its block, and returns the best k of each query.
Where a query has fewer than k codes inside the radius in a block, its radius there grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import keep

#: Bounds of the samples: vectors that the rotation is fitted to, and queries for the radius.
FIT_VECTORS = 20_000
FIT_QUERIES = 128
#: Share of true neighbours that the radius shall hold.
TARGET = 0.97
BITS = 64
SUBSTRINGS = 4
ROUNDS = 30
BLOCK_VECTORS = 8_192
BLOCK_QUERIES = 1_024
K = 10
SEED = 7


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, v): rows that take part, the vector as doubles.

    Null ids and vectors, vectors with null or non-finite components, zero vectors, and vectors of
    another length than most do not.
    Rows that repeat an id are one row; if their vectors differ, the least in array order.
    """
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0.0)
    )
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, which have one length, as rows."""
    if not len(column):
        return np.empty((0, 0))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_rotation(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions by bits), by iterative quantisation.

    More bits than dimensions come from several rotations side by side.
    """
    rng = np.random.default_rng(SEED)
    mean = sample.mean(0)
    centred = sample - mean
    d = centred.shape[1]
    _, axes = np.linalg.eigh(centred.T @ centred)
    parts = []
    left = bits
    while left > 0:
        n = min(left, d)
        base = axes[:, ::-1][:, :n]
        flat = centred @ base
        turn = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ w).T
        parts.append(base @ turn)
        left -= n
    return mean, np.concatenate(parts, 1)


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, substrings: int) -> np.ndarray:
    """Signs packed into one integer for each substring."""
    signs = (x - mean) @ projection > 0
    width = signs.shape[1] // substrings
    weights = 1 << np.arange(width, dtype=np.int64)
    return np.stack([signs[:, i * width : (i + 1) * width] @ weights for i in range(substrings)], 1)


class SubstringIndexes:
    """The indexes of one block: for each substring, its rows ordered by value."""

    def __init__(self, codes: np.ndarray, width: int):
        self.codes, self.width = codes, width
        self.orders = [np.argsort(codes[:, i], kind="stable") for i in range(codes.shape[1])]
        self.values, self.starts = [], []
        for i, order in enumerate(self.orders):
            values, starts = np.unique(codes[order, i], return_index=True)
            self.values.append(values)
            self.starts.append(np.append(starts, len(order)))

    def buckets(self, i: int, value: int, radius: int) -> np.ndarray:
        """Buckets of substring ``i`` within ``radius`` bits of ``value``.

        Values near by are enumerated and looked up while they are fewer than the buckets;
        else the directory of buckets is compared.
        """
        values = self.values[i]
        masks = _masks(self.width, radius, len(values))
        if masks is None:
            return np.flatnonzero(np.bitwise_count(values ^ value) <= radius)
        probes = masks ^ value
        at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
        return at[values[at] == probes]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` bits of ``code``."""
        near = np.zeros(len(self.codes), bool)
        for i, order in enumerate(self.orders):
            starts = self.starts[i]
            for b in self.buckets(i, int(code[i]), radius // len(self.orders)).tolist():
                near[order[starts[b] : starts[b + 1]]] = True
        rows = np.flatnonzero(near)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


_known_masks: dict[tuple[int, int], np.ndarray] = {}


def _masks(width: int, radius: int, limit: int) -> np.ndarray | None:
    """All masks of at most ``radius`` of ``width`` bits; None if there are over ``limit``."""
    count, term = 0, 1
    for k in range(min(radius, width) + 1):
        count += term
        term = term * (width - k) // (k + 1)
    if count > limit:
        return None
    if (width, radius) not in _known_masks:
        found = [sum(1 << b for b in bits) for k in range(min(radius, width) + 1) for bits in combinations(range(width), k)]
        _known_masks[width, radius] = np.array(found, np.int64)
    return _known_masks[width, radius]


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def _best(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, ties to smaller ids."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(distances <= np.partition(distances, k - 1)[k - 1])
        return near[np.lexsort((ids[near], distances[near]))][:k]
    return np.lexsort((ids, distances))[:k]


def _sampled(rows: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``bound`` rows of least hash."""
    got = rows.withColumn("_h", F.xxhash64("vec_id")).orderBy("_h", "vec_id").limit(bound).select("vec_id", "v").toArrow()
    return np.array(got["vec_id"].to_pylist(), np.int64), _matrix(got["v"])


def _learn_radius(rows: DataFrame, queries: DataFrame, mean: np.ndarray, projection: np.ndarray, k: int) -> int:
    """Least radius that holds the target share of the sampled queries' true neighbours."""
    ids, x = _sampled(queries, FIT_QUERIES)
    if not len(ids):
        return 0
    codes = codes_of(x, mean, projection, SUBSTRINGS)
    shared = rows.sparkSession.sparkContext.broadcast((ids, x, codes))  # bounded by FIT_QUERIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, codes = shared.value
        for batch in batches:
            others, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            own = codes_of(v, mean, projection, SUBSTRINGS)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i in range(len(ids)):
                rest = np.flatnonzero(others != ids[i])
                d = _distances(v[rest], x[i])
                best = _best(d, others[rest], k)
                out[0].extend([int(ids[i])] * len(best))
                out[1].extend(others[rest[best]].tolist())
                out[2].extend(d[best].tolist())
                out[3].extend(np.bitwise_count(own[rest[best]] ^ codes[i]).sum(1).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32())],
                names=["q", "vec_id", "d", "bits"],
            )

    found = rows.mapInArrow(run, "q bigint, vec_id bigint, d double, bits int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    bits = [r["bits"] for r in found.withColumn("r", rank).where(F.col("r") <= k).select("bits").collect()]
    return int(np.quantile(bits, TARGET, method="higher")) if bits else 0


def nearest(
    vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = K
) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``. Candidates are all usable rows but the query's own
    id; the score is the Euclidean distance of the original vectors. Equal distances rank the
    smaller id first. With fewer candidates than k, all are returned; empty tables and tables
    without a query or a candidate give no rows. Other columns are not read, whatever their names.
    """
    rows = keep(usable(vectors, id_column, vector))
    count = rows.count()
    queries = rows.where(is_query)
    _, sample = _sampled(rows, FIT_VECTORS)
    if not count:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    mean, projection = fit_rotation(sample, BITS)
    radius = _learn_radius(rows, queries, mean, projection, k)
    width = BITS // SUBSTRINGS
    row_blocks = -(-count // BLOCK_VECTORS)
    query_blocks = -(-queries.count() // BLOCK_QUERIES) or 1

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    # Every block of rows meets every block of queries, in a task of its own.
    left = rows.select(block(row_blocks).alias("b"), numbers(query_blocks).alias("c"), F.lit(False).alias("asked"), "vec_id", "v")
    right = queries.select(numbers(row_blocks).alias("b"), block(query_blocks).alias("c"), F.lit(True).alias("asked"), "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(ids: np.ndarray, x: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
            own, v, wanted, q = ids[~asked], x[~asked], ids[asked], x[asked]
            if not len(own) or not len(wanted):
                return
            indexes = SubstringIndexes(codes_of(v, mean, projection, SUBSTRINGS), width)
            found: tuple[list, list, list] = ([], [], [])
            for i, code in enumerate(codes_of(q, mean, projection, SUBSTRINGS)):
                reach = radius
                while True:
                    near = indexes.within(code, reach)
                    near = near[own[near] != wanted[i]]
                    if len(near) >= k or reach >= BITS:
                        break
                    reach = min(BITS, reach + SUBSTRINGS)
                d = _distances(v[near], q[i])
                best = _best(d, own[near], k)
                found[0].extend([int(wanted[i])] * len(best))
                found[1].extend(own[near[best]].tolist())
                found[2].extend(d[best].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())],
                names=["query_id", "vec_id", "score"],
            )

        key, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            ids, x = batch.column(3).to_numpy(), _matrix(batch.column(4))
            asked = np.array(batch.column(2).to_pylist(), bool)
            for a, b in zip(cuts, cuts[1:]):
                if (at := tuple(keys[a].tolist())) != key:
                    if parts:
                        yield from settled(*map(np.concatenate, zip(*parts)))
                    key, parts = at, []
                parts.append((ids[a:b], x[a:b], asked[a:b]))
        if parts:
            yield from settled(*map(np.concatenate, zip(*parts)))

    both = left.unionAll(right).repartition("b", "c").sortWithinPartitions("b", "c")
    hits = both.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
