"""Vectors: attachment, validation, payloads and exact scoped top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.constants import EMBEDDING_BATCH, MAX_TOP_K
from corpusloom.functions.text import query_from_content, strip
from corpusloom.functions.vector import is_finite_vector
from corpusloom.operators.locators import as_float, as_text, first_int, meta_fields

# Bounds of one scoring task: its two matrices and the score matrix between them.
POINTS_PER_BLOCK = 8192
REQUESTS_PER_BLOCK = 2048
# Scores are rounded before ranking, so equal vectors tie whatever the block layout.
SCORE_DIGITS = 9


def attach_embeddings(chunks: DataFrame, vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pair chunks and vectors one to one; everything unpaired is rejected by rule."""
    copies = vectors.groupBy(key).agg(F.count("*").alias("_n"))
    twice = copies.where("_n > 1").select(key, F.lit("duplicate_vector").alias("rule"))
    missing = chunks.join(vectors, key, "left_anti").select(key, F.lit("missing_vector").alias("rule"))
    orphan = vectors.join(chunks, key, "left_anti").select(key, F.lit("orphan_vector").alias("rule"))
    unique = vectors.join(twice, key, "left_anti")
    return chunks.join(unique, key), missing.unionByName(orphan.distinct()).unionByName(twice)


def validate_vectors(vectors: DataFrame, key: str, vector: str, dim: int, model: Column, expected: str) -> DataFrame:
    """Vectors with a wrong size, a non-finite element or another model, one row per rule."""
    from corpusloom.operators.chunks import reject_rows

    v = F.col(vector)
    rules = [
        ("wrong_dimension", F.size(v) != dim, F.size(v)),
        ("not_finite", ~is_finite_vector(v, F.size(v)), F.size(v)),
        ("model_mismatch", ~model.eqNullSafe(F.lit(expected)), F.size(v)),
    ]
    return reject_rows(vectors, [key], rules)


# Fixed value: the retrieval task given to the embedding model.
QUERY_TASK = (
    "Given a user question, retrieve relevant passages from the user's documents "
    "that answer the question"
)


def query_text_for_embedding(query: Column, task: str = QUERY_TASK) -> Column:
    """Instruction prefix, on queries only; stored texts are embedded as they are."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), strip(query))


def embedding_batch_count(chunks: DataFrame, doc: str, batch: int = EMBEDDING_BATCH) -> DataFrame:
    n = F.count("*")
    return chunks.groupBy(doc).agg(
        n.alias("chunk_count"), F.ceil(n / batch).cast("long").alias("batch_count")
    )


# The payload fields read from unit metadata, by reader.
PAYLOAD_INTS = {
    "page": (("page_number",), 1),
    "slide_no": (("slide_number", "slide_no"), 1),
    "sheet_number": (("sheet_number", "sheet_index"), 1),
    "line_number": (("line_number",), 1),
    "source_char_start": (("source_char_start",), 0),
    "source_char_end": (("source_char_end",), 0),
    "shape_left_emu": (("shape_left_emu",), 0),
    "shape_top_emu": (("shape_top_emu",), 0),
    "shape_width_emu": (("shape_width_emu",), 0),
    "shape_height_emu": (("shape_height_emu",), 0),
}
PAYLOAD_FLOATS = ("shape_left_ratio", "shape_top_ratio")
PAYLOAD_TEXTS = (
    "sheet_name", "cell_range", "shape_path", "unit_type", "location_kind", "structure_path",
    "section_title", "chunking_strategy", "chunking_strategy_version",
)
PAYLOAD_COLUMNS = (
    "chunk_id", "rag_document_idx", "file_idx", "users_idx", "folder_idx", "chunk_index", "content",
    "token_count", "file_name", "file_type", "file_hash", "parser_type", "parser_version",
    "start_offset", "end_offset", "content_hash", "embedding_model", "embedding_dim",
    "index_version", "is_active", "created_at",
)


def build_payload(chunks: DataFrame, meta: str = "meta") -> DataFrame:
    """Index payload: the chunk's own columns plus typed reads of its metadata.

    Chunk columns that the input lacks come out null, so every index has one schema.
    """
    int_keys = [k for keys, _ in PAYLOAD_INTS.values() for k in keys]
    df = chunks.withColumn("_m", meta_fields(F.col(meta), [*int_keys, *PAYLOAD_FLOATS, *PAYLOAD_TEXTS]))
    m = F.col("_m")
    own = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in PAYLOAD_COLUMNS]
    return df.select(
        *own,
        *[first_int(m, keys, low).alias(n) for n, (keys, low) in PAYLOAD_INTS.items()],
        *[as_float(m[n]).alias(n) for n in PAYLOAD_FLOATS],
        *[as_text(m[n]).alias(n) for n in PAYLOAD_TEXTS],
        F.col(meta).alias("source_metadata"),
    )


def extract_source_metadata(nested: Column, legacy: Column) -> Column:
    """Merge two open maps: nested values win, legacy ones fill gaps, ``page`` is renamed.

    Both are ``map<string,string>`` of JSON fragments; null legacy values are no values.
    """
    empty = F.create_map().cast("map<string,string>")
    filled = F.map_filter(F.coalesce(legacy, empty), lambda _, v: v.isNotNull())
    renamed = F.transform_keys(filled, lambda k, _: F.when(k == "page", F.lit("page_number")).otherwise(k))
    own = F.coalesce(nested, empty)
    gaps = F.map_filter(renamed, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(own, gaps)


def metadata_json(m: Column) -> Column:
    """Compact JSON with sorted keys, from a map."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def _best(requests: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """Best hits of each request in one block of points: at most top_k per request."""
    out = {"request_id": [], "chunk_id": [], "file_idx": [], "score": []}
    if len(requests) and len(points):
        p = np.stack(points["embedding"].to_numpy()).astype(np.float64)
        q = np.stack(requests["query_vector"].to_numpy()).astype(np.float64)
        p /= np.linalg.norm(p, axis=1, keepdims=True)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        scores = np.round(q @ p.T, SCORE_DIGITS)
        ids = points["chunk_id"].to_numpy()
        file_idx = points["file_idx"].iloc[0]
        lowest = requests["score_threshold"].fillna(-np.inf).to_numpy(dtype=np.float64)
        wanted = requests["top_k"].to_numpy()
        for row, request in enumerate(requests["request_id"].to_numpy()):
            k, s = int(wanted[row]), scores[row]
            floor = lowest[row]
            if k < len(s):
                # Everything tied with the k-th score stays a candidate.
                floor = max(floor, np.partition(s, len(s) - k)[len(s) - k])
            near = np.flatnonzero(s >= floor)
            near = near[np.lexsort((ids[near], -s[near]))[:k]]
            out["request_id"] += [request] * len(near)
            out["chunk_id"] += ids[near].tolist()
            out["file_idx"] += [file_idx] * len(near)
            out["score"] += s[near].tolist()
    return pd.DataFrame(out)


def _scoped_hits(requests: DataFrame, points: DataFrame) -> DataFrame:
    """Per request and block of points, its best hits inside its scope.

    Scope is an equi-join on (owner, file), never a product. A scope with many points or
    many requests is cut into blocks on both sides, so a file that holds a third of all
    points, or that a third of all requests ask for, spreads over many tasks; a task
    holds one block of each and emits at most top_k rows per request, not all pairs.
    """
    scope = ["user_idx", "file_idx"]
    dim = F.size("embedding")
    live = points.where(F.col("is_active") & is_finite_vector(F.col("embedding"), dim)).where(
        F.exists("embedding", lambda x: x != 0)
    )
    live = live.select(F.col("users_idx").alias("user_idx"), "file_idx", "chunk_id", "embedding")
    asked = requests.where(
        is_finite_vector(F.col("query_vector"), F.size("query_vector"))
        & F.exists("query_vector", lambda x: x != 0)
    ).select(
        "request_id", "user_idx", F.explode(F.array_distinct("file_idxs")).alias("file_idx"),
        "query_vector", "top_k", "score_threshold",
    )
    point_blocks = live.groupBy(*scope).agg(F.ceil(F.count("*") / POINTS_PER_BLOCK).cast("int").alias("pn"))
    ask_blocks = asked.groupBy(*scope).agg(F.ceil(F.count("*") / REQUESTS_PER_BLOCK).cast("int").alias("rn"))
    blocks = point_blocks.join(ask_blocks, scope)

    def place(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine, theirs = ("pb", "rb") if own == "pn" else ("rb", "pb")
        placed = df.join(blocks, scope).withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("pn", "rn")

    keys = [*scope, "pb", "rb"]
    left = place(asked, "request_id", "rn", "pn").groupBy(*keys)
    right = place(live, "chunk_id", "pn", "rn").groupBy(*keys)
    types = dict(points.dtypes) | {"request_id": dict(requests.dtypes)["request_id"]}
    schema = (
        f"request_id {types['request_id']}, chunk_id {types['chunk_id']}, "
        f"file_idx {types['file_idx']}, score double"
    )
    return left.cogroup(right).applyInPandas(_best, schema)


def _rank(hits: DataFrame, requests: DataFrame, by: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    # The literal bound lets Spark cut each map task's rows before the shuffle.
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    caps = requests.select("request_id", F.col("top_k").alias("_k"))
    return top.join(caps, "request_id").where(F.col("rank") <= F.col("_k")).drop("_k")


def cosine_topk(requests: DataFrame, points: DataFrame) -> DataFrame:
    """Exact filtered cosine top-k for a table of requests.

    ``requests``: request_id, user_idx, file_idxs, query_vector, top_k (1..20),
    score_threshold (nullable, inclusive). ``points``: chunk_id, users_idx, file_idx,
    is_active, embedding. Ties are ordered by chunk_id. Requests and points that break
    their contract take no part; `search_request_rejects` and `point_rejects` name them.
    """
    requests = requests.where(F.col("top_k").between(1, MAX_TOP_K))
    return _rank(_scoped_hits(requests, points), requests, ["request_id"], MAX_TOP_K)


def search_request_rejects(requests: DataFrame) -> DataFrame:
    """Requests that a search refuses, as (request_id, rule, detail) rows."""
    from corpusloom.operators.chunks import reject_rows

    k, vector = F.col("top_k"), F.col("query_vector")
    finite = is_finite_vector(vector, F.size(vector))
    return reject_rows(
        requests,
        ["request_id"],
        [
            ("top_k_out_of_range", ~F.coalesce(k.between(1, MAX_TOP_K), F.lit(False)), F.coalesce(k, F.lit(0))),
            ("query_not_finite", ~finite, F.coalesce(F.size(vector), F.lit(0))),
            ("query_is_zero", finite & ~F.exists(vector, lambda x: x != 0), F.size(vector)),
        ],
    )


def point_rejects(points: DataFrame) -> DataFrame:
    """Active points that no search can find, as (chunk_id, rule, detail) rows."""
    from corpusloom.operators.chunks import reject_rows

    vector = F.col("embedding")
    finite = is_finite_vector(vector, F.size(vector))
    return reject_rows(
        points.where("is_active"),
        ["chunk_id"],
        [
            ("vector_not_finite", ~finite, F.coalesce(F.size(vector), F.lit(0))),
            ("vector_is_zero", finite & ~F.exists(vector, lambda x: x != 0), F.size(vector)),
        ],
    )


def per_document_topk(requests: DataFrame, points: DataFrame, per_document: int = 3) -> DataFrame:
    """Independent top min(k, 3) for each file of each request."""
    requests = requests.where(F.col("top_k").between(1, MAX_TOP_K))
    narrow = requests.withColumn("top_k", F.least("top_k", F.lit(per_document)))
    return _rank(_scoped_hits(narrow, points), narrow, ["request_id", "file_idx"], per_document)


def validate_hits(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Broken search contracts as (request_id, rule, detail) rows; detail counts hits."""
    r = requests.select("request_id", "user_idx", "top_k", "score_threshold", "file_idxs")
    by_rank = Window.partitionBy("request_id").orderBy("rank")
    df = hits.withColumn("_previous", F.lag("score").over(by_rank)).join(r, "request_id")
    per = df.groupBy("request_id").agg(
        F.count("*").alias("n"),
        F.max("top_k").alias("k"),
        F.count_if(~F.array_contains("file_idxs", F.col("file_idx"))).alias("outside"),
        F.count_if(F.col("users_idx") != F.col("user_idx")).alias("foreign")
        if "users_idx" in hits.columns
        else F.lit(0).alias("foreign"),
        F.count_if(F.col("score") < F.col("score_threshold")).alias("low"),
        F.count_if(F.col("score") > F.col("_previous")).alias("unsorted"),
    )
    copies = hits.groupBy("request_id", "chunk_id").count().where("count > 1")
    copies = copies.groupBy("request_id").agg(F.count("*").alias("copies"))
    from corpusloom.operators.chunks import reject_rows

    per = per.join(copies, "request_id", "left").fillna(0, ["copies"])
    return reject_rows(
        per,
        ["request_id"],
        [
            ("foreign_owner", F.col("foreign") > 0, F.col("foreign")),
            ("too_many_hits", F.col("n") > F.col("k"), F.col("n")),
            ("outside_scope", F.col("outside") > 0, F.col("outside")),
            ("below_threshold", F.col("low") > 0, F.col("low")),
            ("score_order", F.col("unsorted") > 0, F.col("unsorted")),
            ("duplicate_chunk", F.col("copies") > 0, F.col("copies")),
        ],
    )


def best_hit_per_file(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Best hit of each known file, in order of the file's first hit.

    The first of equal scores wins; a missing score counts as 0. Reduced map-side.
    """
    score = F.coalesce("score", F.lit(0.0))
    best = hits.groupBy("request_id", "file_idx").agg(
        F.min_by(F.struct(score.alias("score"), "content"), F.struct((-score).alias("s"), "rank")).alias("b"),
        F.min("rank").alias("first_rank"),
    )
    named = best.join(files.select("file_idx", F.col("name").alias("file_name")), "file_idx")
    from corpusloom.functions.text import snippet

    order = Window.partitionBy("request_id").orderBy("first_rank")
    return named.select(
        "request_id",
        F.row_number().over(order).alias("position"),
        "file_idx",
        "file_name",
        snippet(F.col("b.content")).alias("matched_chunk"),
        F.col("b.score").alias("score"),
    )


def scope_recent_files(files: DataFrame, limit: int = 20, keys: tuple[str, ...] = ("users_idx",)) -> DataFrame:
    """Newest searchable files of each user (or user and folder)."""
    ready = files.where((F.col("status") == "READY") & F.col("deleted_at").isNull())
    order = Window.partitionBy(*keys).orderBy(F.desc("created_at"), "file_idx")
    return ready.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def seeded_order(seed: int, *keys: str) -> Column:
    """A reproducible random order: the digest of seed and key, whatever the partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def select_eval_scope(candidates: DataFrame, seed: int, files_per_user: int) -> DataFrame:
    """One user with enough files, and that many of its files with a content each.

    Users with at least ``files_per_user`` files are eligible; when nobody has that many,
    those with the most are. Choices follow the seeded order. The one chosen user travels
    as a one-row table.
    """
    files = candidates.groupBy("users_idx", "file_idx").agg(
        F.min_by("content", F.struct(seeded_order(seed, "users_idx", "file_idx", "chunk_id").alias("o"), "chunk_id")).alias("content")
    )
    users = files.groupBy("users_idx").agg(F.count("*").alias("n"))
    most = users.agg(F.max("n")).scalar()
    eligible = users.where(F.col("n") >= F.least(most, F.lit(files_per_user)))
    chosen = eligible.orderBy(seeded_order(seed, "users_idx"), "users_idx").limit(1).select("users_idx")
    mine = files.join(F.broadcast(chosen), "users_idx", "left_semi")
    return mine.orderBy(seeded_order(seed, "users_idx", "file_idx"), "file_idx").limit(files_per_user)


def sample_chunks(chunks: DataFrame, seed: int, n: int, prefix: int = 512) -> DataFrame:
    """``n`` chunks in seeded order, with a one-line content prefix."""
    one_line = F.left(F.regexp_replace("content", "[\r\n]", " "), F.lit(prefix))
    return chunks.orderBy(seeded_order(seed, "chunk_id"), "chunk_id").limit(n).withColumn("content", one_line)


# Queries used when the chosen files give too few.
DEFAULT_QUERIES = (
    "선택한 문서의 핵심 내용을 알려줘",
    "문서에서 중요한 조건을 찾아줘",
    "문서에 명시된 수치와 근거를 찾아줘",
    "선택한 문서의 주요 절차를 정리해줘",
)
FILLER_QUERY = "선택한 문서의 근거를 찾아줘 "


def fill_queries(scope: DataFrame, seed: int, query_count: int) -> DataFrame:
    """Distinct queries from the chosen files, then the default pool, then numbered fillers."""
    spark = scope.sparkSession
    own = scope.select(query_from_content(F.col("content")).alias("query"), F.col("file_idx").cast("long").alias("o"))
    own = own.where(F.col("query") != "").groupBy("query").agg(F.min(F.struct(F.lit(0).alias("t"), F.col("o"), F.lit("").alias("h"))).alias("k"))
    pool = spark.createDataFrame([(q,) for q in DEFAULT_QUERIES], "query string")
    pool = pool.select("query", F.struct(F.lit(1).alias("t"), F.lit(0).cast("long").alias("o"), seeded_order(seed, "query").alias("h")).alias("k"))
    number = F.col("id") + 1
    filler = spark.range(query_count).select(
        F.concat(F.lit(FILLER_QUERY), number.cast("string")).alias("query"),
        F.struct(F.lit(2).alias("t"), F.col("id").alias("o"), F.lit("").alias("h")).alias("k"),
    )
    every = own.unionByName(pool).unionByName(filler).groupBy("query").agg(F.min("k").alias("k"))
    first = every.orderBy("k").limit(query_count)
    return first.select(F.row_number().over(Window.orderBy("k")).alias("position"), "query")
