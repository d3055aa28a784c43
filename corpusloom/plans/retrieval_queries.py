"""Vectors, scoped search, context packing and citations over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.constants import SYNTHESIS_PATTERNS
from corpusloom.functions import text as tx
from corpusloom.operators import retrieval as rt
from corpusloom.operators import vectors as vx
from corpusloom.plans.registry import Tables, query


def _requests(t: Tables):
    """Every vector asks for its neighbours in its own file and one more."""
    label = F.col("label")
    return t("embeddings").select(
        F.col("vec_id").alias("request_id"),
        F.lit(1).alias("user_idx"),
        F.array(label, (label + 3) % 10).alias("file_idxs"),
        F.col("embedding").alias("query_vector"),
        F.lit(5).alias("top_k"),
        F.when(label < 5, 0.1).alias("score_threshold"),
    )


_PAIRS = """WITH s AS (SELECT r.vec_id AS request_id, p.chunk_id, p.file_idx,
    round(list_cosine_similarity(r.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score
  FROM {embeddings} r JOIN {points} p ON p.file_idx IN (r.label, (r.label + 3) % 10) AND p.users_idx = 1 AND p.is_active
  WHERE r.label >= 5 OR round(list_cosine_similarity(r.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) >= 0.1),
 k AS (SELECT *, row_number() OVER (PARTITION BY request_id BY_FILE ORDER BY score DESC, chunk_id) AS rank FROM s)
"""


@query(
    "cosine_topk",
    "V8 S1",
    _PAIRS.replace("BY_FILE", "")
    + "SELECT request_id, chunk_id, file_idx, round(score, 6) AS score, rank FROM k WHERE rank <= 5",
)
def _(t):
    hits = vx.cosine_topk(_requests(t), t("points"))
    return hits.withColumn("score", F.round("score", 6))


def _with_defects(vector):
    """Some vectors are not finite, and some are zero."""
    return (
        F.when(F.col("vec_id") % 11 == 0, F.transform(vector, lambda x: F.lit(float("nan")).cast("float")))
        .when(F.col("vec_id") % 7 == 0, F.transform(vector, lambda x: F.lit(0).cast("float")))
        .otherwise(F.col(vector))
    )


@query(
    "search_request_rejects",
    "V8 D4",
    """SELECT vec_id AS request_id, 'top_k_out_of_range' AS rule, CAST(vec_id % 30 AS BIGINT) AS detail FROM {embeddings} WHERE vec_id % 30 NOT BETWEEN 1 AND 20
      UNION ALL SELECT vec_id, 'query_not_finite', len(embedding) FROM {embeddings} WHERE vec_id % 11 = 0
      UNION ALL SELECT vec_id, 'query_is_zero', len(embedding) FROM {embeddings} WHERE vec_id % 7 = 0 AND vec_id % 11 <> 0""",
)
def _(t):
    return vx.search_request_rejects(
        t("embeddings").select(
            F.col("vec_id").alias("request_id"), (F.col("vec_id") % 30).alias("top_k"), _with_defects("embedding").alias("query_vector")
        )
    )


@query(
    "point_rejects",
    "V2 V8",
    """SELECT vec_id AS chunk_id, 'vector_not_finite' AS rule, len(embedding) AS detail FROM {embeddings} WHERE vec_id % 11 = 0 AND vec_id % 3 <> 0
      UNION ALL SELECT vec_id, 'vector_is_zero', len(embedding) FROM {embeddings} WHERE vec_id % 7 = 0 AND vec_id % 11 <> 0 AND vec_id % 3 <> 0""",
)
def _(t):
    return vx.point_rejects(
        t("embeddings").select(
            F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 3 != 0).alias("is_active"), _with_defects("embedding").alias("embedding")
        )
    )


@query(
    "blank_content_rejects",
    "Q5 Q6",
    "SELECT request_id, chunk_id, 'blank_content' AS rule, CAST(rank AS BIGINT) AS detail FROM {hits} WHERE rank % 4 = 0",
)
def _(t):
    hits = t("hits").withColumn("content", F.when(F.col("rank") % 4 == 0, F.lit(" \t ")).otherwise(F.col("content")))
    return rt.blank_content_rejects(hits)


@query(
    "per_document_topk",
    "V11",
    _PAIRS.replace("BY_FILE", ", file_idx")
    + "SELECT request_id, chunk_id, file_idx, round(score, 6) AS score, rank FROM k WHERE rank <= 3",
)
def _(t):
    hits = vx.per_document_topk(_requests(t), t("points"))
    return hits.withColumn("score", F.round("score", 6))


@query(
    "best_hit_per_file",
    "V10",
    """WITH b AS (SELECT request_id, file_idx, min(rank) AS first_rank, arg_min(content, struct_pack(s := -score, r := rank)) AS content, max(score) AS score
        FROM {hits} WHERE file_idx <> 3 GROUP BY ALL)
      SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY first_rank) AS position, file_idx, 'file ' || file_idx AS file_name,
        CASE WHEN length(content) <= 300 THEN content ELSE left(content, 300) || '…' END AS matched_chunk, round(score, 6) AS score FROM b""",
)
def _(t):
    files = t("hits").where("file_idx <> 3").select("file_idx", F.concat(F.lit("file "), "file_idx").alias("name")).distinct()
    return vx.best_hit_per_file(t("hits"), files).withColumn("score", F.round("score", 6))


@query(
    "validate_hits",
    "V9",
    """WITH h AS (SELECT request_id, rank, file_idx, score, CASE WHEN rank = 4 THEN request_id * 1000 ELSE chunk_id END AS chunk_id FROM {hits}),
      l AS (SELECT *, lag(score) OVER (PARTITION BY request_id ORDER BY rank) AS prev FROM h),
      a AS (SELECT request_id, count(*) AS n, count(*) FILTER (WHERE file_idx = 3) AS outside, count(*) FILTER (WHERE score < 0.15) AS low,
        count(*) FILTER (WHERE score > prev) AS unsorted, count(*) FILTER (WHERE rank IN (1, 4)) > 1 AS dup FROM l GROUP BY request_id)
      SELECT request_id, 'too_many_hits' AS rule, n AS detail FROM a WHERE n > 6 UNION ALL SELECT request_id, 'outside_scope', outside FROM a WHERE outside > 0
      UNION ALL SELECT request_id, 'below_threshold', low FROM a WHERE low > 0 UNION ALL SELECT request_id, 'score_order', unsorted FROM a WHERE unsorted > 0
      UNION ALL SELECT request_id, 'duplicate_chunk', 1 FROM a WHERE dup""",
)
def _(t):
    hits = t("hits").withColumn("chunk_id", F.when(F.col("rank") == 4, F.col("request_id") * 1000).otherwise(F.col("chunk_id")))
    requests = t("hits").select("request_id").distinct().select(
        "request_id", F.lit(1).alias("user_idx"), F.lit(6).alias("top_k"),
        F.lit(0.15).alias("score_threshold"), F.array(F.lit(1), F.lit(2)).alias("file_idxs"),
    )
    return vx.validate_hits(hits, requests)


@query(
    "attach_embeddings",
    "V1",
    """SELECT vec_id AS key, label, NULL AS rule FROM {embeddings} WHERE label <> 4 AND vec_id IN (SELECT doc_id FROM {documents})
       UNION ALL SELECT doc_id, NULL, 'missing_vector' FROM {documents} WHERE doc_id NOT IN (SELECT vec_id FROM {embeddings})
       UNION ALL SELECT vec_id, NULL, 'orphan_vector' FROM {embeddings} WHERE vec_id NOT IN (SELECT doc_id FROM {documents})
       UNION ALL SELECT vec_id, NULL, 'duplicate_vector' FROM {embeddings} WHERE label = 4""",
)
def _(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("key"), "label")
    vectors = vectors.unionByName(vectors.where("label = 4"))
    chunks = t("documents").select(F.col("doc_id").alias("key"))
    paired, rejects = vx.attach_embeddings(chunks, vectors, "key")
    return paired.select("key", "label", F.lit(None).cast("string").alias("rule")).unionByName(
        rejects.select("key", F.lit(None).cast("int").alias("label"), "rule")
    )


@query(
    "validate_vectors",
    "V2",
    """SELECT vec_id, 'wrong_dimension' AS rule, CAST(63 AS BIGINT) AS detail FROM {embeddings} WHERE label = 1
       UNION ALL SELECT vec_id, 'not_finite', 64 FROM {embeddings} WHERE label = 2
       UNION ALL SELECT vec_id, 'model_mismatch', 64 FROM {embeddings} WHERE label = 3""",
)
def _(t):
    e, label = F.col("embedding"), F.col("label")
    broken = (
        F.when(label == 1, F.slice(e, 1, 63))
        .when(label == 2, F.transform(e, lambda x, i: F.when(i == 7, F.lit(float("nan"))).otherwise(x).cast("float")))
        .otherwise(e)
    )
    df = t("embeddings").withColumn("embedding", broken)
    model = F.when(label == 3, "other").otherwise("m64")
    return vx.validate_vectors(df, "vec_id", "embedding", 64, model, "m64")


@query(
    "query_text_for_embedding",
    "V3",
    f"SELECT item_id, 'Instruct: {vx.QUERY_TASK.replace(chr(39), chr(39) * 2)}' || chr(10) || 'Query: ' || trim(text, ' ' || chr(10)) AS input FROM {{benchmark}}",
)
def _(t):
    return t("benchmark").select("item_id", vx.query_text_for_embedding(F.col("text")).alias("input"))


@query(
    "embedding_batch_count",
    "V4",
    "SELECT o_custkey AS doc, count(*) AS chunk_count, CAST(ceil(count(*) / 4.0) AS BIGINT) AS batch_count FROM {orders} GROUP BY 1",
)
def _(t):
    return vx.embedding_batch_count(t("orders").withColumnRenamed("o_custkey", "doc"), "doc", batch=4)


@query(
    "build_payload",
    "V5",
    """WITH v AS (SELECT *, CAST(meta_json AS JSON) AS j FROM {unit_meta})
      SELECT l_orderkey AS rag_document_idx, l_linenumber AS chunk_index, l_extendedprice AS created_at, file_type,
      CASE WHEN json_type(j, '$.page_number') IN ('UBIGINT', 'BIGINT') AND CAST(j->>'page_number' AS BIGINT) >= 1 THEN CAST(j->>'page_number' AS BIGINT) END AS page,
      CASE WHEN CAST(j->>'slide_number' AS BIGINT) >= 1 THEN CAST(j->>'slide_number' AS BIGINT) END AS slide_no,
      trim(j->>'sheet_name') AS sheet_name, j->>'shape_path' AS shape_path, j->>'location_kind' AS location_kind FROM v""",
)
def _(t):
    df = t("unit_meta").select(
        F.col("l_orderkey").alias("rag_document_idx"),
        F.col("l_linenumber").alias("chunk_index"),
        F.col("l_extendedprice").alias("created_at"),
        "file_type",
        F.parse_json("meta_json").alias("meta"),
    )
    shown = "rag_document_idx chunk_index created_at file_type page slide_no sheet_name shape_path location_kind"
    return vx.build_payload(df).select(*shown.split())


@query(
    "extract_source_metadata",
    "V6 V7",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, '{' || array_to_string(list_filter([
        'X"page_number":"' || CASE WHEN l_linenumber > 3 THEN 'own' ELSE CAST(page_number AS VARCHAR) END || '"',
        CASE WHEN shape_path IS NOT NULL THEN 'X"shape_path":"' || shape_path || '"' END,
        CASE WHEN l_linenumber > 3 THEN 'X"unit_type":"nested"' WHEN unit_type IS NOT NULL THEN 'X"unit_type":"' || unit_type || '"' END],
        lambda x: x IS NOT NULL), ',') || '}' AS metadata FROM {unit_meta}""".replace("'X\"", "'\""),
)
def _(t):
    late = F.col("l_linenumber") > 3
    nested = F.when(
        late, F.create_map(F.lit("unit_type"), F.lit("nested"), F.lit("page_number"), F.lit("own"))
    )
    legacy = F.create_map(
        F.lit("unit_type"), F.col("unit_type"),
        F.lit("shape_path"), F.col("shape_path"),
        F.lit("page"), F.col("page_number").cast("string"),
    )
    merged = vx.extract_source_metadata(nested, legacy)
    return t("unit_meta").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", vx.metadata_json(merged).alias("metadata")
    )


@query(
    "scope_recent_files",
    "V12",
    """SELECT users_idx, file_idx, position FROM (SELECT users_idx, file_idx, row_number() OVER (PARTITION BY users_idx ORDER BY created_at DESC, file_idx) AS position
      FROM {files} WHERE status = 'READY' AND deleted_at IS NULL) WHERE position <= 20""",
)
def _(t):
    return vx.scope_recent_files(t("files")).select("users_idx", "file_idx", "position")


_EVAL = """WITH f AS (SELECT users_idx, file_idx FROM {chunks} GROUP BY ALL), u AS (SELECT users_idx, count(*) AS n FROM f GROUP BY 1),
  c AS (SELECT users_idx FROM u WHERE n >= least((SELECT max(n) FROM u), 8) ORDER BY md5('7:' || users_idx), users_idx LIMIT 1)"""


@query(
    "select_eval_scope",
    "V13",
    _EVAL
    + " SELECT users_idx, file_idx FROM f WHERE users_idx IN (SELECT users_idx FROM c) ORDER BY md5('7:' || users_idx || ':' || file_idx), file_idx LIMIT 8",
)
def _(t):
    return vx.select_eval_scope(t("chunks"), 7, 8).select("users_idx", "file_idx")


_POOL = ", ".join(f"('{q}')" for q in vx.DEFAULT_QUERIES)


@query(
    "eval_queries",
    "V13 N17",
    _EVAL
    + r""", s AS (SELECT users_idx, file_idx FROM f WHERE users_idx IN (SELECT users_idx FROM c) ORDER BY md5('7:' || users_idx || ':' || file_idx), file_idx LIMIT 8),
      t AS (SELECT file_idx, content FROM (SELECT *, row_number() OVER (PARTITION BY users_idx, file_idx ORDER BY md5('7:' || users_idx || ':' || file_idx || ':' || chunk_id), chunk_id) AS n
        FROM {chunks} JOIN s USING (users_idx, file_idx)) WHERE n = 1),
      l AS (SELECT file_idx, regexp_replace(regexp_replace(regexp_replace(content, '[\x00-\x1f\x7f]+', ' ', 'g'), '[@WS@]+', ' ', 'g'), '^[@WS@]+|[@WS@]+$', '', 'g') AS line FROM t),
      a AS (SELECT file_idx, line, CASE WHEN regexp_matches(line, '^.*?[.!?。！？] ') THEN rtrim(regexp_extract(line, '^.*?[.!?。！？] ')) ELSE line END AS first FROM l),
      o AS (SELECT file_idx, regexp_replace(left(CASE WHEN length(first) >= 8 THEN first ELSE line END, 180), '[@WS@]+$', '') AS query FROM a),
      k AS (SELECT query, 0 AS t, min(file_idx) AS o, '' AS h FROM o WHERE query <> '' GROUP BY query
        UNION ALL SELECT query, 1, 0, md5('7:' || query) FROM (VALUES """
    + _POOL
    + f""") v(query)
        UNION ALL SELECT '{vx.FILLER_QUERY}' || (i + 1), 2, i, '' FROM (SELECT unnest(range(20)) AS i)),
      m AS (SELECT query, min((t, o, h)) AS k FROM k GROUP BY query)
      SELECT row_number() OVER (ORDER BY k) AS position, query FROM m ORDER BY k LIMIT 20""",
)
def _(t):
    return vx.fill_queries(vx.select_eval_scope(t("chunks"), 7, 8), 7, 20)


@query(
    "sample_chunks",
    "S9",
    """SELECT chunk_id, left(replace(content, chr(10), ' '), 512) AS content FROM (SELECT doc_id AS chunk_id, text AS content FROM {documents})
       ORDER BY md5('11:' || chunk_id), chunk_id LIMIT 64""",
)
def _(t):
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return vx.sample_chunks(chunks, 11, 64)


# Wordings put before the texts, so that some of them ask for a synthesis.
_ASK = {"en": "Compare both files: ", "fr": "모든 문서를 요약해 ", "de": "Summarize EACH of the documents "}
_ASK_SQL = "CASE lang WHEN 'en' THEN 'Compare both files: ' WHEN 'fr' THEN '모든 문서를 요약해 ' WHEN 'de' THEN 'Summarize EACH of the documents ' ELSE '' END"


@query(
    "classify_query",
    "Q1 N5",
    "WITH q AS (SELECT doc_id, n_chars, regexp_replace(lower("
    + _ASK_SQL
    + " || text), '[@WS@]+', ' ', 'g') AS q FROM {documents}) SELECT doc_id, CASE WHEN n_chars > 500 AND ("
    + " OR ".join(f"regexp_matches(q, '{p}')" for p in SYNTHESIS_PATTERNS)
    + ") THEN 'synthesis' ELSE 'lookup' END AS query_type FROM q",
)
def _(t):
    lang = F.col("lang")
    ask = F.lit("")
    for name, words in _ASK.items():
        ask = F.when(lang == name, words).otherwise(ask)
    n_files = F.when(F.col("n_chars") > 500, 2).otherwise(1)
    kind = rt.classify_query(F.concat(ask, "text"), n_files)
    return t("documents").select("doc_id", kind.alias("query_type"))


_GROUPS = """WITH f AS (SELECT *, min(rank) OVER (PARTITION BY request_id, file_idx) AS first_rank,
    row_number() OVER (PARTITION BY request_id, file_idx ORDER BY rank) - 1 AS position FROM {hits}),
  g AS (SELECT *, dense_rank() OVER (PARTITION BY request_id ORDER BY first_rank) - 1 AS group_rank FROM f)"""


@query("group_by_document", "Q2", _GROUPS + " SELECT request_id, chunk_id, file_idx, group_rank, position FROM g")
def _(t):
    return rt.group_by_document(t("hits")).select("request_id", "chunk_id", "file_idx", "group_rank", "position")


@query(
    "conflicting_documents",
    "Q2",
    """SELECT request_id, file_idx, 'conflicting_document' AS rule, count(DISTINCT score > 0.4) AS detail FROM {hits} GROUP BY ALL HAVING count(DISTINCT score > 0.4) > 1""",
)
def _(t):
    hits = t("hits").withColumn("file_name", F.col("score") > 0.4)
    return rt.conflicting_documents(hits, ["file_name"])


def _types(t: Tables):
    kinds = F.when(F.col("request_id") % 2 == 0, "synthesis").otherwise("lookup")
    return t("hits").select("request_id").distinct().withColumn("query_type", kinds)


@query(
    "route",
    "Q3",
    _GROUPS
    + """ SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY
      CASE WHEN request_id % 2 = 0 THEN group_rank ELSE rank END, CASE WHEN request_id % 2 = 0 THEN position ELSE 0 END) AS route_order FROM g""",
)
def _(t):
    return rt.route(t("hits"), _types(t)).select("request_id", "chunk_id", "route_order")


@query(
    "validate_routing",
    "Q4",
    """SELECT request_id, 'hits_changed' AS rule, count(*) AS detail FROM {hits} WHERE file_idx = 3 GROUP BY 1
       UNION ALL SELECT request_id, 'lookup_order_changed', count(*) FROM {hits} WHERE request_id % 2 = 1 AND file_idx <> 3 AND rank IN (2, 3) GROUP BY 1""",
)
def _(t):
    routed = rt.route(t("hits"), _types(t)).where("file_idx <> 3")
    order = F.when(F.col("route_order") == 2, 3).when(F.col("route_order") == 3, 2).otherwise(F.col("route_order"))
    return rt.validate_routing(t("hits"), routed.withColumn("route_order", order))


_TRIM = "trim({}, ' ' || chr(10) || chr(9))"


def _cut(c: str, n: str) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} WHEN {n} <= 1 THEN '…' ELSE rtrim(left({c}, CAST({n} - 1 AS BIGINT)), ' ' || chr(10) || chr(9)) || '…' END"


_PACK = f"""WITH h AS (SELECT *, {_TRIM.format("content")} AS s FROM {{hits}}),
  n AS (SELECT *, row_number() OVER w AS n, least(600, 1500 - coalesce(sum(least(length(s), 600)) OVER (PARTITION BY request_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lim
    FROM h WINDOW w AS (PARTITION BY request_id ORDER BY rank)),
  p AS (SELECT request_id, chunk_id, file_idx, 'SOURCE-' || n AS source_id, n, {_cut("s", "lim")} AS prompt_content, {_cut("s", "500")} AS excerpt
    FROM n WHERE lim > 0 AND NOT (n > 1 AND length(s) > lim AND lim <= 1))"""


@query("pack_context_lookup", "Q5", _PACK + " SELECT request_id, chunk_id, source_id, prompt_content, excerpt FROM p")
def _(t):
    packed = rt.pack_context_lookup(t("hits"), total=1500, per_chunk=600)
    return packed.select("request_id", "chunk_id", "source_id", "prompt_content", "excerpt")


@query(
    "pack_context_round_robin",
    "Q6",
    _GROUPS.replace("WITH f", "WITH RECURSIVE f")
    + f""", o AS (SELECT request_id, chunk_id, position, group_rank, {_TRIM.format("content")} AS s, row_number() OVER (PARTITION BY request_id ORDER BY position, group_rank) AS n FROM g WHERE position < 3),
      r AS (SELECT DISTINCT request_id, CAST(0 AS BIGINT) AS n, CAST(1500 AS BIGINT) AS remain, CAST(NULL AS BIGINT) AS chunk_id, '' AS content, FALSE AS kept FROM o
        UNION ALL SELECT request_id, n, CASE WHEN remain <= 0 THEN remain WHEN cut = '…' AND s <> '…' THEN 0 ELSE remain - length(cut) END, chunk_id, cut, remain > 0 AND NOT (cut = '…' AND s <> '…')
        FROM (SELECT q.*, {_cut("s", "lim")} AS cut FROM (SELECT r.request_id, o.n, r.remain, o.chunk_id, o.s, least(600, r.remain) AS lim FROM r JOIN o ON r.request_id = o.request_id AND o.n = r.n + 1) q))
      SELECT request_id, chunk_id, content FROM r WHERE kept""",
)
def _(t):
    packed = rt.pack_context_round_robin(t("hits"), total=1500, per_chunk=600)
    return packed.select("request_id", "chunk_id", "content")


_ESC = "replace(replace(replace(CAST({} AS VARCHAR), '&', chr(92) || 'u0026'), '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e')"


@query(
    "build_prompt_rows",
    "Q7 N16",
    _PACK
    + ", j AS (SELECT request_id, count(*) AS source_count, '[' || string_agg('{\"source_id\":\"' || source_id || '\",\"chunk_id\":' || chunk_id || CASE WHEN file_idx <> 3 THEN ',\"file_idx\":' || file_idx ELSE '' END || ',\"content\":' || CAST(to_json(prompt_content) AS VARCHAR) || '}', ',' ORDER BY n) || ']' AS s FROM p GROUP BY 1)"
    + f""" SELECT request_id, source_count, replace(replace('{rt.DEFAULT_TEMPLATE}', '{{question}}', '{{"query":"<q' || request_id || '>"}}'), '{{sources}}', s) AS user_prompt_raw FROM j""".replace(
        "\"<q'", "\"' || chr(92) || 'u003cq'"
    ).replace("|| '>\"", "|| chr(92) || 'u003e\"").replace("'{sources}', s)", "'{sources}', " + _ESC.format("s") + ")").replace("user_prompt_raw", "user_prompt"),
)
def _(t):
    packed = rt.pack_context_lookup(t("hits"), total=1500, per_chunk=600)
    packed = packed.withColumn("file_idx", F.when(F.col("file_idx") != 3, F.col("file_idx")))
    queries = t("hits").select("request_id").distinct().withColumn("query", F.concat(F.lit("<q"), "request_id", F.lit(">")))
    return rt.build_prompt_rows(packed, queries, ["chunk_id", "file_idx"])


@query(
    "extract_citations",
    "Q9",
    r"""SELECT request_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') AS cited FROM
      (SELECT request_id, regexp_extract_all(answer, '\[(SOURCE-[0-9]+)\]', 1) AS c FROM {answers})""",
)
def _(t):
    return t("answers").select("request_id", F.array_join(rt.extract_citations(F.col("answer")), ",").alias("cited"))


_CITED = r"""WITH a AS (SELECT request_id, turn, declared, regexp_extract_all(answer, '\[(SOURCE-[0-9]+)\]', 1) AS c FROM {answers}),
  d AS (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i) AS u FROM a),
  k AS (SELECT *, CASE WHEN turn = 7 THEN 'duplicate_prompt_source' WHEN len(u) = 0 THEN 'citation_required' WHEN declared <> array_to_string(u, ',') THEN 'declared_citation_mismatch'
    WHEN len(list_filter(u, lambda x: x NOT IN ('SOURCE-1', 'SOURCE-2', 'SOURCE-3', 'SOURCE-4'))) > 0 THEN 'unknown_source' END AS rule FROM d)"""


def _answers(t: Tables):
    return t("answers").withColumn("declared", F.split("declared", ","))


@query(
    "validate_citations",
    "Q10",
    _CITED + " SELECT request_id, rule, len(u) AS detail FROM k WHERE rule IS NOT NULL",
)
def _(t):
    return rt.validate_citations(_answers(t), t("prompt_sources"))[1]


@query(
    "resolve_citations",
    "Q10",
    _CITED
    + """ SELECT s.request_id, s.source_id, list_position(u, s.source_id) - 1 AS citation_index, s.chunk_id, s.file_idx
      FROM k JOIN {prompt_sources} s ON k.request_id = s.request_id AND list_contains(u, s.source_id) WHERE rule IS NULL""",
)
def _(t):
    return rt.validate_citations(_answers(t), t("prompt_sources"))[0]


@query(
    "validate_structured_answer",
    "Q11",
    """SELECT request_id, rule FROM (SELECT request_id, CASE WHEN turn = 7 THEN 'invalid_status' WHEN turn = 5 THEN 'insufficient_without_fixed_text'
       WHEN declared IS NULL THEN 'answered_without_sources' END AS rule FROM {answers}) WHERE rule IS NOT NULL""",
)
def _(t):
    return rt.validate_structured_answer(t("answers").withColumn("cited_source_ids", F.split("declared", ",")))


@query(
    "answer_status",
    "Q12",
    """SELECT h.request_id, hit_count, CASE WHEN a.turn = 5 THEN 'insufficient_evidence' WHEN a.answer IS NULL THEN 'missing_answer' ELSE 'answered' END AS status,
       CASE WHEN a.turn = 5 THEN 'none' ELSE a.answer END AS answer
       FROM (SELECT chunk_id // 1000 * 100 + chunk_id % 1000 AS request_id, count(*) AS hit_count FROM {hits} GROUP BY 1) h LEFT JOIN {answers} a ON h.request_id = a.request_id""",
)
def _(t):
    key = (F.floor(F.col("chunk_id") / 1000) * 100 + F.col("chunk_id") % 1000).cast("long")
    hits = t("hits").withColumn("request_id", key)
    return rt.answer_status(hits.select("request_id").distinct(), hits, t("answers"), insufficient="none")


def _partials(t: Tables):
    return t("answers").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("group_rank"),
        F.col("turn").alias("file_idx"), "answer",
    )


@query(
    "remap_sources",
    "Q13",
    r"""WITH a AS (SELECT conv_id, turn, answer, regexp_extract_all(answer, '\[(SOURCE-[1-9][0-9]*)\]', 1) AS c FROM {answers}),
      d AS (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i) AS u FROM a),
      b AS (SELECT *, CAST(coalesce(sum(len(u)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM d)
      SELECT conv_id AS request_id, turn AS file_idx, array_to_string(list_transform(u, lambda x, i: 'SOURCE-' || (base + i)), ',') AS source_ids,
        CASE WHEN len(u) = 2 THEN replace(replace(replace(answer, '[' || u[1] || ']', '[@1]'), '[' || u[2] || ']', '[SOURCE-' || (base + 2) || ']'), '[@1]', '[SOURCE-' || (base + 1) || ']')
             ELSE replace(answer, '[' || u[1] || ']', '[SOURCE-' || (base + 1) || ']') END AS answer FROM b""",
)
def _(t):
    out = rt.remap_sources(_partials(t))
    return out.select("request_id", "file_idx", F.array_join("source_ids", ",").alias("source_ids"), "answer")


@query(
    "synthesis_rows",
    "Q8",
    r"""WITH a AS (SELECT conv_id, turn, answer, regexp_extract_all(answer, '\[(SOURCE-[1-9][0-9]*)\]', 1) AS c FROM {answers}),
      d AS (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i) AS u FROM a),
      b AS (SELECT *, CAST(coalesce(sum(len(u)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM d)
      SELECT conv_id AS request_id, count(*) AS partial_count, CAST(sum(len(u)) AS BIGINT) AS source_count FROM b GROUP BY 1""",
)
def _(t):
    remapped = rt.remap_sources(_partials(t))
    sources = remapped.select("request_id", "file_idx", F.explode("source_ids").alias("source_id"))
    sources = sources.withColumn("chunk_id", F.concat_ws("-", "request_id", "source_id"))
    requests = remapped.select("request_id").distinct().select(
        "request_id", F.lit("combine").alias("query"), F.array(*[F.lit(i).cast("long") for i in range(8)]).alias("file_idxs")
    )
    prompts = rt.build_synthesis_rows(remapped, sources, requests)[0]
    ids = F.size(F.regexp_extract_all("user_prompt", F.lit('"source_id":"(SOURCE-[0-9]+)"'), 1))
    return prompts.select(
        "request_id", F.col("partial_count").cast("long").alias("partial_count"), ids.cast("long").alias("source_count")
    )


@query(
    "synthesis_rejects",
    "Q8 Q14",
    """SELECT conv_id AS request_id, 'file_outside_scope' AS rule, count(*) AS detail FROM {answers} WHERE turn > 3 GROUP BY 1
       UNION ALL SELECT conv_id, 'duplicate_source_id', 1 FROM {answers} GROUP BY 1 HAVING count(*) > 1""",
)
def _(t):
    partials = _partials(t)
    sources = partials.select("request_id", "file_idx", F.lit("SOURCE-1").alias("source_id"))
    sources = sources.withColumn("chunk_id", F.concat_ws("-", "request_id", "file_idx"))
    requests = partials.select("request_id").distinct().select(
        "request_id", F.lit("combine").alias("query"), F.array(*[F.lit(i).cast("long") for i in range(4)]).alias("file_idxs")
    )
    return rt.build_synthesis_rows(partials, sources, requests)[1]


@query(
    "final_scope_check",
    "Q14",
    "SELECT request_id, 'file_outside_scope' AS rule, count(*) AS detail FROM {hits} WHERE file_idx <> 1 GROUP BY 1",
)
def _(t):
    requests = t("hits").select("request_id", F.array(F.lit(1)).alias("file_idxs")).distinct()
    return rt.final_scope_check(t("hits"), requests)


@query(
    "estimate_tokens",
    "Q15",
    "SELECT conv_id, turn, strlen(text) + strlen(role) + 32 AS tokens FROM {conversations}",
)
def _(t):
    tokens = rt.estimate_tokens(F.col("text"), F.col("role"), F.lit(None).cast("string"))
    return t("conversations").select("conv_id", "turn", tokens.cast("long").alias("tokens"))


@query(
    "budget_audit",
    "Q16",
    """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY call_index) AS rn FROM {calls}),
      r AS (SELECT DISTINCT request_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ti, CAST(0 AS BIGINT) AS tou, CAST(NULL AS BIGINT) AS call_index, CAST(NULL AS BIGINT) AS output_limit, CAST(NULL AS VARCHAR) AS exceeded FROM c
       UNION ALL SELECT request_id, rn, n + ok, ti + ok * input_tokens, tou + ok * output_tokens, call_index, CASE WHEN ok = 1 THEN lim END,
         CASE WHEN refused IS NOT NULL THEN refused WHEN ti + input_tokens > 100000 THEN 'input_tokens' WHEN output_tokens > lim OR tou + output_tokens > 9000 THEN 'output_tokens' END
       FROM (SELECT *, CASE WHEN refused IS NULL THEN 1 ELSE 0 END AS ok FROM (SELECT r.request_id, c.rn, r.n, r.ti, r.tou, c.call_index, c.input_tokens, c.output_tokens,
          least(coalesce(c.requested_output, 6000), 6000, 9000 - r.tou) AS lim,
          CASE WHEN r.n >= 5 THEN 'call_count' WHEN c.estimated_input > 100000 - r.ti THEN 'input_tokens' WHEN 9000 - r.tou <= 0 THEN 'output_tokens' END AS refused
          FROM r JOIN c ON r.request_id = c.request_id AND c.rn = r.rn + 1)))
      SELECT request_id, call_index, output_limit, exceeded FROM r WHERE rn > 0""",
)
def _(t):
    out = rt.budget_audit(t("calls"), per_call=6000, max_calls=5, max_input=100_000, max_output=9_000)
    return out.select("request_id", "call_index", "output_limit", "exceeded")


@query(
    "citation_context",
    "Q17",
    r"""WITH a AS (SELECT request_id, rtrim(regexp_replace(answer, '\[SOURCE-[0-9]+\]', '', 'g'), ' ' || chr(10)) AS s FROM {answers}),
      b AS (SELECT request_id, trim(CASE WHEN regexp_matches(s, '(?s)[.!?。]\s|\n') THEN regexp_extract(s, '(?s)^.*(?:[.!?。]\s|\n)(.*)$', 1) ELSE s END, ' ' || chr(10)) AS s FROM a)
      SELECT request_id, right(s, 400) AS context FROM b""",
)
def _(t):
    return t("answers").select("request_id", tx.citation_context(F.col("answer")).alias("context"))


@query(
    "dedup_citations_by_file",
    "Q18",
    "SELECT request_id AS message_id, file_idx, min(rank) AS citation_order, arg_min(chunk_id, rank) AS chunk_id FROM {hits} GROUP BY ALL",
)
def _(t):
    c = t("hits").select(F.col("request_id").alias("message_id"), "file_idx", F.col("rank").alias("citation_order"), "chunk_id")
    return rt.dedup_citations_by_file(c)
