"""Index lifecycle, data quality, readers and sinks over the input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import index as ix
from corpusloom.operators import quality as dq
from corpusloom.plans.registry import Tables, by_order, query
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources import readers, sinks


def scratch(t: Tables, name: str) -> str:
    """A new folder next to the checkpoints."""
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_INCOMING = """SELECT users_idx, file_idx, file_hash, parser_version, embedding_model, CASE WHEN chunk_count = 4 AND file_name LIKE '%7' THEN index_version + 1 ELSE index_version END AS index_version,
    rag_document_idx + 900000000 AS rag_document_idx, concat('new ', file_name) AS file_name, 9 AS chunk_count, rag_document_idx AS seq FROM {index_documents}"""
_KEYS = "file_idx, users_idx, file_hash, parser_version, embedding_model, index_version"


@query(
    "exact_document_match",
    "L1",
    f"""WITH i AS ({_INCOMING}), k AS (SELECT {_KEYS}, min(rag_document_idx) AS rag_document_idx, arg_min(index_status, rag_document_idx) AS st FROM {{index_documents}} WHERE deleted_at IS NULL GROUP BY ALL)
      SELECT i.seq, k.rag_document_idx, CASE WHEN st IS NULL THEN 'new' WHEN st = 'INDEXED' THEN 'reuse' ELSE 'retry' END AS action FROM i LEFT JOIN k USING ({_KEYS})""",
)
def _(t):
    incoming = t.sql(_INCOMING).drop("rag_document_idx")
    return ix.exact_document_match(incoming, t("index_documents")).select("seq", "rag_document_idx", "action")


@query(
    "chunk_identity_mismatches",
    "L2",
    """WITH s AS (SELECT rag_document_idx, chunk_index, min(chunk_id) AS a FROM {index_chunks} GROUP BY 1, 2),
      i AS (SELECT rag_document_idx, chunk_index, CASE WHEN chunk_index = 3 THEN 'other' ELSE a END AS b FROM s WHERE chunk_index <> 5)
      SELECT s.rag_document_idx, count(*) AS mismatch_count FROM s LEFT JOIN i USING (rag_document_idx, chunk_index) WHERE b IS DISTINCT FROM a GROUP BY 1""",
)
def _(t):
    stored = t("index_chunks").groupBy("rag_document_idx", "chunk_index").agg(F.min("chunk_id").alias("chunk_id"))
    late = F.col("chunk_index")
    incoming = stored.where(late != 5).withColumn("chunk_id", F.when(late == 3, "other").otherwise(F.col("chunk_id")))
    return ix.chunk_identity_mismatches(stored, incoming)


@query(
    "upsert_documents",
    "L3",
    f"""WITH i AS ({_INCOMING}), n AS (SELECT {_KEYS}, max(seq) AS seq, arg_max(rag_document_idx, seq) AS nid, arg_max(file_name, seq) AS nname FROM i GROUP BY ALL),
      o AS (SELECT {_KEYS}, min(rag_document_idx) AS oid, arg_min(file_name, rag_document_idx) AS oname, arg_min(index_status, rag_document_idx) AS ostatus, min_by(struct_pack(d := deleted_at), rag_document_idx).d AS odel FROM {{index_documents}} GROUP BY ALL)
      SELECT users_idx, file_idx, file_hash, index_version, coalesce(oid, nid) AS rag_document_idx, coalesce(nname, oname) AS file_name, CASE WHEN seq IS NOT NULL THEN 'INDEXING' ELSE ostatus END AS index_status,
        CASE WHEN seq IS NULL THEN odel END AS deleted_at FROM o FULL JOIN n USING ({_KEYS})""",
)
def _(t):
    out = ix.upsert_documents(t("index_documents"), t.sql(_INCOMING))
    return out.select("users_idx", "file_idx", "file_hash", "index_version", "rag_document_idx", "file_name", "index_status", "deleted_at")


@query(
    "replace_chunks",
    "L4",
    """SELECT rag_document_idx, index_version, chunk_index, chunk_id FROM {index_chunks} WHERE (rag_document_idx, index_version) NOT IN (SELECT rag_document_idx, index_version FROM {index_chunks} WHERE chunk_index = 6)
       UNION ALL SELECT rag_document_idx, index_version, chunk_index, chunk_id || '+' FROM {index_chunks} WHERE chunk_index = 6""",
)
def _(t):
    incoming = t("index_chunks").where("chunk_index = 6").withColumn("chunk_id", F.concat("chunk_id", F.lit("+")))
    return ix.replace_chunks(t("index_chunks"), incoming).select("rag_document_idx", "index_version", "chunk_index", "chunk_id")


_SNAPSHOT = """n AS (SELECT d.users_idx, d.file_idx, arg_max(d.rag_document_idx, run_id) AS rag_document_idx, arg_max(index_version, run_id) AS index_version, max(chunk_count) AS chunk_count
    FROM {index_runs} r JOIN {index_documents} d ON r.rag_document_idx = d.rag_document_idx WHERE status = 'SUCCESS' AND index_status = 'INDEXED' AND deleted_at IS NULL GROUP BY 1, 2),
  s AS (SELECT n.users_idx, n.file_idx, n.chunk_count, c.* FROM n JOIN {index_chunks} c ON n.rag_document_idx = c.rag_document_idx AND n.index_version = c.index_version)"""


def _snapshot(t: Tables):
    return ix.latest_successful_snapshot(t("index_documents"), t("index_runs"), t("index_chunks"))


@query(
    "latest_successful_snapshot",
    "L5",
    f"WITH {_SNAPSHOT} SELECT users_idx, file_idx, rag_document_idx, chunk_index, chunk_id FROM s",
)
def _(t):
    return _snapshot(t).select("users_idx", "file_idx", "rag_document_idx", "chunk_index", "chunk_id")


@query(
    "validate_snapshot",
    "L6",
    f"""WITH {_SNAPSHOT}, a AS (SELECT users_idx, file_idx, count(*) AS n, max(chunk_count) AS cc, min(chunk_index) AS lo, max(chunk_index) AS hi, count(DISTINCT chunk_index) AS di FROM s GROUP BY 1, 2),
      d AS (SELECT users_idx, file_idx, count(*) AS k FROM (SELECT users_idx, file_idx, chunk_id FROM s GROUP BY ALL HAVING count(*) > 1) GROUP BY 1, 2)
      SELECT users_idx, file_idx, 'chunk_count_mismatch' AS rule, n AS detail FROM a WHERE n <> cc UNION ALL SELECT users_idx, file_idx, 'index_not_contiguous', n FROM a WHERE lo <> 0 OR hi <> n - 1 OR di < n
      UNION ALL SELECT users_idx, file_idx, 'duplicate_chunk_id', k FROM d""",
)
def _(t):
    return ix.validate_snapshot(_snapshot(t))


@query(
    "merge_snapshot_metadata",
    "L7",
    r"""SELECT job_idx, CASE WHEN attempts IN (0, 1) THEN '{"page":' || priority || CASE WHEN attempts = 0 THEN '' ELSE ',"section":"own"' END || CASE WHEN attempts = 0 THEN ',"section":"col"' ELSE '' END || '}' END AS metadata,
       CASE attempts WHEN 2 THEN 'nested_object' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'duplicate_key' END AS problem FROM {jobs}""",
)
def _(t):
    n = F.col("attempts")
    json = (
        F.when(n == 1, '{"section":"own"}')
        .when(n == 2, '{"a":{"b":1}}')
        .when(n == 3, "[1]")
        .when(n == 4, '{"a":1," a ":2}')
    )
    legacy = {"page": F.col("priority").cast("string"), "section": F.lit('"col"')}
    df = ix.merge_snapshot_metadata(t("jobs").withColumn("json", json), "json", legacy)
    return df.select("job_idx", "metadata", "problem")


_NEWEST = "x AS (SELECT users_idx, file_idx, max(run_id) AS newest FROM {index_runs} GROUP BY 1, 2)"


@query(
    "mark_success_if_current",
    "L8",
    f"WITH {_NEWEST} SELECT run_id, CASE WHEN status = 'RUNNING' AND run_id = newest AND run_id % 3 > 0 THEN 'SUCCESS' ELSE status END AS status FROM {{index_runs}} JOIN x USING (users_idx, file_idx)",
)
def _(t):
    dealt, n = by_order(t)
    finished = dealt("index_runs").where("run_id % 3 > 0").select("run_id", F.lit(1.0).alias("finished_at"))
    runs = dealt("index_runs").withColumn("finished_at", F.lit(None).cast("double"))
    return ix.mark_success_if_current(runs, finished, n).select("run_id", "status")


_OWNERS = f"{_NEWEST}, own AS (SELECT DISTINCT rag_document_idx FROM {{index_runs}} JOIN x USING (users_idx, file_idx) WHERE status = 'SUCCESS' AND run_id = newest)"


@query(
    "mark_document_indexed_if_current",
    "L9",
    f"""WITH {_OWNERS} SELECT d.rag_document_idx, CASE WHEN o.rag_document_idx IS NOT NULL THEN 'INDEXED' ELSE index_status END AS index_status,
      CASE WHEN o.rag_document_idx IS NULL THEN deleted_at END AS deleted_at FROM {{index_documents}} d LEFT JOIN own o ON d.rag_document_idx = o.rag_document_idx""",
)
def _(t):
    dealt, n = by_order(t)
    return ix.mark_document_indexed_if_current(dealt("index_documents"), dealt("index_runs"), n).select("rag_document_idx", "index_status", "deleted_at")


@query(
    "soft_delete_superseded",
    "L10",
    f"""WITH {_OWNERS}, c AS (SELECT users_idx, file_idx, rag_document_idx AS cur FROM {{index_documents}} WHERE index_status = 'INDEXED' AND deleted_at IS NULL AND rag_document_idx IN (SELECT rag_document_idx FROM own))
      SELECT rag_document_idx, CASE WHEN index_status = 'INDEXED' AND deleted_at IS NULL AND cur <> rag_document_idx THEN TIMESTAMP '2005-01-01 00:00:00' ELSE deleted_at END AS deleted_at
      FROM {{index_documents}} LEFT JOIN c USING (users_idx, file_idx)""",
)
def _(t):
    now = F.expr("TIMESTAMP_NTZ '2005-01-01 00:00:00'")
    dealt, n = by_order(t)
    return ix.soft_delete_superseded(dealt("index_documents"), dealt("index_runs"), now, n).select("rag_document_idx", "deleted_at")


@query(
    "mark_failed",
    "L11",
    """WITH r AS (SELECT *, CASE WHEN status = 'RUNNING' AND run_id % 2 = 0 THEN 'FAILED' ELSE status END AS s2 FROM {index_runs}),
      l AS (SELECT rag_document_idx, arg_max(s2, run_id) AS s2 FROM r GROUP BY 1)
      SELECT 'run' AS kind, run_id AS idx, s2 AS status FROM r UNION ALL
      SELECT 'document', d.rag_document_idx, CASE WHEN index_status = 'INDEXING' AND l.s2 = 'FAILED' THEN 'FAILED' ELSE index_status END FROM {index_documents} d LEFT JOIN l ON d.rag_document_idx = l.rag_document_idx""",
)
def _(t):
    failures = t("index_runs").where("run_id % 2 = 0").select("run_id", F.lit("boom").alias("error_message"))
    runs, docs = ix.mark_failed(t("index_documents"), t("index_runs"), failures)
    return runs.select(F.lit("run").alias("kind"), F.col("run_id").alias("idx"), "status").unionByName(
        docs.select(F.lit("document").alias("kind"), F.col("rag_document_idx").alias("idx"), F.col("index_status").alias("status"))
    )


@query(
    "activate_documents",
    "L12",
    """SELECT chunk_id, CASE WHEN file_idx IN (2, 4) THEN TRUE WHEN file_idx = 3 THEN FALSE ELSE is_active END AS is_active FROM {points}""",
)
def _(t):
    points = t("points").withColumn("rag_document_idx", F.col("file_idx"))
    flags = t("points").select(F.col("file_idx").alias("rag_document_idx")).distinct()
    on = flags.where("rag_document_idx IN (2, 4)").withColumn("active", F.lit(True))
    off = flags.where("rag_document_idx IN (3, 4)").withColumn("active", F.lit(False))
    return ix.activate_documents(points, on.unionByName(off)).select("chunk_id", "is_active")


_SYNC_IN = "SELECT l_orderkey AS file_idx, l_suppkey % 50 AS index_version, l_linenumber AS chunk_index, concat('n', l_partkey) AS chunk_id FROM {lineitem}"


@query(
    "stale_version_guard",
    "L13 L14",
    f"""WITH i AS (SELECT file_idx, CASE WHEN index_version = 13 THEN NULL ELSE index_version END AS index_version, count(*) AS n_chunks FROM ({_SYNC_IN}) GROUP BY 1, 2),
      s AS (SELECT file_idx, max(index_version) AS v FROM {{chunks}} GROUP BY 1)
      SELECT i.file_idx, i.index_version, CASE WHEN index_version IS NULL THEN 'NO_DATA' WHEN index_version < v THEN 'STALE' ELSE 'STORED' END AS outcome FROM i LEFT JOIN s ON i.file_idx = s.file_idx""",
)
def _(t):
    dealt, n = by_order(t)
    v = F.col("index_version")
    incoming = dealt.sql(_SYNC_IN).withColumn("index_version", F.when(v != 13, v))
    incoming = incoming.groupBy("file_idx", "index_version").agg(F.count("*").alias("n_chunks"))
    return ix.stale_version_guard(dealt("chunks"), incoming, n).select("file_idx", "index_version", "outcome")


_SYNCED = f"""WITH i AS ({_SYNC_IN}), w AS (SELECT file_idx, max(index_version) AS v FROM i GROUP BY 1), s AS (SELECT file_idx, max(index_version) AS sv FROM {{chunks}} GROUP BY 1),
  ok AS (SELECT w.* FROM w LEFT JOIN s ON w.file_idx = s.file_idx WHERE sv IS NULL OR v >= sv)
  SELECT file_idx, index_version, chunk_index, chunk_id FROM {{chunks}} WHERE file_idx NOT IN (SELECT file_idx FROM ok)
  UNION ALL SELECT i.file_idx, index_version, chunk_index, chunk_id FROM i JOIN ok ON i.file_idx = ok.file_idx AND i.index_version = ok.v"""


@query("apply_chunk_sync", "L13", _SYNCED)
def _(t):
    stored = t("chunks").select("file_idx", F.col("index_version").cast("long").alias("index_version"), F.col("chunk_index"), "chunk_id")
    return ix.apply_chunk_sync(stored, t.sql(_SYNC_IN))


@query(
    "validate_callback",
    "L14",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 1 END AS v, 4 AS chunk_count, CASE WHEN o_orderpriority = '5-LOW' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 3 ELSE 4 END AS n FROM {orders})
      SELECT o_orderkey, 'missing_version' AS rule, n::BIGINT AS detail FROM c WHERE v IS NULL UNION ALL SELECT o_orderkey, 'no_chunks', n FROM c WHERE n = 0 UNION ALL SELECT o_orderkey, 'chunk_count_mismatch', n FROM c WHERE n <> 4""",
)
def _(t):
    p = F.col("o_orderpriority")
    c = t("orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", 1).alias("index_version"), F.lit(4).alias("chunk_count"),
        F.when(p == "5-LOW", 0).when(p == "2-HIGH", 3).otherwise(4).alias("n_chunks"),
    )
    return ix.validate_callback(c, ["o_orderkey"])


_META_IN = """SELECT l_orderkey AS file_idx, l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey AS seq, l_returnflag <> 'R' AS success, CASE WHEN l_quantity < 45 THEN CAST(floor(l_quantity / 10) AS INT) END AS index_version,
    concat('s', l_partkey) AS summary FROM {lineitem}"""


_META_SQL = f"""WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY seq) AS rn FROM ({_META_IN})),
      st AS (SELECT file_idx, summary, extraction_status, index_version FROM {{file_metadata}}),
      r AS (SELECT file_idx, 0::BIGINT AS rn, summary, extraction_status, index_version, FALSE AS fresh FROM st
        UNION ALL SELECT file_idx, rn, CASE WHEN ok AND success THEN nsum ELSE summary END, CASE WHEN ok THEN CASE WHEN success THEN 'READY' ELSE 'FAILED' END ELSE extraction_status END,
          CASE WHEN ok THEN coalesce(nv, index_version) ELSE index_version END, TRUE
        FROM (SELECT r.file_idx, i.rn, r.summary, r.extraction_status, r.index_version, i.summary AS nsum, i.success, i.index_version AS nv, (i.index_version IS NULL OR r.index_version IS NULL OR i.index_version >= r.index_version) AS ok
          FROM r JOIN i ON r.file_idx = i.file_idx AND i.rn = r.rn + 1))
      SELECT file_idx, arg_max(struct_pack(s := summary), rn).s AS summary, arg_max(extraction_status, rn) AS extraction_status, arg_max(struct_pack(v := index_version), rn).v AS index_version FROM r GROUP BY 1"""


@query("metadata_version_upsert", "L15", _META_SQL)
def _(t):
    stored = t("file_metadata").select("file_idx", "summary", "extraction_status", "index_version")
    dealt, n = by_order(t)
    incoming = dealt.sql(_META_IN).groupBy("file_idx", "seq").agg(*[F.first(c).alias(c) for c in ("success", "index_version", "summary")])
    return ix.metadata_version_upsert(stored, incoming, ["summary"], n)


@query(
    "extract_page",
    "L16",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_quantity < 10 THEN NULL WHEN l_quantity < 15 THEN 2 ELSE l_linenumber - 2 END AS page FROM {lineitem}""",
)
def _(t):
    return t("unit_meta").select("l_orderkey", "l_linenumber", "l_extendedprice", ix.extract_page(F.parse_json("meta_json")).alias("page"))


@query(
    "chunk_sync_payload",
    "S8",
    f"WITH {_SNAPSHOT} SELECT users_idx, file_idx, count(*) AS chunk_count, string_agg(chunk_index || ':' || chunk_id, ',' ORDER BY chunk_index, chunk_id) AS chunk_list FROM s GROUP BY 1, 2",
)
def _(t):
    p = ix.chunk_sync_payload(_snapshot(t), ["users_idx", "file_idx"], ["chunk_index", "chunk_id", "content"])
    listed = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["chunk_index"], c["chunk_id"])), ",")
    return p.select("users_idx", "file_idx", F.col("chunk_count").cast("long").alias("chunk_count"), listed.alias("chunk_list"))


@query(
    "check_constraints",
    "D1",
    """SELECT job_idx, rule FROM (SELECT job_idx, unnest([CASE WHEN job_status = 'LOST' THEN 'job_status_allowed' END, CASE WHEN attempts > max_attempts THEN 'attempts_before_max_attempts' END,
         CASE WHEN ownership_expires_at IS NULL THEN 'ownership_expires_at_required' END, CASE WHEN priority > 5 THEN 'priority_range' END, CASE WHEN attempts < 1 THEN 'attempts_minimum' END, CASE WHEN length(job_type) > 6 THEN 'job_type_length' END]) AS rule FROM {jobs})
       WHERE rule IS NOT NULL UNION ALL SELECT job_idx, 'file_idx_missing_parent' FROM {jobs} WHERE file_idx NOT IN (SELECT file_idx FROM {files} WHERE star)""",
)
def _(t):
    rules = [
        dq.one_of("job_status", *dq.JOB_STATES),
        dq.not_after("attempts", "max_attempts"),
        dq.required("ownership_expires_at"),
        dq.in_range("priority", 0, 5),
        dq.at_least("attempts", 1),
        dq.max_length("job_type", 6),
    ]
    broken = dq.check_constraints(t("jobs"), ["job_idx"], rules)
    return broken.unionByName(dq.foreign_key_violations(t("jobs"), ["job_idx"], "file_idx", t("files").where("star"), "file_idx"))


@query(
    "unique_violations",
    "D2",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM {lineitem} GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t):
    return dq.unique_violations(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "validate_reference_list",
    "D3",
    """SELECT p_partkey, rule FROM (SELECT p_partkey, unnest([CASE WHEN p_size > 20 OR p_size < 1 THEN 'reference_count' END, CASE WHEN p_size BETWEEN 5 AND 50 AND p_size > 4 THEN 'reference_positive' END,
       CASE WHEN p_size > 10 THEN 'reference_unique' END]) AS rule FROM {part}) WHERE rule IS NOT NULL""",
)
def _(t):
    ids = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.when(i == 5, F.lit(0)).when(i > 10, F.lit(10)).otherwise(i))
    return dq.validate_reference_list(t("part").withColumn("file_idxs", ids), "p_partkey")


@query(
    "validate_search_params",
    "D4",
    """SELECT doc_id, rule FROM (SELECT doc_id, unnest([CASE WHEN n_chars % 100 NOT BETWEEN 1 AND 20 THEN 'top_k_range' END, CASE WHEN lang IN ('de', 'fr') THEN 'threshold_range' END,
       CASE WHEN length(trim(text, ' ' || chr(10))) NOT BETWEEN 1 AND 4096 THEN 'query_length' END]) AS rule FROM {documents}) WHERE rule IS NOT NULL""",
)
def _(t):
    lang = F.col("lang")
    requests = t("documents").select(
        "doc_id", F.col("text").alias("query"), (F.col("n_chars") % 100).alias("top_k"),
        F.when(lang == "de", float("nan")).when(lang == "fr", 1.5).when(lang == "en", 0.25).alias("score_threshold"),
    )
    return dq.validate_search_params(requests, "doc_id")


@query(
    "parse_stage_log",
    "S5",
    """SELECT event_id AS line_id, user_id AS file_idx, CASE WHEN event_type = 'click' THEN 'pdf' ELSE 'unknown' END AS file_type,
       CASE event_type WHEN 'click' THEN 'download' WHEN 'view' THEN 'document_chunking_completed' ELSE 'file_processing' END AS stage,
       CASE event_type WHEN 'click' THEN 'file_download_completed' WHEN 'view' THEN 'document_chunking_completed' ELSE 'file_processing_completed' END AS event,
       value AS duration_ms, CASE WHEN event_type = 'view' THEN event_id END AS chunk_count FROM {events} WHERE event_type IN ('click', 'view', 'signup') AND user_id > 0""",
)
def _(t):
    e = readers.parse_stage_log(t("stage_log"), "line", keep=("line_id",))
    return e.select("line_id", "file_idx", "file_type", "stage", "event", "duration_ms", "chunk_count")


@query(
    "request_records_csv",
    "S3",
    "SELECT CAST(request_id AS VARCHAR) AS request_id, operation, concurrency, duration_ms, success, input_tokens, error_type, error_message FROM {records}",
)
def _(t):
    path = scratch(t, "records")
    names = [f.name for f in readers.schemas.REQUEST_RECORDS.fields]
    t("records").withColumn("run_id", F.lit("r1")).select(*names).write.csv(path, header=True)
    good, _rejects = readers.read_request_records(t.spark, path)
    return good.select("request_id", "operation", "concurrency", "duration_ms", "success", "input_tokens", "error_type", "error_message")


@query(
    "request_records_rejects",
    "S3",
    "SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN operation = 'ingest' THEN 'success' ELSE 'concurrency' END AS bad_column FROM {records} WHERE operation = 'ingest' OR concurrency > 8",
)
def _(t):
    path = scratch(t, "records")
    names = [f.name for f in readers.schemas.REQUEST_RECORDS.fields]
    df = t("records").withColumn("run_id", F.lit("r1"))
    df = df.withColumn("success", F.when(F.col("operation") == "ingest", "yes").otherwise(F.col("success").cast("string")))
    bad = (F.col("operation") != "ingest") & (F.col("concurrency") > 8)
    df = df.withColumn("concurrency", F.when(bad, F.lit(None)).otherwise(F.col("concurrency")))
    df.select(*names).write.csv(path, header=True)
    return readers.read_request_records(t.spark, path)[1].select("request_id", "bad_column")


@query(
    "level_summaries_csv",
    "S4",
    "SELECT operation, phase, concurrency, count(*) AS request_count, count(*) FILTER (WHERE success) AS success_count, min(duration_ms) FILTER (WHERE success) AS min_ms FROM {records} GROUP BY ALL",
)
def _(t):
    from corpusloom.operators.telemetry import summarize_level

    path = scratch(t, "levels")
    names = [f.name for f in readers.schemas.LEVEL_SUMMARIES.fields]
    summarize_level(t("records")).select(*names).write.csv(path, header=True)
    good, _rejects = readers.read_level_summaries(t.spark, path)
    return good.select("operation", "phase", "concurrency", "request_count", "success_count", "min_ms")


@query(
    "text_files",
    "S2 N6 N7",
    """SELECT CASE WHEN lang = 'de' OR (lang = 'es' AND 1 + length(text) - length(replace(text, 'a', '')) > 0.05 * (length(text) + 1)) THEN 'binary_content' ELSE 'text' END AS kind,
       lang, count(*) AS files FROM {documents} GROUP BY 1, 2""",
)
def _(t):
    raw = t("raw_files").join(t("documents").select("doc_id", "lang"), "doc_id")
    # PDF signatures stay; the archive signature is cut off again, leaving plain text.
    raw = raw.select("doc_id", "lang", F.encode(F.regexp_replace("raw", "^PK\x03\x04", ""), "UTF-8").alias("content"))
    good, bad = readers.decode_files(raw, ["doc_id", "lang"])
    both = good.select(F.lit("text").alias("kind"), "lang").unionByName(bad.select(F.col("problem").alias("kind"), "lang"))
    return both.groupBy("kind", "lang").agg(F.count("*").alias("files"))


@query(
    "read_corpus",
    "S1",
    "SELECT source AS owner, lang AS language, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM {documents} GROUP BY 1, 2",
)
def _(t):
    corpus = readers.read_corpus(t.spark, f"{t.sf_dir}/documents.parquet")
    return corpus.groupBy("owner", "language").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


@query(
    "read_text_files",
    "S2",
    "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars, 0 AS rejected FROM {documents} GROUP BY lang",
)
def _(t):
    path = scratch(t, "texts")
    # A file is one document for the reader, as long as an upload may be; its size must not grow with the table.
    t("documents").select("lang", "text").write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(path)
    good, bad = readers.read_text_files(t.spark, f"{path}/*/*.txt")
    both = good.select("path", F.length("text").alias("n"), F.lit(0).alias("bad")).unionByName(
        bad.select("path", F.lit(0).alias("n"), F.lit(1).alias("bad"))
    )
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")
    return both.groupBy(lang).agg(F.sum("n").alias("chars"), F.sum("bad").cast("int").alias("rejected"))


@query(
    "write_index",
    "S6",
    "SELECT chunk_id, users_idx, file_idx, CASE WHEN file_idx < 5 THEN FALSE ELSE is_active END AS is_active FROM {points}",
)
def _(t):
    path = scratch(t, "index")
    points = t("points").select("chunk_id", "users_idx", "file_idx", "is_active", "embedding")
    sinks.write_index(points.where("file_idx < 8"), path, buckets=4)
    sinks.write_index(points.where("file_idx < 5").withColumn("is_active", F.lit(False)).unionByName(points.where("file_idx >= 8")), path, buckets=4)
    return sinks.read_index(t.spark, path).select("chunk_id", "users_idx", "file_idx", "is_active")


@query(
    "read_index_of_owners",
    "S6 V8",
    "SELECT chunk_id, users_idx, file_idx FROM {points} WHERE users_idx IN (1, 3)",
)
def _(t):
    path = scratch(t, "index")
    sinks.write_index(t("points").select("chunk_id", "users_idx", "file_idx"), path)
    return sinks.read_index(t.spark, path, owners=[1, 3]).select("chunk_id", "users_idx", "file_idx")


@query(
    "write_reports",
    "S7",
    "SELECT 'levels' AS table_name, count(*) AS row_count FROM (SELECT DISTINCT operation, phase, concurrency FROM {records}) UNION ALL SELECT 'markers', 2",
)
def _(t):
    from corpusloom.operators import telemetry as tm

    tables = {"levels": tm.summarize_level(t("records")), "markers": tm.scan_log_markers(t("log_lines"))}
    return sinks.write_reports(tables, scratch(t, "reports"))
