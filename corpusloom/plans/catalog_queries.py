"""Catalog, accounts, trees, proposals and task states over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import catalog as ct
from corpusloom.operators import tasks as tk
from corpusloom.operators import trees as tr
from corpusloom.plans.registry import DealtTables, Tables, by_order, query

NOW = "TIMESTAMP '2000-01-01 00:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")


@query(
    "search_files",
    "F1 F2 F3",
    """SELECT f.file_idx, f.name, f.created_at FROM {files} f WHERE deleted_at IS NULL AND contains(name, '%3') AND file_type = 'pdf'
       AND created_at >= DATE '1996-03-01' AND created_at < DATE '1998-06-12' + INTERVAL 1 DAY
       AND EXISTS (SELECT 1 FROM {file_metadata} m WHERE m.file_idx = f.file_idx AND document_type = 'invoice')""",
)
def _(t):
    found = ct.search_files(
        t("files"), t("file_metadata"), keyword="%3", file_type="pdf",
        date_from="1996-03-01", date_to="1998-06-12", document_type="invoice",
    )
    return found.select("file_idx", "name", "created_at")


@query(
    "search_files_by_tag",
    "F1",
    """SELECT file_idx, users_idx FROM {files} WHERE deleted_at IS NULL AND file_idx IN (SELECT file_idx FROM {file_metadata} WHERE tags = '["report","ta"]')""",
)
def _(t):
    return ct.search_files(t("files"), t("file_metadata"), tag="ta").select("file_idx", "users_idx")


@query(
    "file_page",
    "F4",
    "SELECT file_idx, created_at FROM {files} WHERE deleted_at IS NULL ORDER BY created_at DESC, file_idx LIMIT 20 OFFSET 40",
)
def _(t):
    return ct.page(ct.search_files(t("files"), t("file_metadata")), 2, 20).select("file_idx", "created_at")


@query("file_page_total", "F4", "SELECT count(*) AS total FROM {files} WHERE deleted_at IS NULL")
def _(t):
    return ct.page_total(ct.search_files(t("files"), t("file_metadata")))


_LISTS = """CASE tags WHEN '["report","ta"]' THEN 'report,ta' WHEN '["tag"]' THEN 'tag' ELSE '' END"""


@query(
    "files_with_metadata",
    "F5",
    f"""SELECT f.file_idx, coalesce(summary, '') AS summary, {_LISTS} AS tags, CASE WHEN keywords IS NOT NULL THEN 'Alpha,beta' ELSE '' END AS keywords,
      CASE WHEN entities LIKE '{{"%' THEN '2001' ELSE '' END AS dates, CASE WHEN entities LIKE '{{"%' THEN 'x' END AS project
      FROM {{files}} f LEFT JOIN {{file_metadata}} m ON f.file_idx = m.file_idx""",
)
def _(t):
    df = ct.files_with_metadata(t("files"), t("file_metadata"))
    return df.select(
        "file_idx", "summary", F.array_join("tags", ",").alias("tags"), F.array_join("keywords", ",").alias("keywords"),
        F.array_join("entities.dates", ",").alias("dates"), F.col("entities.project").alias("project"),
    )


_CLOSURE = """WITH RECURSIVE cl AS (SELECT folder_idx AS ancestor, folder_idx AS descendant, 0 AS depth FROM {folders}
  UNION ALL SELECT f.parent_folder_idx, cl.descendant, cl.depth + 1 FROM cl JOIN {folders} f ON cl.ancestor = f.folder_idx WHERE f.parent_folder_idx IS NOT NULL)"""


def _pairs(t: Tables):
    return tr.folder_closure(t("folders"))


@query(
    "client_filter",
    "F6",
    _CLOSURE
    + """ SELECT f.file_idx FROM {files} f LEFT JOIN {file_metadata} m ON f.file_idx = m.file_idx
      WHERE (lower(name) LIKE '%ur%' OR lower(coalesce(summary, '')) LIKE '%ur%') AND folder_idx IN (SELECT descendant FROM cl WHERE ancestor = 2)
        AND keywords IS NOT NULL AND created_at < DATE '2000-01-02'""",
)
def _(t):
    docs = ct.files_with_metadata(t("files"), t("file_metadata"))
    return ct.client_filter(docs, "uR", _pairs(t), folder=2, tag=" ALPH ", date_to="2000-01-01").select("file_idx")


@query(
    "storage_usage",
    "F7",
    """SELECT u.users_idx, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS used_bytes, CAST(2000000 AS BIGINT) AS quota_bytes, coalesce(sum(size_bytes), 0) > 2000000 AS over_quota
       FROM {users} u LEFT JOIN {files} f ON u.users_idx = f.users_idx AND deleted_at IS NULL GROUP BY 1""",
)
def _(t):
    return ct.storage_usage(t("users"), t("files"), 2_000_000)


@query(
    "quota_check",
    "F8",
    """WITH RECURSIVE u AS (SELECT users_idx, sum(size_bytes) AS used FROM {files} WHERE deleted_at IS NULL GROUP BY 1),
      b AS (SELECT b.*, coalesce(used, 0) AS used, row_number() OVER (PARTITION BY b.users_idx ORDER BY arrival) AS rn FROM {upload_batches} b LEFT JOIN u ON b.users_idx = u.users_idx),
      r AS (SELECT DISTINCT users_idx, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS added, [''] AS keys, CAST(NULL AS BIGINT) AS arrival, '' AS outcome FROM b
        UNION ALL SELECT users_idx, rn, added + CASE WHEN o = 'accepted' THEN incoming_bytes ELSE 0 END,
          CASE WHEN o = 'accepted' AND idempotency_key IS NOT NULL THEN list_append(keys, idempotency_key) ELSE keys END, arrival, o
        FROM (SELECT b.users_idx, b.rn, r.added, r.keys, b.arrival, b.incoming_bytes, b.idempotency_key,
          CASE WHEN b.idempotency_key IS NOT NULL AND list_contains(r.keys, b.idempotency_key) THEN 'existing' WHEN b.used + r.added + b.incoming_bytes > 4000000 THEN 'rejected' ELSE 'accepted' END AS o
          FROM r JOIN b ON r.users_idx = b.users_idx AND b.rn = r.rn + 1))
      SELECT users_idx, arrival, outcome FROM r WHERE rn > 0""",
)
def _(t):
    usage = ct.storage_usage(t("users"), t("files"), 4_000_000)
    return ct.quota_check(t("upload_batches"), usage, 4_000_000).select("users_idx", "arrival", "outcome")


@query(
    "validate_upload",
    "F9",
    """WITH f AS (SELECT o_custkey AS batch, CASE WHEN o_totalprice < 3000 THEN 0 ELSE o_totalprice * 60 END AS size_bytes, CASE o_orderstatus WHEN 'P' THEN 'a.exe' ELSE 'b.PDF' END AS name FROM {orders}),
      a AS (SELECT batch, count(*) AS n, count(*) FILTER (WHERE size_bytes = 0) AS e, count(*) FILTER (WHERE size_bytes > 20971520) AS l, count(*) FILTER (WHERE name = 'a.exe') AS x FROM f GROUP BY 1)
      SELECT batch, 'too_many_files' AS rule, n AS detail FROM a WHERE n > 5 UNION ALL SELECT batch, 'empty_file', e FROM a WHERE e > 0
      UNION ALL SELECT batch, 'file_too_large', l FROM a WHERE l > 0 UNION ALL SELECT batch, 'unsupported_extension', x FROM a WHERE x > 0""",
)
def _(t):
    price = F.col("o_totalprice")
    files = t("orders").select(
        F.col("o_custkey").alias("batch"),
        F.when(price < 3000, 0).otherwise(price * 60).alias("size_bytes"),
        F.when(F.col("o_orderstatus") == "P", "a.exe").otherwise("b.PDF").alias("name"),
    )
    return ct.validate_upload(files, "batch")


@query(
    "users_with_document_count",
    "F10",
    "SELECT u.users_idx, u.created_at, count(f.file_idx) AS document_count FROM {users} u LEFT JOIN {files} f ON u.users_idx = f.users_idx AND f.deleted_at IS NULL GROUP BY 1, 2",
)
def _(t):
    return ct.users_with_document_count(t("users"), t("files")).select("users_idx", "created_at", "document_count")


@query(
    "recent_files",
    "F11",
    """SELECT users_idx, file_idx, position FROM (SELECT users_idx, file_idx, row_number() OVER (PARTITION BY users_idx ORDER BY created_at DESC, file_idx) AS position
       FROM {files} WHERE deleted_at IS NULL) WHERE position <= 5""",
)
def _(t):
    return ct.recent_files(t("files"), 5).select("users_idx", "file_idx", "position")


@query(
    "latest_job_per_file",
    "F12",
    """SELECT file_idx, job_idx, 'any' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY created_at DESC, job_idx DESC) AS n FROM {jobs}) WHERE n = 1
       UNION ALL SELECT file_idx, job_idx, 'ingest' FROM (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY created_at DESC, job_idx DESC) AS n FROM {jobs} WHERE job_type = 'INGEST') WHERE n = 1
       UNION ALL SELECT file_idx, job_idx, 'open' FROM (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY created_at DESC, job_idx DESC) AS n FROM {jobs} WHERE job_status IN ('PENDING', 'RUNNING')) WHERE n = 1""",
)
def _(t):
    jobs = t("jobs")
    parts = [("any", {}), ("ingest", {"job_type": "INGEST"}), ("open", {"statuses": ("PENDING", "RUNNING")})]
    out = [ct.latest_job_per_file(jobs, **kw).select("file_idx", "job_idx", F.lit(n).alias("kind")) for n, kw in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "file_status",
    "F13",
    """SELECT f.file_idx, f.status, coalesce(j.attempts, 0) AS attempts, m.extraction_status FROM {files} f
       LEFT JOIN (SELECT file_idx, arg_max(attempts, struct_pack(c := created_at, j := job_idx)) AS attempts FROM {jobs} GROUP BY 1) j ON f.file_idx = j.file_idx
       LEFT JOIN {file_metadata} m ON f.file_idx = m.file_idx""",
)
def _(t):
    return ct.file_status(t("files"), t("jobs"), t("file_metadata"))


@query(
    "all_owned",
    "F14",
    """WITH a AS (SELECT o_orderkey AS request_id, o_custkey AS user_idx, o_orderkey AS file_idx FROM {orders} UNION ALL SELECT o_orderkey, o_custkey, o_orderkey + 1 FROM {orders})
       SELECT request_id, count(*) AS asked, count(*) FILTER (WHERE f.users_idx = user_idx) AS owned, count(*) = count(*) FILTER (WHERE f.users_idx = user_idx) AS all_owned
       FROM a LEFT JOIN {files} f ON a.file_idx = f.file_idx AND f.deleted_at IS NULL GROUP BY 1""",
)
def _(t):
    key = F.col("o_orderkey")
    requests = t("orders").select(
        key.alias("request_id"), F.col("o_custkey").alias("user_idx"), F.array(key, key + 1, key).alias("file_idxs")
    )
    return ct.all_owned(requests, t("files"))


@query(
    "normalize_tags",
    "F15",
    r"""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '' AND length(x) <= 50) AS l FROM {documents})
      SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:30], '|') AS tags FROM w""",
)
def _(t):
    tags = ct.normalize_tags(F.split("text", " "))
    return t("documents").select("doc_id", F.array_join(tags, "|").alias("tags"))


@query(
    "sample_for_metadata",
    "F16",
    """SELECT file_idx, left(string_agg(content, chr(10) || chr(10) ORDER BY n), 60) AS sample FROM
      (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY chunk_index, chunk_id) AS n FROM {chunks}) WHERE n <= 6 GROUP BY 1""",
)
def _(t):
    return ct.sample_for_metadata(t("chunks"), max_chars=60)


@query(
    "clean_generated_metadata",
    "F17",
    """WITH g AS (SELECT o_orderkey AS file_idx, CASE WHEN o_orderstatus = 'P' THEN '  ' ELSE '  Sum ' || o_orderpriority || ' ' END AS summary,
        o_totalprice / 300000.0::DOUBLE - 0.2::DOUBLE AS confidence, CASE WHEN o_orderstatus = 'F' THEN ' invoice ' ELSE 'other' END AS kind, o_orderstatus <> 'P' AS ok FROM {orders})
      SELECT file_idx, CASE WHEN ok THEN 'READY' ELSE 'FAILED' END AS extraction_status, CASE WHEN ok THEN left(trim(summary), 8) END AS summary,
        CASE WHEN ok THEN 'a,b,c,d,e' END AS keywords, CASE WHEN ok THEN round(greatest(0, least(1, confidence)), 9) END AS confidence,
        CASE WHEN ok AND trim(kind) = 'invoice' THEN 'invoice' END AS document_type FROM g""",
)
def _(t):
    s = F.col("o_orderstatus")
    df = t("orders").select(
        F.col("o_orderkey").alias("file_idx"),
        F.when(s == "P", "  ").otherwise(F.concat(F.lit("  Sum "), "o_orderpriority", F.lit(" "))).alias("summary"),
        F.array(*[F.lit(c) for c in "abcdefg"]).alias("keywords"),
        *[F.array(F.lit("x")).alias(n) for n in ("dates", "people", "amounts")],
        (F.col("o_totalprice") / 300000.0 - 0.2).alias("confidence"),
        F.when(s == "F", " invoice ").otherwise("other").alias("document_type"),
    )
    out = ct.clean_generated_metadata(df, ("invoice", "contract"), 8)
    return out.select(
        "file_idx", "extraction_status", "summary", F.array_join("keywords", ",").alias("keywords"),
        F.round("confidence", 9).alias("confidence"), "document_type",
    )


_PENDING = "SELECT m.file_idx FROM {file_metadata} m JOIN {files} f ON m.file_idx = f.file_idx WHERE status = 'READY' AND deleted_at IS NULL AND extraction_status = 'PROCESSING'"


@query("pending_metadata_files", "F18", _PENDING)
def _(t):
    return ct.pending_metadata_files(t("file_metadata"), t("files"))


@query(
    "claimed_metadata_version",
    "F19",
    f"""SELECT p.file_idx, max(c.index_version) AS extraction_index_version, 'GENERATING' AS extraction_status FROM ({_PENDING}) p
      LEFT JOIN {{chunks}} c ON p.file_idx = c.file_idx GROUP BY 1""",
)
def _(t):
    return ct.claimed_metadata_version(ct.pending_metadata_files(t("file_metadata"), t("files")), t("chunks"))


@query(
    "coalesce_document_type",
    "F20",
    "SELECT file_idx, coalesce(nullif(document_type, ''), 'generated') AS document_type FROM {file_metadata}",
)
def _(t):
    kind = ct.coalesce_document_type(F.col("document_type"), F.lit("generated"))
    return t("file_metadata").select("file_idx", kind.alias("document_type"))


@query(
    "dashboard_counts",
    "F21",
    "SELECT count(*) AS total, count(*) FILTER (WHERE star) AS starred, count(*) FILTER (WHERE status IN ('PROCESSING', 'UPLOADED')) AS processing FROM {files}",
)
def _(t):
    return ct.dashboard_counts(t("files"))


@query(
    "root_folder_counts",
    "F21",
    _CLOSURE
    + """ SELECT r.folder_idx, r.name, count(f.file_idx) AS document_count FROM {folders} r JOIN cl ON cl.ancestor = r.folder_idx LEFT JOIN {files} f ON f.folder_idx = cl.descendant
      WHERE r.parent_folder_idx IS NULL GROUP BY 1, 2 UNION ALL SELECT NULL, 'unclassified', count(*) FROM {files} WHERE folder_idx IS NULL""",
)
def _(t):
    return ct.root_folder_counts(t("files"), t("folders"), _pairs(t))


@query(
    "sanction_history",
    "F22",
    "SELECT users_idx, sanction_idx, started_at, sanction_type FROM {sanctions}",
)
def _(t):
    return ct.sanction_history(t("sanctions")).select("users_idx", "sanction_idx", "started_at", "sanction_type")


@query(
    "active_suspension",
    "F22",
    """SELECT users_idx, sanction_idx, sanction_type, started_at FROM (SELECT *, row_number() OVER (PARTITION BY users_idx ORDER BY started_at DESC, sanction_idx DESC) AS n
      FROM {sanctions} WHERE status = 'ACTIVE' AND sanction_type IN ('TEMP_SUSPEND', 'PERMANENT_SUSPEND')) WHERE n = 1""",
)
def _(t):
    return ct.active_suspension(t("sanctions"))


@query(
    "token_state",
    "F23",
    f"""SELECT o_orderkey AS token_idx, CASE WHEN o_orderstatus = 'F' THEN 'revoked' WHEN o_orderdate <= {NOW} THEN 'expired' ELSE 'valid' END AS state FROM {{orders}}""",
)
def _(t):
    revoked = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    state = ct.token_state(revoked, F.col("o_orderdate"), _now())
    return t("orders").select(F.col("o_orderkey").alias("token_idx"), state.alias("state"))


@query(
    "conversation_list",
    "F24",
    "SELECT users_idx, conversation_idx, updated_at FROM (SELECT o_custkey AS users_idx, o_orderkey AS conversation_idx, o_orderdate AS updated_at, o_orderstatus = 'F' AS del FROM {orders}) WHERE NOT del",
)
def _(t):
    c = t("orders").select(
        F.col("o_custkey").alias("users_idx"), F.col("o_orderkey").alias("conversation_idx"),
        F.col("o_orderdate").alias("updated_at"), (F.col("o_orderstatus") == "F").alias("del"),
    )
    return ct.conversation_list(c).drop("del")


@query(
    "next_default_title",
    "F25",
    """WITH n AS (SELECT DISTINCT o_custkey AS users_idx, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS n FROM {orders} WHERE o_orderstatus <> 'F')
      SELECT users_idx, min(i) AS number, '대화 ' || min(i) AS title FROM (SELECT users_idx, unnest([1, 2, 3, 4, 5, 6])::BIGINT AS i FROM {users}) c
      WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.users_idx = c.users_idx AND n.n = c.i) GROUP BY 1""",
)
def _(t):
    word = F.when(F.col("o_orderstatus") == "F", "other ").otherwise("대화 ")
    titles = t("orders").select(
        F.col("o_custkey").alias("users_idx"), F.concat(word, F.substring("o_orderpriority", 1, 1)).alias("title")
    )
    return ct.next_default_title(titles, t("users"))


def _citations(t: Tables):
    return t("hits").select(
        F.col("request_id").alias("message_id"), F.col("rank").alias("citation_order"),
        F.concat(F.lit("SOURCE-"), "rank").alias("source_id"), F.col("chunk_id").alias("file_idx"),
        F.concat(F.lit("old "), "rank").alias("file_name"),
    )


@query(
    "message_history",
    "F26",
    """WITH c AS (SELECT request_id AS message_id, string_agg(rank || '=' || coalesce(f.name, 'old ' || rank), ',' ORDER BY rank) AS citations FROM {hits} h LEFT JOIN {files} f ON h.chunk_id = f.file_idx GROUP BY 1),
      m AS (SELECT DISTINCT request_id AS message_id FROM {hits})
      SELECT m.message_id, c.citations, (m.message_id + 7) || '=' || coalesce(f2.name, '?') || ',' || m.message_id || '=' || coalesce(f1.name, '?') AS reference_files
      FROM m JOIN c ON m.message_id = c.message_id LEFT JOIN {files} f1 ON f1.file_idx = m.message_id LEFT JOIN {files} f2 ON f2.file_idx = m.message_id + 7""",
)
def _(t):
    ids = F.format_string("[%d, %d]", F.col("request_id") + 7, F.col("request_id"))
    messages = t("hits").select(F.col("request_id").alias("message_id"), ids.alias("reference_file_idxs")).distinct()
    h = ct.message_history(messages, _citations(t), t("files"))
    return h.select(
        "message_id",
        F.array_join(F.transform("citations", lambda c: F.concat_ws("=", c["citation_order"], c["file_name"])), ",").alias("citations"),
        F.array_join(F.transform("references", lambda c: F.concat_ws("=", c["file_idx"], F.coalesce(c["name"], F.lit("?")))), ",").alias("reference_files"),
    )


@query(
    "citations_from_sources",
    "F27",
    """SELECT message_id, source_order, row_number() OVER (PARTITION BY message_id ORDER BY source_order) AS citation_order FROM
      (SELECT l_orderkey AS message_id, (l_linenumber * 10000000 + l_partkey) * 10000 + l_suppkey AS source_order FROM {lineitem} JOIN {files} ON l_partkey = file_idx WHERE deleted_at IS NULL)""",
)
def _(t):
    place = (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    sources = t("lineitem").select(
        F.col("l_orderkey").alias("message_id"), place.alias("source_order"),
        F.col("l_partkey").alias("chunk_id"), F.col("l_partkey").alias("file_idx"),
    )
    chunks = t("files").where(ct.is_live()).select(F.col("file_idx").alias("chunk_id"), "file_idx", F.lit(0).alias("chunk_index"))
    return ct.citations_from_sources(sources, chunks).select("message_id", "source_order", "citation_order")


@query(
    "usage_totals",
    "F28",
    "SELECT request_id, call_index, CASE WHEN requested_output IS NOT NULL THEN input_tokens + output_tokens END AS total_tokens FROM {calls}",
)
def _(t):
    out = F.when(F.col("requested_output").isNotNull(), F.col("output_tokens"))
    return t("calls").select(
        "request_id", "call_index", ct.total_tokens(F.col("input_tokens"), out).cast("long").alias("total_tokens")
    )


@query(
    "cascade_delete",
    "F29",
    """WITH d AS (SELECT file_idx FROM {files} WHERE deleted_at IS NOT NULL)
      SELECT 'jobs' AS table_name, count(*) AS rows_left FROM {jobs} WHERE file_idx NOT IN (SELECT file_idx FROM d)
      UNION ALL SELECT 'metadata', count(*) FROM {file_metadata} WHERE file_idx NOT IN (SELECT file_idx FROM d)
      UNION ALL SELECT 'chunks', count(*) FROM {chunks} WHERE file_idx NOT IN (SELECT file_idx FROM d)""",
)
def _(t):
    gone = t("files").where("deleted_at IS NOT NULL")
    left = ct.cascade_delete(gone, {"jobs": t("jobs"), "metadata": t("file_metadata"), "chunks": t("chunks")})
    parts = [df.agg(F.count("*").alias("rows_left")).select(F.lit(n).alias("table_name"), "rows_left") for n, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "owned_row_counts",
    "M24",
    """WITH o AS (SELECT DISTINCT users_idx, file_idx FROM {files} WHERE deleted_at IS NOT NULL),
      c AS (SELECT 'chunks' AS table_name, count(*) AS row_count FROM {chunks} WHERE (users_idx, file_idx) IN (SELECT users_idx, file_idx FROM o)
        UNION ALL SELECT 'runs', count(*) FROM {index_runs} WHERE (users_idx, file_idx) IN (SELECT users_idx, file_idx FROM o))
      SELECT table_name, row_count, row_count = 0 AS is_clean FROM c UNION ALL SELECT 'total', CAST(sum(row_count) AS BIGINT), sum(row_count) = 0 FROM c""",
)
def _(t):
    owned = t("files").where("deleted_at IS NOT NULL")
    dealt, n = by_order(t)
    return ct.owned_row_counts(owned, {"chunks": dealt("chunks"), "runs": dealt("index_runs")}, n)


@query("folder_closure", "T1", _CLOSURE + " SELECT ancestor, descendant, depth FROM cl")
def _(t):
    return _pairs(t)


@query(
    "folder_paths",
    "T2",
    _CLOSURE
    + " SELECT descendant AS folder_idx, string_agg(name, '/' ORDER BY depth DESC) AS path, max(depth) AS depth FROM cl JOIN {folders} f ON cl.ancestor = f.folder_idx GROUP BY 1",
)
def _(t):
    return tr.folder_paths(t("folders"), _pairs(t)).select("folder_idx", "path", "depth")


@query(
    "invalid_moves",
    "T3",
    _CLOSURE
    + " SELECT DISTINCT m.a AS folder_idx, m.b AS new_parent_idx FROM (SELECT 100 + s_nationkey AS a, 1000 + s_suppkey AS b FROM {supplier}) m JOIN cl ON cl.ancestor = m.a AND cl.descendant = m.b",
)
def _(t):
    moves = t("supplier").select(
        (F.col("s_nationkey") + 100).cast("long").alias("folder_idx"), (F.col("s_suppkey") + 1000).alias("new_parent_idx")
    )
    return tr.invalid_moves(moves, _pairs(t)).distinct()


_DEL = "TIMESTAMP '2003-05-06 07:08:09.123'"


@query(
    "soft_delete_subtree",
    "T4",
    _CLOSURE
    + f""", gone AS (SELECT DISTINCT descendant FROM cl WHERE ancestor IN (SELECT folder_idx FROM {{folders}} WHERE name LIKE 'NATION_1%'))
      SELECT 'folder' AS kind, folder_idx AS idx, NULL AS status, CASE WHEN folder_idx IN (SELECT descendant FROM gone) THEN {_DEL} ELSE deleted_at END AS deleted_at FROM {{folders}}
      UNION ALL SELECT 'file', file_idx, CASE WHEN deleted_at IS NULL AND folder_idx IN (SELECT descendant FROM gone) THEN 'DELETED' ELSE status END,
        CASE WHEN deleted_at IS NULL AND folder_idx IN (SELECT descendant FROM gone) THEN {_DEL} ELSE deleted_at END FROM {{files}}""",
)
def _(t):
    roots = t("folders").where("name LIKE 'NATION\\_1%'")
    at = F.expr("TIMESTAMP_NTZ '2003-05-06 07:08:09.123456'")
    folders, files = tr.soft_delete_subtree(t("folders"), t("files"), _pairs(t), roots, at)
    return folders.select(
        F.lit("folder").alias("kind"), F.col("folder_idx").alias("idx"), F.lit(None).cast("string").alias("status"), "deleted_at"
    ).unionByName(files.select(F.lit("file").alias("kind"), F.col("file_idx").alias("idx"), "status", "deleted_at"))


_RESTORE = _CLOSURE + """, st AS (SELECT folder_idx AS root, deleted_at AS stamp FROM {folders} WHERE deleted_at IS NOT NULL AND users_idx > 0),
  bl AS (SELECT DISTINCT descendant, stamp FROM cl JOIN st ON cl.ancestor = st.root),
  fo AS (SELECT f.folder_idx, f.parent_folder_idx, CASE WHEN EXISTS (SELECT 1 FROM bl WHERE bl.descendant = f.folder_idx AND bl.stamp = f.deleted_at) THEN NULL ELSE f.deleted_at END AS deleted_at FROM {folders} f),
  fi AS (SELECT f.*, EXISTS (SELECT 1 FROM bl WHERE bl.descendant = f.folder_idx AND bl.stamp = f.deleted_at) AS hit, (SELECT count(*) FROM {chunks} c WHERE c.file_idx = f.file_idx) AS n FROM {files} f)"""


@query(
    "restore_subtree",
    "T5",
    _RESTORE
    + """ SELECT 'folder' AS kind, fo.folder_idx AS idx, fo.deleted_at, CASE WHEN fo.folder_idx IN (SELECT root FROM st) AND p.folder_idx IS NULL THEN NULL ELSE CAST(fo.parent_folder_idx AS VARCHAR) END AS state
      FROM fo LEFT JOIN fo p ON fo.parent_folder_idx = p.folder_idx AND p.deleted_at IS NULL
      UNION ALL SELECT 'file', file_idx, CASE WHEN hit THEN NULL ELSE deleted_at END, CASE WHEN hit AND n > 0 THEN 'READY' WHEN hit THEN 'UPLOADED' ELSE status END FROM fi
      UNION ALL SELECT 'ingest', file_idx, NULL, NULL FROM fi WHERE hit AND n = 0""",
)
def _(t):
    roots = t("folders").where("deleted_at IS NOT NULL AND users_idx > 0")
    folders, files, again = tr.restore_subtree(t("folders"), t("files"), t("chunks"), _pairs(t), roots)
    return (
        folders.select(F.lit("folder").alias("kind"), F.col("folder_idx").alias("idx"), "deleted_at", F.col("parent_folder_idx").cast("string").alias("state"))
        .unionByName(files.select(F.lit("file").alias("kind"), F.col("file_idx").alias("idx"), "deleted_at", F.col("status").alias("state")))
        .unionByName(again.select(F.lit("ingest").alias("kind"), F.col("file_idx").alias("idx"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.lit(None).cast("string").alias("state")))
    )


@query(
    "purge_order",
    "T6",
    _CLOSURE
    + " SELECT descendant AS folder_idx, max(depth) AS depth FROM cl WHERE ancestor IN (SELECT folder_idx FROM {folders} WHERE deleted_at IS NOT NULL) GROUP BY 1",
)
def _(t):
    return tr.purge_order(t("folders"), t("folders").where("deleted_at IS NOT NULL"))


@query(
    "folder_tree_counts",
    "T7",
    _CLOSURE
    + """ SELECT cl.ancestor AS folder_idx, count(f.file_idx) FILTER (WHERE depth = 0) AS file_count, count(f.file_idx) AS total_file_count
      FROM cl LEFT JOIN {files} f ON f.folder_idx = cl.descendant GROUP BY 1""",
)
def _(t):
    return tr.folder_tree_counts(t("folders"), t("files"), _pairs(t))


@query(
    "best_matching_folder",
    "T8",
    _CLOSURE
    + """, d AS (SELECT s_suppkey AS doc_id, s_suppkey % 3 AS users_idx, lower(s_name || ' in nation_' || s_nationkey || ' or ' || r_name) AS text FROM {supplier} JOIN {region} ON s_suppkey % 5 = r_regionkey
        UNION ALL SELECT 1000000 + doc_id, doc_id % 3, lower(text || ' supplier in europe, or nation_' || doc_id % 25) FROM {documents}),
      s AS (SELECT d.doc_id, cl.descendant, sum(CASE WHEN depth = 0 THEN 2 ELSE 1 END) AS score FROM d JOIN {folders} a ON a.users_idx = d.users_idx AND length(a.name) >= 2 AND contains(d.text, lower(a.name)) JOIN cl ON cl.ancestor = a.folder_idx
        JOIN {folders} f ON f.folder_idx = cl.descendant AND f.users_idx = d.users_idx GROUP BY 1, 2),
      b AS (SELECT doc_id, descendant AS folder_idx, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, descendant) AS n FROM s) WHERE n = 1)
      SELECT b.doc_id, b.folder_idx, b.score, array_to_string(array_agg(a.name ORDER BY cl.depth DESC) FILTER (WHERE length(a.name) >= 2 AND contains(d.text, lower(a.name))), '/') AS matched_names,
        array_to_string(array_agg(a.name ORDER BY cl.depth DESC), '/') AS path
      FROM b JOIN d ON b.doc_id = d.doc_id JOIN cl ON cl.descendant = b.folder_idx JOIN {folders} a ON a.folder_idx = cl.ancestor GROUP BY ALL""",
)
def _(t):
    regions = t("region").select("r_regionkey", "r_name")
    docs = t("supplier").withColumn("r_regionkey", F.col("s_suppkey") % 5).join(regions, "r_regionkey").select(
        F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 3).alias("users_idx"),
        F.concat("s_name", F.lit(" in nation_"), "s_nationkey", F.lit(" or "), "r_name").alias("text"),
    )
    long = t("documents").select(
        (F.col("doc_id") + 1_000_000).alias("doc_id"), (F.col("doc_id") % 3).alias("users_idx"),
        F.concat("text", F.lit(" supplier in europe, or nation_"), F.col("doc_id") % 25).alias("text"),
    )
    best = tr.best_matching_folder(docs.unionByName(long), t("folders"), _pairs(t))
    return best.withColumns({c: F.array_join(c, "/") for c in ("matched_names", "path")})


_PROPOSAL = """WITH RECURSIVE nodes AS (SELECT proposal_id, temp_id, min(parent_temp_id) AS parent_temp_id FROM {proposed} GROUP BY 1, 2),
  walk AS (SELECT proposal_id, temp_id, temp_id AS cur, 0 AS depth FROM nodes
    UNION ALL SELECT w.proposal_id, w.temp_id, p.temp_id, w.depth + 1 FROM walk w JOIN nodes n ON w.proposal_id = n.proposal_id AND w.cur = n.temp_id
      JOIN nodes p ON p.proposal_id = n.proposal_id AND p.temp_id = n.parent_temp_id WHERE w.depth < 30)"""


@query(
    "validate_proposal",
    "T9",
    _PROPOSAL
    + """, f AS (SELECT p.*, k.temp_id AS known, d.users_idx AS owner FROM {proposed} p LEFT JOIN nodes k ON p.proposal_id = k.proposal_id AND p.parent_temp_id = k.temp_id
         LEFT JOIN (SELECT folder_idx, users_idx FROM {folders} WHERE deleted_at IS NULL) d ON p.parent_folder_id = d.folder_idx),
      m AS (SELECT q.*, k.temp_id AS known, d.users_idx AS owner, x.users_idx AS file_owner FROM {mappings} q LEFT JOIN nodes k ON q.proposal_id = k.proposal_id AND q.target_temp_id = k.temp_id
         LEFT JOIN (SELECT folder_idx, users_idx FROM {folders} WHERE deleted_at IS NULL) d ON q.target_folder_id = d.folder_idx LEFT JOIN (SELECT file_idx, users_idx FROM {files} WHERE deleted_at IS NULL) x ON q.file_id = x.file_idx),
      r AS (SELECT proposal_id, 'blank_name' AS rule FROM f WHERE trim(name) = '' UNION ALL SELECT proposal_id, 'two_parents' FROM f WHERE parent_temp_id IS NOT NULL AND parent_folder_id IS NOT NULL
        UNION ALL SELECT proposal_id, 'unknown_parent' FROM f WHERE parent_temp_id IS NOT NULL AND known IS NULL
        UNION ALL SELECT proposal_id, 'foreign_parent_folder' FROM f WHERE parent_folder_id IS NOT NULL AND owner IS DISTINCT FROM proposal_id
        UNION ALL SELECT proposal_id, 'missing_file' FROM m WHERE file_id IS NULL UNION ALL SELECT proposal_id, 'foreign_file' FROM m WHERE file_id IS NOT NULL AND file_owner IS DISTINCT FROM proposal_id
        UNION ALL SELECT proposal_id, 'two_targets' FROM m WHERE target_folder_id IS NOT NULL AND target_temp_id IS NOT NULL
        UNION ALL SELECT proposal_id, 'unknown_target' FROM m WHERE target_temp_id IS NOT NULL AND known IS NULL
        UNION ALL SELECT proposal_id, 'foreign_target_folder' FROM m WHERE target_folder_id IS NOT NULL AND owner IS DISTINCT FROM proposal_id
        UNION ALL SELECT proposal_id, 'confidence_range' FROM m WHERE confidence > 1
        UNION ALL SELECT proposal_id, 'duplicate_temp_id' FROM {proposed} GROUP BY proposal_id, temp_id HAVING count(*) > 1
        UNION ALL SELECT proposal_id, 'duplicate_file' FROM {mappings} WHERE file_id IS NOT NULL GROUP BY proposal_id, file_id HAVING count(*) > 1
        UNION ALL SELECT DISTINCT ON (proposal_id, temp_id) proposal_id, 'cycle' FROM walk WHERE depth = 30)
      SELECT proposal_id, rule, count(*) AS detail FROM r GROUP BY ALL""",
)
def _(t):
    n = t.partitions("orders")
    dealt = DealtTables(t, {"orders": "o_custkey"}, n)
    owners = dealt("orders").select(F.col("o_custkey").alias("proposal_id"), F.col("o_custkey").alias("users_idx")).distinct()
    return tr.validate_proposal(dealt("proposed"), dealt("mappings"), owners, t("files"), t("folders"), n)


@query(
    "needed_new_folders",
    "T10",
    _PROPOSAL
    + """ SELECT DISTINCT w.proposal_id, w.cur AS temp_id FROM walk w JOIN {mappings} m ON m.proposal_id = w.proposal_id AND m.target_temp_id = w.temp_id""",
)
def _(t):
    n = t.partitions("orders")
    t = DealtTables(t, {"orders": "o_custkey"}, n)
    pairs = tr.proposal_closure(t("proposed"), n)
    return tr.needed_new_folders(t("proposed"), t("mappings"), pairs, n).select("proposal_id", "temp_id").distinct()


@query(
    "apply_mappings",
    "T11",
    """WITH m AS (SELECT proposal_id, o.file_idx AS file_id, target_folder_id, target_temp_id, new_name FROM {mappings} q JOIN {files} o ON q.file_id = o.file_idx AND q.confidence BETWEEN 0.1 AND 1.0)
      SELECT f.file_idx, CASE WHEN m.file_id IS NULL THEN f.folder_idx WHEN target_temp_id IS NOT NULL THEN CASE WHEN target_temp_id <> 'none' THEN 200000000 + f.file_idx END ELSE target_folder_id END AS folder_idx,
        coalesce(nullif(left(trim(new_name), 9), ''), f.name) AS name FROM {files} f LEFT JOIN m ON f.file_idx = m.file_id""",
)
def _(t):
    kept = t("mappings").where("confidence BETWEEN 0.1 AND 1.0")
    created = t("orders").select(
        F.col("o_custkey").alias("proposal_id"), F.concat(F.lit("t"), "o_orderkey").alias("temp_id"),
        (F.col("o_orderkey") + 200_000_000).alias("folder_idx"),
    )
    return tr.apply_mappings(t("files"), kept, created, max_name=9).select("file_idx", "folder_idx", "name")


@query(
    "creation_waves",
    "T12",
    _PROPOSAL
    + """, bad AS (SELECT DISTINCT proposal_id, temp_id FROM walk WHERE depth = 30)
      SELECT proposal_id, temp_id, max(depth) AS wave FROM walk WHERE (proposal_id, temp_id) NOT IN (SELECT proposal_id, temp_id FROM bad) GROUP BY 1, 2""",
)
def _(t):
    return tr.creation_waves(t("proposed"))


@query(
    "filter_proposal",
    "T13",
    """SELECT m.proposal_id, m.file_id, CAST(NULL AS VARCHAR) AS new_name, m.target_folder_id FROM {mappings} m WHERE m.file_id IN (SELECT file_idx FROM {files} WHERE star AND users_idx = m.proposal_id)""",
)
def _(t):
    targets = t("files").where("star").select(F.col("users_idx").alias("proposal_id"), F.col("file_idx").alias("file_id"))
    out = tr.filter_proposal(t("mappings"), targets, allow_rename=False)
    return out.select("proposal_id", "file_id", "new_name", "target_folder_id")


@query(
    "restore_files",
    "T14",
    """WITH h AS (SELECT f.*, f.deleted_at IS NOT NULL AND f.star AS hit, d.folder_idx IS NOT NULL AS live, (SELECT count(*) FROM {chunks} c WHERE c.file_idx = f.file_idx) AS n
        FROM {files} f LEFT JOIN {folders} d ON f.folder_idx = d.folder_idx AND d.deleted_at IS NULL)
      SELECT file_idx, CASE WHEN hit AND NOT live THEN NULL ELSE folder_idx END AS folder_idx, CASE WHEN hit THEN NULL ELSE deleted_at END AS deleted_at,
        CASE WHEN hit AND n > 0 THEN 'READY' WHEN hit THEN 'UPLOADED' ELSE status END AS status FROM h""",
)
def _(t):
    restored, _again = tr.restore_files(t("files"), t("folders"), t("chunks"), t("files").where("star"))
    return restored.select("file_idx", "folder_idx", "deleted_at", "status")


@query(
    "shape_tree_paths",
    "U11",
    """WITH o AS (SELECT folder_idx, parent_folder_idx, row_number() OVER (PARTITION BY parent_folder_idx ORDER BY folder_idx) AS n FROM {folders})
      SELECT a.folder_idx AS shape_id, concat_ws('.', c.n, b.n, a.n) AS shape_path, 1 + (b.n IS NOT NULL)::INT + (c.n IS NOT NULL)::INT AS shape_depth
      FROM o a LEFT JOIN o b ON a.parent_folder_idx = b.folder_idx LEFT JOIN o c ON b.parent_folder_idx = c.folder_idx""",
)
def _(t):
    shapes = t.sql(
        """SELECT 1 AS slide, folder_idx AS shape_id, parent_folder_idx AS parent_id,
           row_number() OVER (PARTITION BY parent_folder_idx ORDER BY folder_idx) AS ordinal FROM {folders}"""
    )
    return tr.shape_tree_paths(shapes, ["slide"]).drop("slide")


_CLAIM = f"""(job_status = 'PENDING' OR (job_status = 'RETRY_WAIT' AND next_attempt_at <= {NOW})
  OR (job_status = 'RUNNING' AND ownership_expires_at < {NOW} AND attempts < max_attempts))"""


@query("claimable_jobs", "J1", f"SELECT job_idx, priority FROM {{jobs}} WHERE {_CLAIM}")
def _(t):
    return tk.claimable_jobs(t("jobs"), _now()).select("job_idx", "priority")


@query(
    "lapsed_jobs",
    "J2",
    f"""SELECT job_idx, 'exhausted' AS kind FROM {{jobs}} WHERE job_status = 'RUNNING' AND ownership_expires_at < {NOW} AND attempts >= max_attempts
      UNION ALL SELECT job_idx, 'timed_out' FROM {{jobs}} WHERE job_status = 'WAITING_CALLBACK' AND ownership_expires_at < {NOW}""",
)
def _(t):
    a = tk.expired_exhausted(t("jobs"), _now()).select("job_idx", F.lit("exhausted").alias("kind"))
    return a.unionByName(tk.timed_out_callbacks(t("jobs"), _now()).select("job_idx", F.lit("timed_out").alias("kind")))


@query(
    "reconcile_callbacks",
    "J3",
    f"""SELECT job_idx, j.file_idx, CASE WHEN f.status = 'READY' THEN 'SUCCESS' WHEN attempts >= max_attempts THEN 'FAILED' ELSE 'RETRY_WAIT' END AS job_status,
      CASE WHEN f.status = 'READY' OR attempts >= max_attempts THEN {NOW} END AS finished_at,
      CASE WHEN f.status IS DISTINCT FROM 'READY' AND attempts < max_attempts THEN {NOW} + INTERVAL 30 SECOND END AS next_attempt_at,
      CASE WHEN f.status <> 'READY' AND attempts >= max_attempts THEN 'FAILED' END AS file_status
      FROM {{jobs}} j LEFT JOIN {{files}} f ON j.file_idx = f.file_idx WHERE job_status = 'WAITING_CALLBACK' AND ownership_expires_at < {NOW}""",
)
def _(t):
    return tk.reconcile_callbacks(t("jobs"), t("files"), _now(), 30_000)


@query(
    "failure_transition",
    "J4",
    f"""SELECT job_idx, CASE WHEN attempts >= max_attempts THEN 'FAILED' ELSE 'RETRY_WAIT' END AS job_status,
      CASE WHEN attempts < max_attempts THEN {NOW} + to_seconds(30 * attempts) END AS next_attempt_at,
      CASE WHEN attempts >= max_attempts THEN {NOW} END AS finished_at, CASE WHEN attempts >= max_attempts THEN 'FAILED' END AS file_status FROM {{jobs}} WHERE job_status = 'RUNNING'""",
)
def _(t):
    return tk.failure_transition(t("jobs").where("job_status = 'RUNNING'"), _now(), 30_000)


@query(
    "expired_claims",
    "J5",
    f"""SELECT task_idx, file_idx, attempts, http_status, CASE WHEN lapsed AND attempts < 5 THEN 'PENDING' WHEN lapsed OR (status = 'PENDING' AND attempts >= 5) THEN 'FAILED' ELSE status END AS status,
      CASE WHEN lapsed AND attempts < 5 THEN {NOW} WHEN lapsed OR (status = 'PENDING' AND attempts >= 5) THEN NULL ELSE next_attempt_at END AS next_attempt_at
      FROM (SELECT *, coalesce(status = 'PROCESSING' AND next_attempt_at <= {NOW}, FALSE) AS lapsed FROM {{tasks}})""",
)
def _(t):
    return tk.expired_claims(t("tasks"), _now(), 5)


@query(
    "exponential_backoff",
    "J6 J7",
    """SELECT task_idx, CASE attempts WHEN 1 THEN 60000 WHEN 5 THEN 960000 ELSE 3600000 END::BIGINT AS wait_ms, http_status IN (408, 503) AS retryable,
      CASE WHEN http_status IN (200, 404) THEN 'done' WHEN http_status = 410 THEN 'fail' ELSE 'retry' END AS outcome FROM {tasks}""",
)
def _(t):
    status = F.col("http_status")
    return t("tasks").select(
        "task_idx", tk.exponential_backoff_ms(F.col("attempts"), 60_000).alias("wait_ms"),
        tk.is_retryable(status).alias("retryable"), tk.call_outcome(status, 404).alias("outcome"),
    )


@query(
    "stale_uploads",
    "J8",
    f"""SELECT u.uploads_idx, count(f.file_idx) AS orphan_files, 'FAILED' AS status, {NOW} AS finished_at FROM {{uploads}} u LEFT JOIN {{files}} f ON u.uploads_idx = f.uploads_idx
      WHERE u.status = 'UPLOADING' AND u.created_at < {NOW} - INTERVAL 15 MINUTE GROUP BY 1""",
)
def _(t):
    return tk.stale_uploads(t("uploads"), t("files"), _now())


@query(
    "stale_generating",
    "J9",
    f"""SELECT file_idx, CASE WHEN extraction_status = 'GENERATING' AND updated_at < {NOW} - INTERVAL 10 DAY THEN 'PROCESSING' ELSE extraction_status END AS extraction_status,
      CASE WHEN extraction_status = 'GENERATING' AND updated_at < {NOW} - INTERVAL 10 DAY THEN {NOW} ELSE updated_at END AS updated_at FROM {{file_metadata}}""",
)
def _(t):
    threshold = _now() - F.expr("INTERVAL 10 DAY")
    return tk.reset_stale_generating(t("file_metadata"), threshold, _now()).select("file_idx", "extraction_status", "updated_at")


@query("pending_skipped", "J9", _PENDING)
def _(t):
    return tk.pending_skipped(t("file_metadata"), t("files")).select("file_idx")


@query(
    "due_tasks",
    "J10",
    f"SELECT task_idx, next_attempt_at FROM {{tasks}} WHERE status = 'PENDING' AND next_attempt_at <= {NOW} ORDER BY next_attempt_at, task_idx LIMIT 50",
)
def _(t):
    return tk.due_tasks(t("tasks"), _now()).select("task_idx", "next_attempt_at")
