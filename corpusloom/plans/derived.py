"""Domain tables derived from the input tables, in SQL that both engines read.

``{name}`` stands for an input table or another derived table.
"""

DERIVED: dict[str, str] = {}

# Documents with the defects that text cleaning repairs.
DERIVED["noisy"] = """
SELECT doc_id, concat('  ', replace(replace(replace(replace(text,
         ', ', concat(',  ', chr(9), ' ')),
         '. ', concat(' . ', chr(13), chr(10), ' ', chr(13), chr(10), chr(13), chr(10), '  ( ')),
         'ing ', concat('i-', chr(10), 'ng ')),
         ' th', ' ​th�'), chr(9), ' ') AS body
FROM {documents}
"""

# Files as bytes with the media type their upload declared.
DERIVED["raw_files"] = """
SELECT doc_id,
       CASE lang WHEN 'de' THEN concat('%PDF-1.7', chr(10), text)
                 WHEN 'fr' THEN concat('PK', chr(3), chr(4), text)
                 WHEN 'es' THEN concat(chr(1), replace(text, 'a', chr(2)))
                 ELSE text END AS raw,
       CASE WHEN n_chars > 4000 THEN 'application/octet-stream'
            WHEN lang = 'de' THEN 'Application/PDF; charset=binary'
            WHEN n_chars > 3000 THEN 'image/png'
            WHEN n_chars > 2000 THEN ' '
            WHEN lang = 'fr' THEN 'application/pdf'
            ELSE 'text/plain; charset=utf-8' END AS declared
FROM {documents}
"""

# Service log lines holding each kind of secret.
DERIVED["log_lines"] = """
SELECT event_id AS line_id, ts, user_id,
  CASE event_type
    WHEN 'click' THEN concat('GET https://files.example.com/a/', event_id, '?x=1&X-Amz-Signature=', user_id, 'abc&y=2 done')
    WHEN 'view' THEN concat(chr(27), '[31mconnect mysql+pymysql://root:pw', user_id, '@db:3306/x ok', chr(27), '[0m')
    WHEN 'signup' THEN concat('login password="p w', user_id, '" api_key: k', event_id, ', db_host=''h ', user_id, ''' ok')
    WHEN 'purchase' THEN concat('Authorization: Bearer abc.', user_id, ' then bearer zz', event_id, chr(10), chr(9), 'end')
    ELSE concat('error ', props, ' /cb?token=', user_id, '&page=2 CUDA out of memory or Connection refused')
  END AS value
FROM {events}
"""

# Stage log lines in JSON, with lines that must be skipped.
DERIVED["stage_log"] = """
SELECT event_id AS line_id, ts,
  CASE event_type
    WHEN 'click' THEN concat('{"event":"file_download_completed","file_idx":', user_id, ',"duration_ms":', value, ',"file_type":"pdf","stage":"download","timestamp":"', CAST(ts AS STRING), '"}')
    WHEN 'view' THEN concat('{"event":"document_chunking_completed","file_idx":', user_id, ',"total_duration_ms":', value, ',"chunk_count":', event_id, '}')
    WHEN 'signup' THEN concat('{"event":"file_processing_completed","file_idx":', user_id, ',"duration_ms":', value, ',"stage":"","file_type":7}')
    WHEN 'purchase' THEN concat('{"event":"request_completed","file_idx":', user_id, ',"duration_ms":', value, '}')
    ELSE concat('plain text line ', event_id)
  END AS line
FROM {events}
"""

# Spreadsheet cells: status, a formula with or without a cached value, and a far column.
DERIVED["cells"] = """
SELECT o_custkey AS doc_id, o_orderkey AS row, 2 AS col, o_orderstatus AS value,
       CAST(NULL AS STRING) AS cached, FALSE AS is_formula FROM {orders}
UNION ALL
SELECT o_custkey, o_orderkey, 4, '=SUM(A1:B2)',
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_totalprice AS STRING) END, TRUE FROM {orders}
UNION ALL
SELECT o_custkey, o_orderkey, 30, CASE WHEN o_orderstatus = 'P' THEN concat(' ', o_orderpriority, chr(10), 'x ') END,
       NULL, FALSE FROM {orders}
"""

DERIVED["row_ranges"] = """
SELECT s_nationkey AS doc_id, s_name AS name, s_suppkey AS ordinal, s_suppkey AS min_row,
       s_suppkey + s_nationkey AS max_row FROM {supplier}
"""

# Document blocks in order, with headings and section breaks.
DERIVED["blocks"] = """
SELECT o_custkey AS doc_id, o_orderkey AS block_index, o_orderstatus = 'P' AS ends_section,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'heading' ELSE 'paragraph' END AS unit_type,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 100000 THEN ' '
            ELSE concat(' T', o_orderkey, ' ') END AS text,
       CASE WHEN o_orderstatus = 'O' THEN 2 WHEN o_orderstatus = 'F' THEN 0 END AS heading_level
FROM {orders}
"""

# Unit metadata of every file type, as an open JSON map.
DERIVED["unit_meta"] = """
SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS unit_index, l_extendedprice,
  CASE WHEN l_returnflag = 'R' THEN 'txt' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'pdf'
       WHEN l_returnflag = 'A' THEN 'docx' WHEN l_linestatus = 'O' THEN 'pptx' ELSE 'xlsx' END AS file_type,
  l_linenumber - 2 AS page_number, l_linenumber - 3 AS slide_number, l_linenumber - 1 AS section_index,
  l_linenumber - 4 AS block_index, l_linenumber AS line_number,
  CASE WHEN l_quantity > 25 THEN ' 1.2 ' WHEN l_quantity > 20 THEN ' ' END AS shape_path,
  CASE WHEN l_quantity > 10 THEN 'shape' END AS unit_type,
  CASE WHEN l_quantity > 30 THEN 'Sheet1' END AS sheet_name,
  CASE WHEN l_quantity > 40 THEN 'A1:B2' END AS cell_range,
  concat('{"page_number":', CASE WHEN l_quantity < 5 THEN 'true' WHEN l_quantity < 10 THEN '"3"' WHEN l_quantity < 15 THEN '2.5' ELSE CAST(l_linenumber - 2 AS STRING) END,
    CASE WHEN l_quantity > 45 THEN ',"page":9' ELSE '' END,
    CASE WHEN l_tax > 0.05 THEN concat(',"slide_number":', l_linenumber - 1) ELSE '' END,
    CASE WHEN l_discount > 0.05 THEN ',"sheet_name":" S 1 ","sheet_index":0' ELSE '' END,
    CASE WHEN l_quantity > 20 THEN ',"shape_path":"1.2"' ELSE '' END,
    CASE WHEN l_quantity > 30 THEN ',"content_origin":"ocr"' ELSE '' END,
    CASE WHEN l_discount > 0.03 THEN concat(',"image_index":', l_linenumber) ELSE '' END,
    ',"line_start_number":', l_linenumber + 3, ',"line_end":', CAST(l_quantity AS INT),
    ',"location_kind":"', CASE WHEN l_tax > 0.04 THEN 'pptx_shape' ELSE 'elsewhere' END,
    '","ocr_mean_confidence":', l_discount, ',"section_index":', l_linenumber - 1, '}') AS meta_json
FROM {lineitem}
"""

# Recognised text lines of images; an image is an order, its page the line number.
DERIVED["image_lines"] = """
SELECT l_orderkey AS doc_id, l_linenumber AS image_id, l_partkey * 100000 + l_suppkey AS ordinal,
       concat(l_returnflag, ' ', l_quantity, ' ', l_linestatus) AS text, l_quantity / 50.0E0 AS confidence
FROM {lineitem}
"""

# Image candidates of each customer's documents.
DERIVED["images"] = """
SELECT o_custkey AS doc_id, o_orderkey AS ordinal, CAST(floor(o_totalprice / 4) AS BIGINT) AS n_bytes,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 40 ELSE 640 END AS width,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 20 ELSE 480 END AS height,
  concat(o_orderstatus, CAST(floor(o_totalprice / 50000) AS BIGINT)) AS sha256
FROM {orders}
"""

# Indexed points: a vector is a chunk, its label is the file it belongs to.
DERIVED["points"] = """
SELECT vec_id AS chunk_id, CASE WHEN label = 9 THEN 2 ELSE 1 END AS users_idx, label AS file_idx,
       vec_id % 11 <> 3 AS is_active, embedding FROM {embeddings}
"""

# Search hits: the turns of a conversation in order, roles as files.
DERIVED["hits"] = """
SELECT conv_id AS request_id, turn + 1 AS rank, conv_id * 1000 + turn AS chunk_id,
       CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS file_idx,
       CASE WHEN turn = 5 THEN 0.9E0 ELSE 1.0E0 / (turn + 1) END AS score, concat(text, ' ') AS content
FROM {conversations}
"""

# Answers with inline citations, some declared, some of unknown sources.
DERIVED["answers"] = """
SELECT conv_id * 100 + turn AS request_id, conv_id, turn,
       concat(replace(text, '. ', ' [SOURCE-2]. '), ' [SOURCE-', turn, '] end') AS answer,
       CASE turn WHEN 1 THEN 'SOURCE-2,SOURCE-1' WHEN 3 THEN 'SOURCE-3' END AS declared,
       CASE WHEN turn = 5 THEN ' INSUFFICIENT_evidence' WHEN turn = 7 THEN 'maybe' ELSE 'Answered ' END AS status
FROM {conversations} WHERE role = 'assistant'
"""

DERIVED["prompt_sources"] = """
SELECT request_id, 'SOURCE-1' AS source_id, request_id * 10 + 1 AS chunk_id, 1 AS file_idx FROM {answers}
UNION ALL SELECT request_id, 'SOURCE-2', request_id * 10 + 2, 2 FROM {answers}
UNION ALL SELECT request_id, 'SOURCE-3', request_id * 10 + 3, 3 FROM {answers}
UNION ALL SELECT request_id, CASE WHEN turn = 7 THEN 'SOURCE-1' ELSE 'SOURCE-4' END, request_id * 10 + 4, 1 FROM {answers}
"""

# Generation calls of a request with what they asked for and used.
DERIVED["calls"] = """
SELECT conv_id AS request_id, turn AS call_index, length(text) * 100 AS estimated_input,
       CASE WHEN role = 'user' THEN NULL ELSE 9000 END AS requested_output,
       length(text) * 90 AS input_tokens, length(text) * 5 AS output_tokens
FROM {conversations}
"""

# The file catalog: an order is a file of its customer, in one of the customer's folders.
DERIVED["files"] = """
SELECT o_orderkey AS file_idx, o_custkey AS users_idx,
  CASE WHEN o_totalprice < 60000 THEN NULL WHEN o_totalprice < 300000 THEN 1000 + o_custkey ELSE 100000000 + o_custkey END AS folder_idx,
  CAST(floor(o_orderkey / 3) AS BIGINT) AS uploads_idx,
  concat('Order_', o_orderkey, '%', o_orderpriority, CASE o_orderstatus WHEN 'P' THEN '.PDF' WHEN 'F' THEN '.docx' ELSE '.txt' END) AS name,
  CASE o_orderstatus WHEN 'P' THEN 'pdf' WHEN 'F' THEN 'docx' ELSE 'txt' END AS file_type,
  CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'UPLOADED' WHEN '2-HIGH' THEN 'PROCESSING' WHEN '5-LOW' THEN 'FAILED' ELSE 'READY' END AS status,
  o_orderpriority = '3-MEDIUM' AS star, o_orderdate AS created_at,
  CASE WHEN o_totalprice > 420000 THEN o_orderdate + INTERVAL 90 DAY WHEN o_totalprice > 400000 THEN TIMESTAMP_NTZ '2001-01-01 00:00:00' END AS deleted_at
FROM {orders}
"""

# The chunks of the files: one per order line.
DERIVED["chunks"] = """
SELECT concat(l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey) AS chunk_id, l_orderkey AS file_idx, o_custkey AS users_idx,
       l_linenumber AS chunk_index, CAST(l_quantity AS INT) AS index_version, concat('Part ', l_partkey, ' of ', l_suppkey) AS content
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# Three levels of folders: regions, nations, customers. Some are in the trash.
DERIVED["folders"] = """
SELECT CAST(r_regionkey + 1 AS BIGINT) AS folder_idx, CAST(NULL AS BIGINT) AS parent_folder_idx, r_name AS name,
       CAST(0 AS BIGINT) AS users_idx, CAST(NULL AS TIMESTAMP_NTZ) AS deleted_at FROM {region}
UNION ALL
SELECT n_nationkey + 100, n_regionkey + 1, n_name, 0,
       CASE n_nationkey WHEN 3 THEN TIMESTAMP_NTZ '2001-01-01 00:00:00' WHEN 5 THEN TIMESTAMP_NTZ '2002-01-01 00:00:00' END FROM {nation}
UNION ALL
SELECT c_custkey + 1000, c_nationkey + 100, c_name, c_custkey,
       CASE WHEN c_acctbal < 0 OR c_nationkey = 3 THEN TIMESTAMP_NTZ '2001-01-01 00:00:00' END FROM {customer}
"""

DERIVED["users"] = """
SELECT c_custkey AS users_idx, c_name AS name, c_acctbal AS created_at FROM {customer}
"""

DERIVED["file_metadata"] = """
SELECT o_orderkey AS file_idx, CASE WHEN o_totalprice < 250000 THEN concat('About ', o_orderpriority) END AS summary,
  CASE o_orderpriority WHEN '1-URGENT' THEN '["report","ta"]' WHEN '2-HIGH' THEN '["tag"]' WHEN '3-MEDIUM' THEN '["oops' WHEN '5-LOW' THEN '{"a":1}' END AS tags,
  CASE o_orderstatus WHEN 'P' THEN '["Alpha","beta"]' END AS keywords,
  CASE o_orderstatus WHEN 'P' THEN '{"dates":["2001"],"project":"x"}' WHEN 'F' THEN 'bad' END AS entities,
  CASE WHEN o_totalprice < 100000 THEN 'contract' WHEN o_totalprice < 200000 THEN '' ELSE 'invoice' END AS document_type,
  CASE o_orderstatus WHEN 'P' THEN 'PROCESSING' WHEN 'F' THEN 'GENERATING' ELSE 'READY' END AS extraction_status,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(floor(o_totalprice / 100000) AS INT) END AS index_version,
  o_orderdate AS updated_at
FROM {orders}
"""

DERIVED["jobs"] = """
SELECT o_orderkey AS job_idx, CAST(floor(o_orderkey / 2) AS BIGINT) AS file_idx,
  CASE WHEN o_totalprice < 200000 THEN 'INGEST' ELSE 'METADATA' END AS job_type,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice < 200000 THEN 'PENDING' ELSE 'RETRY_WAIT' END
       WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice < 200000 THEN 'RUNNING' ELSE 'WAITING_CALLBACK' END
       ELSE CASE WHEN o_totalprice < 200000 THEN 'SUCCESS' WHEN o_totalprice < 450000 THEN 'FAILED' ELSE 'LOST' END END AS job_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 9 WHEN '2-HIGH' THEN 5 ELSE 1 END AS priority,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 ELSE 0 END AS attempts,
  3 AS max_attempts, o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS next_attempt_at,
  CASE WHEN o_totalprice > 50000 THEN o_orderdate + INTERVAL 2 DAY END AS ownership_expires_at
FROM {orders}
"""

DERIVED["tasks"] = """
SELECT o_orderkey AS task_idx, o_orderkey AS file_idx,
  CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'PROCESSING' ELSE 'DONE' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 5 ELSE 8 END AS attempts,
  CASE WHEN o_totalprice > 20000 THEN o_orderdate END AS next_attempt_at,
  CASE WHEN o_totalprice < 100000 THEN 408 WHEN o_totalprice < 200000 THEN 503 WHEN o_totalprice < 300000 THEN 404 WHEN o_totalprice < 400000 THEN 200 ELSE 410 END AS http_status
FROM {orders}
"""

DERIVED["uploads"] = """
SELECT CAST(floor(o_orderkey / 3) AS BIGINT) AS uploads_idx, max(o_custkey) AS users_idx, max(o_orderdate) AS created_at,
  CASE WHEN max(o_totalprice) > 300000 THEN 'UPLOADING' ELSE 'SUCCESS' END AS status
FROM {orders} GROUP BY CAST(floor(o_orderkey / 3) AS BIGINT)
"""

DERIVED["upload_batches"] = """
SELECT o_custkey AS users_idx, o_orderkey AS arrival, CAST(floor(o_totalprice) AS BIGINT) AS incoming_bytes,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS idempotency_key
FROM {orders}
"""

DERIVED["sanctions"] = """
SELECT o_orderkey AS sanction_idx, o_custkey AS users_idx, o_orderdate AS started_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'TEMP_SUSPEND' WHEN '2-HIGH' THEN 'PERMANENT_SUSPEND' WHEN '3-MEDIUM' THEN 'ACCOUNT_DELETE' ELSE 'WARNING' END AS sanction_type,
  CASE WHEN o_orderstatus = 'F' THEN 'RELEASED' ELSE 'ACTIVE' END AS status
FROM {orders}
"""

# Reorganisation proposals: new folders in chains, some of them circular or broken.
DERIVED["proposed"] = """
SELECT proposal_id, temp_id, name, CASE WHEN prev IS NOT NULL THEN concat('t', prev) WHEN loops THEN concat('t', final_key) END AS parent_temp_id, parent_folder_id
FROM (SELECT o_custkey AS proposal_id, CASE WHEN o_totalprice > 490000 THEN 'dup' ELSE concat('t', o_orderkey) END AS temp_id,
  CASE WHEN o_totalprice < 20000 THEN ' ' ELSE concat('Folder ', o_orderkey) END AS name,
  lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS prev,
  max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS final_key, o_totalprice BETWEEN 100000 AND 130000 AS loops,
  CASE WHEN o_totalprice > 480000 THEN 1000 + o_custkey WHEN o_totalprice > 470000 THEN 1001 + o_custkey END AS parent_folder_id
  FROM {orders}) p
"""

DERIVED["mappings"] = """
SELECT o_custkey AS proposal_id,
  CASE WHEN o_totalprice < 3000 THEN NULL WHEN o_totalprice < 20000 THEN o_orderkey + 1
       WHEN o_totalprice < 30000 THEN min(o_orderkey) OVER (PARTITION BY o_custkey) ELSE o_orderkey END AS file_id,
  CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN CASE WHEN o_totalprice > 450000 THEN 1001 + o_custkey ELSE 1000 + o_custkey END
       WHEN o_totalprice > 460000 THEN 1000 + o_custkey END AS target_folder_id,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN concat('t', o_orderkey) WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 200000 THEN 'none' END AS target_temp_id,
  CASE o_orderstatus WHEN 'P' THEN '  ' WHEN 'F' THEN concat(' new ', o_orderkey, ' ') END AS new_name,
  o_totalprice / 400000.0E0 AS confidence
FROM {orders}
"""

# Index documents: several versions per (user, file), with their runs and chunks.
DERIVED["index_documents"] = """
SELECT o_orderkey AS rag_document_idx, o_custkey AS users_idx, o_custkey * 10 + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '2-HIGH' THEN 2 ELSE 3 END AS file_idx,
  md5(concat('h', o_orderpriority)) AS file_hash, '1.0' AS parser_version, 'm64' AS embedding_model, CAST(floor(o_totalprice / 100000) AS INT) AS index_version,
  CASE o_orderstatus WHEN 'P' THEN 'INDEXING' ELSE 'INDEXED' END AS index_status, concat('f', o_orderkey) AS file_name, 4 AS chunk_count,
  CASE WHEN o_totalprice > 450000 THEN TIMESTAMP_NTZ '2001-01-01 00:00:00' END AS deleted_at
FROM {orders}
"""

DERIVED["index_runs"] = """
SELECT l_orderkey * 10 + l_linenumber AS run_id, l_orderkey AS rag_document_idx, max(users_idx) AS users_idx, max(file_idx) AS file_idx,
  CASE max(l_returnflag) WHEN 'A' THEN 'SUCCESS' WHEN 'N' THEN 'RUNNING' ELSE CASE WHEN max(l_quantity) > 40 THEN 'SUCCESS' ELSE 'RUNNING' END END AS status
FROM {lineitem} JOIN {index_documents} ON l_orderkey = rag_document_idx GROUP BY l_orderkey, l_linenumber
"""

DERIVED["index_chunks"] = """
SELECT concat(l_orderkey, ':', l_partkey) AS chunk_id, l_orderkey AS rag_document_idx, CASE WHEN l_tax > 0.06 THEN 99 ELSE index_version END AS index_version,
  l_linenumber - 1 AS chunk_index, concat('Part ', l_partkey) AS content
FROM {lineitem} JOIN {index_documents} ON l_orderkey = rag_document_idx
"""

# Requests of a load run: one per event, the value as its duration.
DERIVED["records"] = """
SELECT event_id AS request_id, event_id AS request_index, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'search' ELSE 'ingest' END AS operation,
  CASE WHEN value > 80 THEN 'warmup' ELSE 'concurrency' END AS phase, CAST(floor(user_id / 10) + 1 AS INT) AS concurrency,
  concat('soak-window-', EXTRACT(DAY FROM ts)) AS case_id, concat('stage-', EXTRACT(DAY FROM ts)) AS stage_id,
  EPOCH_US(ts) / 1.0E6 AS started_epoch, EPOCH_US(ts) / 1.0E6 + value / 1.0E3 AS completed_epoch, value AS duration_ms,
  NOT ((event_type = 'error' AND value > 20) OR (event_type = 'signup' AND value > 60)) AS success,
  CASE WHEN value > 20 THEN 500 ELSE 200 END AS status_code, event_id AS request_bytes, user_id AS response_bytes,
  CASE WHEN event_type <> 'view' THEN event_id END AS input_tokens, CASE WHEN event_type = 'click' THEN user_id END AS output_tokens,
  CASE WHEN event_type = 'error' AND value > 60 THEN 'ReadTimeout' WHEN event_type = 'error' AND value > 40 THEN NULL WHEN event_type = 'error' THEN 'ConnectError'
       WHEN event_type = 'signup' AND value > 90 THEN 'RuntimeError' WHEN event_type = 'signup' THEN 'Other' END AS error_type,
  CASE WHEN event_type = 'signup' THEN 'CUDA OOM, no memory' END AS error_message,
  CASE WHEN event_type = 'signup' THEN 'pdf' END AS file_type, CASE WHEN user_id < 50 THEN 'text' WHEN user_id < 100 THEN 'ocr' END AS content_origin,
  CAST(floor(value * 1000) AS BIGINT) AS fixture_size_bytes, CAST(floor(value) AS BIGINT) AS declared_text_units,
  CASE WHEN event_type = 'signup' THEN user_id END AS declared_image_count, user_id * 3 AS chunk_count
FROM {events}
"""

# Resource samples, one per event.
DERIVED["samples"] = """
SELECT event_id, ts, EPOCH_US(ts) AS at_us, EPOCH_US(ts) / 1.0E6 AS epoch, concat('soak-window-', EXTRACT(DAY FROM ts)) AS case_id,
  CASE WHEN event_type = 'purchase' THEN 'idle' ELSE event_type END AS operation, 'concurrency' AS phase, CAST(floor(user_id / 50) AS INT) AS concurrency,
  CASE WHEN event_type <> 'view' THEN value / 5.0E0 END AS system_memory_percent, value / 8.0E0 AS gpu_memory_percent,
  event_id * 1000 AS target_rss_bytes, CASE WHEN value > 10 THEN event_id * 10 END AS target_gpu_bytes, user_id AS threads, user_id * 2 AS handles,
  value AS system_cpu_percent, event_id AS system_memory_used_bytes, value / 2 AS target_cpu_percent, user_id * 7 AS target_private_bytes,
  value / 4 AS gpu_utilization_percent, event_id * 3 AS gpu_memory_used_bytes, CASE WHEN value > 1000 THEN value END AS embedder_cpu_percent,
  user_id AS embedder_memory_used_bytes, value / 16 AS store_cpu_percent, event_id + user_id AS store_memory_used_bytes
FROM {events}
"""

# Load stages: one per day.
DERIVED["stages"] = """
SELECT concat('stage-', day) AS stage_id, day AS sequence, CASE WHEN day <= 20 THEN 'ramp' WHEN day = 30 THEN 'idle' ELSE 'burst' END AS mode,
  CASE WHEN day <= 10 OR day > 25 THEN 'search' ELSE 'ingest' END AS operation, day AS concurrency, n AS submitted, start_us, end_us
FROM (SELECT CAST(EXTRACT(DAY FROM ts) AS INT) AS day, count(*) AS n, min(EPOCH_US(ts)) AS start_us, max(EPOCH_US(ts)) AS end_us FROM {events} GROUP BY CAST(EXTRACT(DAY FROM ts) AS INT)) d
"""

# Stage events as time spans that overlap each other.
DERIVED["stage_spans"] = """
SELECT event_id, user_id AS file_idx, event_type AS stage, EPOCH_US(ts) - CAST(floor(value * 100000000) AS BIGINT) AS start_us, EPOCH_US(ts) AS end_us FROM {events}
"""

DERIVED["cpu_times"] = """
SELECT event_type AS target, CAST(floor(EPOCH_US(ts) / 3.6E9) AS BIGINT) AS sampled_at, user_id AS pid, max(value) AS cpu_time FROM {events} GROUP BY 1, 2, 3
"""

# Hand-offs (clicks) and completions (the event right after, when it is a view).
DERIVED["callback_events"] = """
SELECT CASE WHEN event_type = 'click' THEN event_id ELSE event_id - 1 END AS job_id, CASE WHEN event_type = 'click' THEN 'handoff' ELSE 'completed' END AS kind, ts
FROM {events} WHERE event_type IN ('click', 'view')
"""

# Requests with an idempotency key that is sometimes blank.
DERIVED["apply_requests"] = """
SELECT event_id, EPOCH_US(ts) AS at_us, CAST(floor(user_id / 10) AS BIGINT) AS user_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN ' ' ELSE event_type END AS idempotency_key FROM {events}
"""
