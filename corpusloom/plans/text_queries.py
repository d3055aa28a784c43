"""Text normalisation, format checks, truncation and redaction over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import binary, redact, text
from corpusloom.plans.registry import query

# SQL twins shared by several checks below.
_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(B, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(0), ''),
  '[@WSI@]+\n', chr(10), 'g'), '[@WSI@]+$', ''), '\n\n\n+', chr(10)||chr(10), 'g'),
  '^[@WS@]+|[@WS@]+$', '', 'g')"""


@query(
    "normalize_text",
    "N1 S1",
    "SELECT doc_id, " + _NORM.replace("B", "body") + " AS clean FROM {noisy}",
)
def _(t):
    return t("noisy").select("doc_id", text.normalize_text(F.col("body")).alias("clean"))


@query(
    "normalize_inline_text",
    "N2",
    "SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array("
    + _NORM.replace("B", "body")
    + r", '[@LB@]'), lambda x: regexp_replace(x, '^[@WS@]+|[@WS@]+$', '', 'g')), lambda x: x <> ''), ' ') AS inline FROM {noisy}",
)
def _(t):
    return t("noisy").select("doc_id", text.normalize_inline_text(F.col("body")).alias("inline"))


_NOISY_SQL = r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(
    replace(replace(replace(body, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '),
    '[\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g'), '\x{FFFD}+', '', 'g') AS s FROM {noisy}),
b AS (SELECT doc_id, regexp_replace(s, '([0-9A-Za-z가-힣])-\n([0-9A-Za-z가-힣])', '\1\2', 'g') AS s FROM a),
c AS (SELECT doc_id, array_to_string(list_transform(string_split(s, chr(10)), lambda l:
    regexp_replace(regexp_replace(trim(regexp_replace(l, '[@WSI@]+', ' ', 'g')),
      '\s+([,.;:!?%)\]}])', '\1', 'g'), '([(\[{])\s+', '\1', 'g')), chr(10)) AS s FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(s, '\n\n\n+', chr(10)||chr(10), 'g'), '^[@WS@]+|[@WS@]+$', '', 'g') AS s FROM c)
SELECT doc_id, CASE WHEN length(s) <= 5000 THEN s ELSE regexp_replace(left(s, 5000), '[@WS@]+$', '') END AS clean FROM d
"""


@query("normalize_noisy_text", "N3 N4", _NOISY_SQL)
def _(t):
    return t("noisy").select(
        "doc_id", text.normalize_noisy_text(F.col("body"), 5000).alias("clean")
    )


@query(
    "normalize_query",
    "N5",
    r"""SELECT item_id, regexp_replace(regexp_replace(replace(lower('  ' || text || chr(10)), 'ß', 'ss'),
    '[@WS@]+', ' ', 'g'), '^[@WS@]+|[@WS@]+$', '', 'g') AS normalized FROM {benchmark}""",
)
def _(t):
    raw = F.concat(F.lit("  "), F.col("text"), F.lit("\n"))
    return t("benchmark").select("item_id", text.normalize_query(raw).alias("normalized"))


# Bytes in four encodings, by language; ASCII texts of every other English document follow two Korean
# words in the Korean code page.
@query(
    "detect_encoding",
    "N6 N7 S2",
    r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, text, regexp_matches(text, '[^\x00-\x7F]') AS wide FROM {documents}),
      k AS (SELECT *, lang = 'en' AND doc_id % 2 = 1 AND NOT wide AS korean FROM d)
      SELECT doc_id, CASE WHEN korean THEN 'cp949' WHEN lang = 'de' THEN 'utf-16' WHEN lang = 'es' THEN 'utf-8-sig' WHEN lang = 'fr' AND wide THEN 'cp1252' ELSE 'utf-8' END AS encoding,
        lang IN ('de', 'es') AS has_bom, CAST(length(text) + CASE WHEN korean THEN 5 ELSE 0 END AS INTEGER) AS n_chars, FALSE AS is_binary FROM k""",
)
def _(t):
    korean = (F.col("lang") == "en") & (F.col("doc_id") % 2 == 1) & ~F.regexp_like("text", F.lit(r"[^\x00-\x7F]"))
    content = (
        F.when(korean, F.concat(F.unhex(F.lit("C7D1B1DB20B1DB20")), F.encode("text", "UTF-8")))
        .when(F.col("lang") == "de", F.encode("text", "UTF-16"))
        .when(F.col("lang") == "fr", F.encode("text", "ISO-8859-1"))
        .when(
            F.col("lang") == "es",
            F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")),
        )
        .otherwise(F.encode("text", "UTF-8"))
    )
    df = t("documents").select("doc_id", "lang", content.alias("content"))
    df = df.withColumn("encoding", binary.detect_encoding(F.col("content")))
    df = df.withColumn("decoded", binary.decode_bytes(F.col("content"), F.col("encoding")))
    return df.select(
        "doc_id",
        "encoding",
        binary.has_bom(F.col("content")).alias("has_bom"),
        F.length("decoded").alias("n_chars"),
        binary.looks_binary(
            F.col("content"), F.col("decoded"), F.col("encoding"), binary.has_bom(F.col("content"))
        ).alias("is_binary"),
    )


_FAMILY = r"""CASE WHEN starts_with(raw, '%PDF-') THEN 'PDF'
  WHEN starts_with(raw, 'PK'||chr(3)||chr(4)) THEN 'OOXML'
  WHEN len(list_filter(regexp_extract_all(substr(hex(encode(raw)), 1, 16384), '..'),
       lambda x: (x < '20' AND x NOT IN ('08','09','0A','0C','0D')))) <=
       0.05 * least(8192, strlen(raw)) THEN 'TEXT' ELSE 'BINARY' END"""


@query("sniff_family", "N8", f"SELECT doc_id, {_FAMILY} AS family FROM {{raw_files}}")
def _(t):
    return t("raw_files").select(
        "doc_id", binary.sniff_family(F.encode("raw", "UTF-8")).alias("family")
    )


@query(
    "check_media_type",
    "N9",
    f"""WITH f AS (SELECT doc_id, {_FAMILY} AS family,
      nullif(lower(trim(split_part(declared, ';', 1))), '') AS media_type FROM {{raw_files}})
    SELECT doc_id, media_type, family, problem FROM (SELECT *, CASE
      WHEN media_type NOT IN ('application/octet-stream', 'application/pdf', 'text/plain') THEN 'unsupported_media_type'
      WHEN family = 'BINARY' THEN 'invalid_file'
      WHEN media_type = 'application/pdf' AND family <> 'PDF' THEN 'invalid_file'
      WHEN media_type = 'text/plain' AND family <> 'TEXT' THEN 'unsupported_media_type' END AS problem FROM f)
    WHERE problem IS NOT NULL""",
)
def _(t):
    df = t("raw_files").withColumn("family", binary.sniff_family(F.encode("raw", "UTF-8")))
    return df.select(
        "doc_id",
        binary.media_type(F.col("declared")).alias("media_type"),
        "family",
        binary.media_type_problem(F.col("declared"), F.col("family")).alias("problem"),
    ).where(F.col("problem").isNotNull())


_REDACT_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  value, '\x1B\[[0-?]*[ -/]*[@-~]', '', 'g'),
  '(?i)https?://[^\s"''<>]*[?&](x-amz-[a-z0-9-]+|awsaccesskeyid|signature)=[^\s"''<>]*', '[REDACTED_PRESIGNED_URL]', 'g'),
  '(?i)\bmysql(\+[a-z0-9_]+)?://[^\s"''<>]+', '[REDACTED_DATABASE_DSN]', 'g'),
  '(?i)((?:authorization|password|api_key|db_host)\s*[:=]\s*)(?:Bearer\s+[A-Za-z0-9._~+/=-]+|(")[^"]*"|('')[^'']*''|[^\s,;}]+)', '\1\2\3[REDACTED]\2\3', 'g'),
  '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'),
  '(?i)([?&](?:token|api_key|password)=)[^&#\s"''<>]+', '\1[REDACTED]', 'g')"""


@query("redact_text", "N10", f"SELECT line_id, {_REDACT_SQL} AS clean FROM {{log_lines}}")
def _(t):
    return t("log_lines").select("line_id", redact.redact_text(F.col("value")).alias("clean"))


@query(
    "redact_record",
    "N11",
    f"""SELECT line_id, '[REDACTED]' AS access_token, {_REDACT_SQL} AS message,
      '[REDACTED]' AS nested_db_host, user_id AS nested_id, 'file_idx=' || user_id || ';internal-token=[REDACTED]' AS extras,
      'db_port=[REDACTED];n=' || user_id AS counts, '{{"db_user":"[REDACTED]","n":' || user_id || '}}' AS open_record
    FROM {{log_lines}}""",
)
def _(t):
    df = t("log_lines").select(
        "line_id",
        F.col("value").alias("message"),
        F.col("value").alias("prompt"),
        F.col("value").alias("access_token"),
        F.struct(
            F.col("value").alias("db-host"), F.col("value").alias("payload"), F.col("user_id").alias("id")
        ).alias("nested"),
        F.create_map(
            F.lit("internal-token"), F.col("value"),
            F.lit("Chunk Content"), F.col("value"),
            F.lit("file_idx"), F.col("user_id").cast("string"),
        ).alias("extras"),
        F.create_map(F.lit("db_port"), F.col("user_id"), F.lit("n"), F.col("user_id")).alias("counts"),
        F.parse_json(
            F.to_json(
                F.struct(
                    F.struct(F.col("value").alias("v")).alias("db_user"), F.col("value").alias("prompt"), F.col("user_id").alias("n")
                )
            )
        ).alias("open_record"),
    )
    r = redact.redact_columns(df)

    def entries(c):
        return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")

    return r.select(
        "line_id",
        "access_token",
        "message",
        F.col("nested.`db-host`").alias("nested_db_host"),
        F.col("nested.id").alias("nested_id"),
        entries("extras").alias("extras"),
        entries("counts").alias("counts"),
        F.to_json("open_record").alias("open_record"),
    )


@query(
    "single_line",
    "N12",
    r"""SELECT line_id, replace(replace(replace(replace(value, chr(13), '\r'), chr(10), '\n'), chr(9), '\t'),
    chr(27), '\u001b') AS line FROM {log_lines}""",
)
def _(t):
    return t("log_lines").select("line_id", text.single_line(F.col("value")).alias("line"))


@query(
    "truncate_texts",
    "N13 N14 N15",
    r"""SELECT doc_id,
      CASE WHEN length(text) <= 200 THEN text ELSE left(text, 186) || '...<truncated>' END AS log_text,
      CASE WHEN length(text) <= 500 THEN text ELSE regexp_replace(left(text, 499), '[@WS@]+$', '') || '…' END AS excerpt,
      CASE WHEN length(text) <= 300 THEN text ELSE left(text, 300) || '…' END AS snippet FROM {documents}""",
)
def _(t):
    c = F.col("text")
    return t("documents").select(
        "doc_id",
        text.truncate_log(c, 200).alias("log_text"),
        text.truncate_ellipsis(c, 500).alias("excerpt"),
        text.snippet(c).alias("snippet"),
    )


@query(
    "escape_prompt_json",
    "N16",
    r"""SELECT page_id, replace(replace(replace(CAST(to_json({{'url': url, 'html': html}}) AS VARCHAR),
      '&', chr(92)||'u0026'), '<', chr(92)||'u003c'), '>', chr(92)||'u003e') AS escaped FROM {pages}""".replace("{{", "{").replace("}}", "}"),
)
def _(t):
    return t("pages").select(
        "page_id", text.escape_prompt_json(F.to_json(F.struct("url", "html"))).alias("escaped")
    )


@query(
    "query_from_content",
    "N17",
    r"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g'), '[@WS@]+', ' ', 'g'), '^[@WS@]+|[@WS@]+$', '', 'g') AS s FROM {documents}),
    f AS (SELECT doc_id, s, CASE WHEN regexp_matches(s, '^.*?[.!?。！？] ') THEN rtrim(regexp_extract(s, '^.*?[.!?。！？] ')) ELSE s END AS first FROM n)
    SELECT doc_id, regexp_replace(left(CASE WHEN length(first) >= 8 THEN first ELSE s END, 180), '[@WS@]+$', '') AS query FROM f""",
)
def _(t):
    return t("documents").select("doc_id", text.query_from_content(F.col("text")).alias("query"))


@query(
    "parse_sizes",
    "N18 N19",
    r"""WITH s AS (SELECT event_id, value,
       CASE event_type WHEN 'click' THEN value || ' GiB' WHEN 'view' THEN ' ' || value || 'kB ' WHEN 'error' THEN value || 'MB'
            WHEN 'signup' THEN value || ' parsec' ELSE 'n/a' END AS size_text,
       CASE event_type WHEN 'error' THEN 'N/A' WHEN 'view' THEN ' ' ELSE CAST(value AS VARCHAR) END AS float_text FROM {events})
    SELECT event_id, CAST(floor(value * CASE WHEN size_text LIKE '% GiB' THEN 1073741824 WHEN size_text LIKE '%kB %' THEN 1000
        WHEN size_text LIKE '%MB' THEN 1000000 END) AS BIGINT) AS size_bytes,
      value AS percent, TRY_CAST(nullif(trim(float_text), '') AS DOUBLE) AS optional_value FROM s""",
)
def _(t):
    v = F.col("value").cast("string")
    e = F.col("event_type")
    size = (
        F.when(e == "click", F.concat(v, F.lit(" GiB")))
        .when(e == "view", F.concat(F.lit(" "), v, F.lit("kB ")))
        .when(e == "error", F.concat(v, F.lit("MB")))
        .when(e == "signup", F.concat(v, F.lit(" parsec")))
        .otherwise("n/a")
    )
    number = F.when(e == "error", "N/A").when(e == "view", " ").otherwise(v)
    return t("events").select(
        "event_id",
        text.parse_human_size(size).alias("size_bytes"),
        text.parse_percent(F.concat(F.lit(" "), v, F.lit("%"))).alias("percent"),
        text.optional_float(number).alias("optional_value"),
    )


@query(
    "format_bytes",
    "N20",
    r"""WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(floor(l_extendedprice * l_quantity * l_tax * 1000) AS BIGINT) AS bytes FROM {lineitem})
    SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN bytes <= 0 THEN '0 KB' WHEN bytes < 1024 THEN bytes || ' B'
      WHEN bytes < 1048576 THEN printf('%.1f KB', round(bytes / 1024.0::DOUBLE, 1))
      WHEN bytes < 1073741824 THEN printf('%.1f MB', round(bytes / 1048576.0::DOUBLE, 1))
      ELSE printf('%.1f GB', round(bytes / 1073741824.0::DOUBLE, 1)) END AS size_text FROM b""",
)
def _(t):
    b = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_tax") * 1000).cast("long")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", text.format_bytes(b).alias("size_text")
    )


@query(
    "file_names",
    "N21",
    r"""WITH n AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_name WHEN p_size > 30 THEN p_name || '.' ELSE p_name || '.V' || p_size || '.PDF' END AS name,
        CASE WHEN p_size < 10 THEN '' ELSE '.Pdf' END AS file_type FROM {part})
    SELECT p_partkey, lower(regexp_extract(name, '\.([^.]+)$', 1)) AS extension,
      CASE WHEN file_type <> '' THEN regexp_replace(name, '(?i)\.pdf$', '') ELSE name END AS base_name,
      CASE WHEN file_type <> '' THEN regexp_replace(name, '(?i)\.pdf$', '') || '.pdf' ELSE name END AS file_name FROM n""",
)
def _(t):
    size = F.col("p_size")
    name = (
        F.when(size > 40, F.col("p_name"))
        .when(size > 30, F.concat("p_name", F.lit(".")))
        .otherwise(F.concat("p_name", F.lit(".V"), size, F.lit(".PDF")))
    )
    kind = F.when(size < 10, "").otherwise(".Pdf")
    return t("part").select(
        "p_partkey",
        text.file_extension(name).alias("extension"),
        text.base_name(name, kind).alias("base_name"),
        text.build_file_name(name, kind).alias("file_name"),
    )
