"""Units, chunks and identities over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.identity import CHUNK_NAMESPACE, content_hash
from corpusloom.operators import chunks as ch
from corpusloom.operators import locators, units
from corpusloom.plans.registry import Tables, query

_LINES_SQL = r"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS unit_index, l AS line, count(*) OVER (PARTITION BY doc_id) AS n,
    CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {documents})"""


def _lines(t: Tables):
    return units.text_to_line_units(t("documents"), "doc_id", "text")


@query(
    "text_to_line_units",
    "U1 S1",
    f"""SELECT doc_id, unit_index, unit_index + 1 AS line_number, rtrim(line) AS text, start AS source_char_start,
      start + length(line) AS source_char_end, start + length(rtrim(line)) AS text_char_end,
      start + length(line) AS line_break_start,
      start + length(line) + CASE WHEN unit_index < n - 1 THEN 1 ELSE 0 END AS line_break_end,
      unit_index < n - 1 AS has_line_break FROM ({_LINES_SQL})""",
)
def _(t):
    return _lines(t)


# One step of the chunk walk in SQL: the last separator that fits in the second half.
_SEPS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "]


def _walk_sql(source: str, keys: str) -> str:
    ends = ", ".join(
        "nullif(length(regexp_extract(w, '(?s)^.*{}')), 0)".format(
            s.replace("\n", "\\n").replace(".", "\\.").replace("?", "\\?")
        )
        for s in _SEPS
    )
    cut = f"CASE WHEN start + 1000 >= n THEN n ELSE start + 500 + coalesce({ends}, 500) END"
    window = "substr(text, CAST(start AS BIGINT) + 501, 500)"
    return f"""WITH RECURSIVE walk AS (
      SELECT {keys}, text, n, start, {cut} AS cut FROM
        (SELECT *, {window} AS w FROM (SELECT {keys}, text, length(text) AS n, CAST(0 AS BIGINT) AS start FROM ({source}) WHERE text <> ''))
      UNION ALL
      SELECT {keys}, text, n, start, {cut} AS cut FROM
        (SELECT *, {window} AS w FROM (SELECT {keys}, text, n, greatest(cut - 200, start + 1) AS start FROM walk WHERE cut < n))),
    pieces AS (SELECT {keys}, start, substr(text, start + 1, cut - start) AS piece FROM walk),
    spans AS (SELECT {keys}, start AS walk_start, trim(piece, ' ' || chr(9) || chr(10)) AS content,
        start + length(piece) - length(ltrim(piece, ' ' || chr(9) || chr(10))) AS b FROM pieces)"""


@query(
    "chunk_text",
    "C1",
    _walk_sql("SELECT doc_id, text FROM {documents}", "doc_id")
    + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY walk_start) - 1 AS slice_index, b AS start_offset,
      b + length(content) AS end_offset, content FROM spans WHERE content <> ''""",
)
def _(t):
    return ch.chunk_text(t("documents"), "doc_id", "text")


_UNIT_CHUNKS = (
    _walk_sql(f"SELECT doc_id, unit_index, start AS line_start, rtrim(line) AS text FROM ({_LINES_SQL})", "doc_id, unit_index, line_start")
    + f""", unit_base AS (SELECT doc_id, unit_index, CAST(coalesce(sum(length(rtrim(line)) + 2) OVER (PARTITION BY doc_id ORDER BY unit_index
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM ({_LINES_SQL}) WHERE rtrim(line) <> ''),
      unit_chunks AS (SELECT s.doc_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.unit_index, walk_start) - 1 AS chunk_index, content,
        off + b AS start_offset, off + b + length(content) AS end_offset, s.unit_index, b AS unit_start_offset,
        b + length(content) AS unit_end_offset, line_start AS text_char_start, sha256(content) AS content_hash
        FROM spans s JOIN unit_base u ON s.doc_id = u.doc_id AND s.unit_index = u.unit_index WHERE content <> '')"""
)


def _unit_chunks(t: Tables):
    lines = _lines(t).withColumnRenamed("source_char_start", "text_char_start")
    return ch.chunk_units(lines, "doc_id", carry=("text_char_start",))


@query(
    "chunk_units",
    "C2 C3 C5",
    _UNIT_CHUNKS
    + f""" SELECT doc_id, chunk_index, content, start_offset, end_offset, unit_index, content_hash,
      '{ch.STRATEGY_NAME}' AS chunking_strategy, text_char_start + unit_start_offset AS chunk_source_char_start,
      text_char_start + unit_end_offset AS chunk_source_char_end FROM unit_chunks""",
)
def _(t):
    df = ch.decorate_chunks(_unit_chunks(t), F.lit("txt"), F.col("text_char_start"))
    return df.select(
        "doc_id", "chunk_index", "content", "start_offset", "end_offset", "unit_index",
        content_hash(F.col("content")).alias("content_hash"),
        "chunking_strategy", "chunk_source_char_start", "chunk_source_char_end",
    )


@query(
    "chunk_line_documents",
    "C2 C3 C5 U1",
    _UNIT_CHUNKS
    + """ SELECT doc_id, chunk_index, content, start_offset, end_offset, unit_index, content_hash, text_char_start FROM unit_chunks""",
)
def _(t):
    df = ch.chunk_line_documents(t("documents"), "doc_id", "text")
    return df.select(
        "doc_id", "chunk_index", "content", "start_offset", "end_offset", "unit_index",
        content_hash(F.col("content")).alias("content_hash"), "text_char_start",
    )


@query(
    "chunk_ids",
    "C4",
    _UNIT_CHUNKS
    + f""", h AS (SELECT c.doc_id, chunk_index, sha1(unhex('{CHUNK_NAMESPACE.replace("-", "")}') || encode(concat_ws(chr(31), d.source, c.doc_id, sha256(d.text), 'txt', '1.0', 'm64', '3', chunk_index, content_hash))) AS h
      FROM unit_chunks c JOIN {{documents}} d ON c.doc_id = d.doc_id)
    SELECT doc_id, chunk_index, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
      translate(substr(h,17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h,18,3) || '-' || substr(h,21,12) AS chunk_id FROM h""",
)
def _(t):
    docs = t("documents").select("doc_id", "source", content_hash(F.col("text")).alias("file_hash"))
    df = _unit_chunks(t).join(docs, "doc_id")
    df = ch.with_identity(
        df, F.col("source"), F.col("doc_id"), F.col("file_hash"), F.lit("txt"), "1.0", "m64", F.lit(3)
    )
    return df.select("doc_id", "chunk_index", "chunk_id")


@query(
    "validate_chunks",
    "C6",
    _walk_sql("SELECT doc_id, text FROM {documents}", "doc_id")
    + """, c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY walk_start) - 1 AS i, b, b + length(content) - CASE WHEN length(content) < 300 THEN 1 ELSE 0 END AS e, content,
        CASE WHEN length(content) < 200 THEN 'same' WHEN length(content) < 400 THEN 'own ' || doc_id ELSE doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY walk_start) - 1) END AS chunk_id FROM spans WHERE content <> ''),
      k AS (SELECT * FROM c WHERE length(content) <> 1000),
      p AS (SELECT d.doc_id, count(k.i) AS n, min(i) AS lo, max(i) AS hi, count(*) FILTER (WHERE e - b <> length(content)) AS bad FROM {documents} d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id),
      ids AS (SELECT doc_id, chunk_id, count(*) AS c FROM k GROUP BY ALL),
      dup AS (SELECT doc_id FROM ids WHERE c > 1),
      shared AS (SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY chunk_id) AS docs FROM ids) WHERE docs > 1)
      SELECT doc_id, 'no_chunks' AS rule, CAST(0 AS BIGINT) AS detail FROM p WHERE n = 0
      UNION ALL SELECT doc_id, 'index_not_contiguous', n FROM p WHERE lo <> 0 OR hi <> n - 1
      UNION ALL SELECT doc_id, 'duplicate_chunk_id', count(*) FROM dup GROUP BY doc_id
      UNION ALL SELECT doc_id, 'shared_chunk_id', count(*) FROM shared GROUP BY doc_id
      UNION ALL SELECT doc_id, 'span_length_mismatch', bad FROM p WHERE bad > 0""",
)
def _(t):
    c = ch.chunk_text(t("documents"), "doc_id", "text").withColumnRenamed("slice_index", "chunk_index")
    n = F.length("content")
    # Defects: full-size chunks are lost, short ones get a wrong end or a shared id.
    c = c.where(n != 1000).withColumn("end_offset", F.col("end_offset") - F.when(n < 300, 1).otherwise(0))
    c = c.withColumn("chunk_id", F.when(n < 200, "same").when(n < 400, F.concat(F.lit("own "), "doc_id")).otherwise(F.concat("doc_id", F.lit(":"), "chunk_index")))
    return ch.validate_chunks(t("documents"), c, "doc_id")


@query(
    "chunk_counts",
    "C7",
    _UNIT_CHUNKS
    + f""" SELECT l.doc_id, source_unit_count, text_unit_count, coalesce(chunk_count, 0) AS chunk_count FROM
      (SELECT doc_id, count(*) AS source_unit_count, count(*) FILTER (WHERE rtrim(line) <> '') AS text_unit_count FROM ({_LINES_SQL}) GROUP BY doc_id) l
      LEFT JOIN (SELECT doc_id, count(*) AS chunk_count FROM unit_chunks GROUP BY doc_id) c ON l.doc_id = c.doc_id""",
)
def _(t):
    return ch.chunk_counts(_lines(t), _unit_chunks(t), "doc_id")


@query(
    "chunk_statistics",
    "C2 C3 C7 U1",
    _UNIT_CHUNKS
    + """ SELECT lang, count(DISTINCT c.doc_id) AS documents, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars,
      min(length(content)) AS min_chars, max(length(content)) AS max_chars, count(DISTINCT content_hash) AS distinct_contents
      FROM unit_chunks c JOIN {documents} d ON c.doc_id = d.doc_id GROUP BY lang""",
)
def _(t):
    chunks = ch.chunk_line_documents(t("documents"), "doc_id", "text", carry=("lang",))
    df = chunks.select("lang", "doc_id", F.length("content").alias("n"), content_hash(F.col("content")).alias("h"))
    # Distinct counts as two-step aggregates: no per-language set, no single hot reducer.
    sizes = df.groupBy("lang", "doc_id").agg(
        F.count("*").alias("c"), F.sum("n").alias("s"), F.min("n").alias("lo"), F.max("n").alias("hi")
    )
    sizes = sizes.groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.sum("c").alias("chunks"),
        F.sum("s").alias("chars"),
        F.min("lo").alias("min_chars"),
        F.max("hi").alias("max_chars"),
    )
    hashes = df.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("distinct_contents"))
    return sizes.join(hashes, "lang")


@query(
    "dedup_by_content_hash",
    "C8",
    f"""WITH l AS ({_LINES_SQL}) SELECT doc_id, unit_index, sha256(line) AS sha256, length(line) AS n_chars FROM l""",
)
def _(t):
    items = _lines(t).select("doc_id", "unit_index", F.col("text").alias("content"), F.lit(1).alias("scope"))
    items = items.withColumn("ord", F.struct("doc_id", "unit_index"))
    located, _counts = ch.dedup_by_content_hash(
        items, ["scope"], "ord", lambda u: u.select("scope", "sha256", F.length("content").alias("n_chars"))
    )
    return located.select("doc_id", "unit_index", "sha256", "n_chars")


@query(
    "dedup_counts",
    "C8",
    """SELECT source, count(*) AS candidate_count, count(DISTINCT text) AS unique_count, count(*) - count(DISTINCT text) AS deduplicated_count
       FROM {documents} GROUP BY source""",
)
def _(t):
    items = t("documents").select("source", "doc_id", F.col("text").alias("content"))
    _located, counts = ch.dedup_by_content_hash(
        items, ["source"], "doc_id", lambda u: u.select("source", "sha256")
    )
    return counts


@query(
    "cells_to_row_units",
    "U2 U3",
    r"""WITH u AS (SELECT *, CASE WHEN is_formula THEN coalesce(cached, value) ELSE value END AS shown,
         CASE col WHEN 2 THEN 'B' WHEN 4 THEN 'D' ELSE 'AD' END AS letter FROM {cells} WHERE value IS NOT NULL OR cached IS NOT NULL),
      r AS (SELECT doc_id, row, min(col) AS a, max(col) AS z, count(*) AS cell_count,
        max(shown) FILTER (WHERE col = 2) AS c2, max(shown) FILTER (WHERE col = 4) AS c4, max(shown) FILTER (WHERE col = 30) AS c30,
        string_agg(letter || row, ',' ORDER BY col) AS cells, bool_or(is_formula AND cached IS NULL) AS miss FROM u GROUP BY doc_id, row)
      SELECT doc_id, row, regexp_replace(replace(c2 || chr(9) || chr(9) || c4 || CASE WHEN c30 IS NOT NULL THEN repeat(chr(9), 26) || c30 ELSE '' END, chr(10)||chr(10), chr(10)), '\s+$', '') AS text,
        'B' || row || ':' || CASE WHEN z = 30 THEN 'AD' ELSE 'D' END || row AS cell_range, cells AS cell_coordinates, cell_count,
        z - a + 1 AS column_span, 'D' || row AS formula_cells, CASE WHEN miss THEN 'D' || row ELSE '' END AS missing_cells FROM r""",
)
def _(t):
    r = units.cells_to_row_units(t("cells"), ["doc_id"])
    return r.select(
        "doc_id", "row", "text", "cell_range",
        F.array_join("cell_coordinates", ",").alias("cell_coordinates"),
        "cell_count", "column_span",
        F.array_join("formula_cells", ",").alias("formula_cells"),
        F.array_join("formula_result_missing_cells", ",").alias("missing_cells"),
    )


@query(
    "range_to_row_index",
    "U4",
    """SELECT doc_id, r AS row, string_agg(name, ',' ORDER BY ordinal) AS names FROM
      (SELECT *, unnest(generate_series(min_row, max_row)) AS r FROM {row_ranges}) GROUP BY doc_id, r""",
)
def _(t):
    r = units.range_to_row_index(t("row_ranges"), ["doc_id"])
    return r.select("doc_id", "row", F.array_join("names", ",").alias("names"))


@query(
    "value_to_text",
    "U5",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_text, CASE WHEN value > 10 THEN 'TRUE' ELSE 'FALSE' END AS flag_text,
      CASE WHEN event_type = 'view' THEN '' ELSE CAST(value AS VARCHAR) END AS number_text, strftime(ts, '%Y-%m-%d') AS day_text FROM {events}""",
)
def _(t):
    number = F.when(F.col("event_type") != "view", F.col("value"))
    return t("events").select(
        "event_id",
        units.value_to_text(F.col("ts"), "timestamp_ntz", "microseconds").alias("ts_text"),
        units.value_to_text(F.col("value") > 10, "boolean").alias("flag_text"),
        units.value_to_text(number, "double").alias("number_text"),
        units.value_to_text(F.to_date("ts"), "date").alias("day_text"),
    )


@query(
    "table_rows_to_text",
    "U6",
    r"""WITH c AS (SELECT row // 8 AS table_idx, row, col, coalesce(trim(replace(coalesce(value, ''), chr(10), ' ')), '') AS v FROM {cells}),
      r AS (SELECT table_idx, row, rtrim(string_agg(v, chr(9) ORDER BY col), chr(9)) AS line, count(*) AS n FROM c GROUP BY table_idx, row)
      SELECT table_idx, string_agg(line, chr(10) ORDER BY row) AS text, count(*) AS row_count, max(n) AS column_count FROM r GROUP BY table_idx""",
)
def _(t):
    cells = t("cells").withColumn("table_idx", F.floor(F.col("row") / 8))
    return units.table_rows_to_text(cells, ["table_idx"])


@query(
    "section_number",
    "U7",
    """SELECT doc_id, block_index, CAST(1 + coalesce(sum(CASE WHEN ends_section THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS section_index FROM {blocks}""",
)
def _(t):
    df = units.section_number(t("blocks"), "doc_id", "block_index", "ends_section")
    return df.select("doc_id", "block_index", "section_index")


@query(
    "carry_heading",
    "U8",
    """WITH s AS (SELECT *, 1 + coalesce(sum(CASE WHEN ends_section THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section_index FROM {blocks}),
      h AS (SELECT *, CASE WHEN unit_type = 'heading' AND trim(text) <> '' THEN block_index END AS hb FROM s),
      f AS (SELECT doc_id, block_index, section_index, max(hb) OVER (PARTITION BY doc_id, section_index ORDER BY block_index) AS at FROM h)
      SELECT f.doc_id, f.block_index, trim(b.text) AS section_title, CASE WHEN b.heading_level >= 1 THEN b.heading_level END AS section_heading_level
      FROM f LEFT JOIN {blocks} b ON f.doc_id = b.doc_id AND f.at = b.block_index""",
)
def _(t):
    df = units.section_number(t("blocks"), "doc_id", "block_index", "ends_section")
    df = units.carry_heading(df, "doc_id", "block_index")
    return df.select("doc_id", "block_index", "section_title", "section_heading_level")


@query(
    "structure_path",
    "U9",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE file_type
       WHEN 'pdf' THEN CASE WHEN page_number >= 1 THEN 'page:' || page_number ELSE 'page-unit:' || (unit_index + 1) END
       WHEN 'docx' THEN 'section:' || CASE WHEN section_index >= 1 THEN section_index ELSE 1 END || '/block:' || CASE WHEN block_index >= 1 THEN block_index ELSE unit_index + 1 END
       WHEN 'pptx' THEN 'slide:' || CASE WHEN slide_number >= 1 THEN slide_number ELSE 1 END || CASE WHEN trim(shape_path) <> '' THEN '/shape:' || trim(shape_path)
            ELSE '/' || coalesce(unit_type, 'unit') || ':' || (unit_index + 1) END
       WHEN 'xlsx' THEN 'sheet:' || coalesce(sheet_name, 'unknown') || '/range:' || coalesce(cell_range, 'unit-' || (unit_index + 1))
       ELSE 'line:' || line_number END AS path,
      CASE file_type WHEN 'pdf' THEN 'pdf_page' WHEN 'docx' THEN 'docx_block' WHEN 'pptx' THEN coalesce(unit_type, 'pptx_slide_unit')
        WHEN 'xlsx' THEN 'xlsx_cell_range' ELSE 'txt_line' END AS kind FROM {unit_meta}""",
)
def _(t):
    df = t("unit_meta")
    names = "page_number slide_number section_index block_index line_number shape_path unit_type sheet_name cell_range"
    m = F.struct(*names.split())
    return df.withColumn("m", m).select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        units.structure_path(F.col("file_type"), F.col("unit_index"), F.col("m")).alias("path"),
        units.location_kind(F.col("file_type"), F.col("unit_type")).alias("kind"),
    )


@query(
    "shape_geometry",
    "U10",
    """SELECT p_partkey, p_size * 1000 + CAST(floor(p_retailprice) AS BIGINT) AS right_emu, CAST(floor(p_retailprice) AS BIGINT) + 500 AS bottom_emu,
      CASE WHEN p_size > 5 THEN round((p_size * 1000) / (p_size * 4000.0::DOUBLE + 7), 8) ELSE 0.0::DOUBLE END AS left_ratio,
      round(500 / 6858000.0::DOUBLE, 8) AS top_ratio FROM {part}""",
)
def _(t):
    size, price = F.col("p_size"), F.col("p_retailprice").cast("long")
    slide_width = F.when(size > 5, size * 4000 + 7).otherwise(0)
    g = units.shape_geometry(
        (size * 1000).cast("long"), F.lit(500), price, price, slide_width, F.lit(6858000)
    )
    return t("part").select("p_partkey", g.alias("g")).select(
        "p_partkey",
        F.col("g.right").alias("right_emu"),
        F.col("g.bottom").alias("bottom_emu"),
        F.col("g.left_ratio").alias("left_ratio"),
        F.col("g.top_ratio").alias("top_ratio"),
    )


_META_SQL = """WITH v AS (SELECT *, CAST(meta_json AS JSON) AS j FROM {unit_meta}),
  g AS (SELECT l_orderkey, l_linenumber, l_extendedprice, file_type,
    CASE WHEN json_type(j, '$.page_number') IN ('UBIGINT', 'BIGINT') AND CAST(j->>'page_number' AS BIGINT) >= 1 THEN CAST(j->>'page_number' AS BIGINT)
         ELSE CAST(j->>'page' AS BIGINT) END AS page,
    CASE WHEN CAST(j->>'slide_number' AS BIGINT) >= 1 THEN CAST(j->>'slide_number' AS BIGINT) END AS slide_no,
    trim(j->>'sheet_name') AS sheet_name, CAST(j->>'sheet_index' AS BIGINT) + 1 AS sheet_number, j->>'shape_path' AS shape_path,
    CASE WHEN j->>'content_origin' = 'ocr' THEN 'ocr' ELSE 'text' END AS content_origin,
    CAST(j->>'image_index' AS BIGINT) AS image_ordinal, CAST(j->>'line_start_number' AS BIGINT) AS line_start,
    CASE WHEN CAST(j->>'line_end' AS BIGINT) >= 1 THEN CAST(j->>'line_end' AS BIGINT) END AS line_end,
    CAST(j->>'section_index' AS BIGINT) AS section_index, round(CAST(j->>'ocr_mean_confidence' AS DOUBLE), 6) AS confidence,
    j->>'location_kind' AS declared FROM v)"""


@query(
    "build_source_locator",
    "U12",
    _META_SQL
    + """ SELECT l_orderkey, l_linenumber, l_extendedprice, page, slide_no, sheet_name, sheet_number, shape_path, content_origin, image_ordinal,
      line_start, line_end, section_index, confidence,
      CASE WHEN declared = 'pptx_shape' THEN declared WHEN file_type = 'pdf' THEN 'pdf_page' WHEN file_type = 'docx' THEN 'docx_block'
        WHEN file_type = 'pptx' AND shape_path IS NOT NULL THEN 'pptx_shape' WHEN file_type = 'pptx' THEN 'pptx_slide'
        WHEN file_type = 'xlsx' THEN 'xlsx_cell_range' ELSE 'txt_line' END AS kind,
      CASE file_type WHEN 'pdf' THEN 'page:' || page WHEN 'docx' THEN 'section:' || section_index
        WHEN 'pptx' THEN 'slide:' || slide_no || coalesce('/shape:' || shape_path, '')
        WHEN 'xlsx' THEN 'sheet:' || sheet_name ELSE CASE WHEN line_end <> line_start THEN 'line:' || line_start || '-' || line_end ELSE 'line:' || line_start END END AS path
      FROM g""",
)
def _(t):
    df = t("unit_meta").withColumn("meta", F.parse_json("meta_json"))
    df = locators.build_source_locator(df, F.col("file_type"), F.col("meta"))
    loc = F.col("locator")
    same = "page slide_no sheet_name sheet_number shape_path content_origin image_ordinal line_start line_end section_index kind"
    return df.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        *[loc[n].alias(n) for n in same.split()],
        F.round(loc["ocr_mean_confidence"], 6).alias("confidence"),
        loc["structure_path"].alias("path"),
    )


@query(
    "validate_locator",
    "U13",
    _META_SQL
    + """ SELECT l_orderkey, l_linenumber, rule, 1::BIGINT AS detail FROM (
      SELECT *, unnest([
        CASE WHEN line_end < line_start THEN 'line_range_order' END,
        CASE WHEN content_origin = 'ocr' AND image_ordinal IS NULL THEN 'ocr_needs_image' END,
        CASE WHEN content_origin = 'ocr' AND file_type = 'pdf' AND page IS NULL THEN 'pdf_ocr_needs_page' END,
        CASE WHEN content_origin = 'ocr' AND file_type = 'pptx' AND slide_no IS NULL THEN 'pptx_ocr_needs_slide' END,
        CASE WHEN content_origin = 'ocr' AND file_type = 'xlsx' AND sheet_name IS NULL THEN 'xlsx_ocr_needs_sheet' END,
        CASE WHEN file_type = 'pdf' THEN 'pdf_foreign_location' END,
        CASE WHEN file_type = 'pptx' AND page IS NOT NULL THEN 'pptx_foreign_location' END,
        CASE WHEN file_type = 'xlsx' AND (page IS NOT NULL OR slide_no IS NOT NULL) THEN 'xlsx_foreign_location' END,
        CASE WHEN file_type = 'txt' AND (page IS NOT NULL OR slide_no IS NOT NULL OR sheet_name IS NOT NULL) THEN 'txt_foreign_location' END]) AS rule
      FROM g) WHERE rule IS NOT NULL""",
)
def _(t):
    df = t("unit_meta").withColumn("meta", F.parse_json("meta_json"))
    df = locators.build_source_locator(df, F.col("file_type"), F.col("meta"))
    return locators.validate_locator(df, ["l_orderkey", "l_linenumber"])


@query(
    "merge_located_units",
    "U14",
    """WITH b AS (SELECT o_custkey AS doc, o_orderkey AS ordinal, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS anchor FROM {orders}),
      x AS (SELECT o_custkey AS doc, o_orderkey AS ordinal, CASE WHEN o_totalprice > 400000 THEN NULL WHEN o_totalprice > 300000 THEN 'nowhere' ELSE o_orderpriority END AS anchor FROM {orders} WHERE o_orderstatus = 'P'),
      l AS (SELECT doc, anchor, max(ordinal) AS pos FROM b WHERE anchor IS NOT NULL GROUP BY ALL),
      f AS (SELECT doc, anchor, min(ordinal) AS lead_ord FROM x WHERE anchor IS NOT NULL GROUP BY ALL),
      u AS (SELECT doc, 'b' || ordinal AS text, FALSE AS is_extra, ordinal AS a, 0 AS p, 0 AS c, 0 AS d FROM b
        UNION ALL SELECT x.doc, 'x' || ordinal, TRUE, coalesce(pos, 4611686018427387904), CASE WHEN pos IS NOT NULL THEN 1 WHEN x.anchor IS NOT NULL THEN 0 ELSE 1 END,
          CASE WHEN pos IS NULL AND x.anchor IS NOT NULL THEN lead_ord ELSE ordinal END, CASE WHEN pos IS NULL AND x.anchor IS NOT NULL THEN ordinal ELSE 0 END
        FROM x LEFT JOIN l ON x.doc = l.doc AND x.anchor = l.anchor LEFT JOIN f ON x.doc = f.doc AND x.anchor = f.anchor)
      SELECT doc, text, is_extra, row_number() OVER (PARTITION BY doc ORDER BY a, p, c, d) - 1 AS unit_index FROM u""",
)
def _(t):
    o = t("orders")
    price = F.col("o_totalprice")
    base = o.select(
        F.col("o_custkey").alias("doc"),
        F.col("o_orderkey").alias("ordinal"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("anchor"),
        F.concat(F.lit("b"), "o_orderkey").alias("text"),
    )
    extra = o.where(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("doc"),
        F.col("o_orderkey").alias("ordinal"),
        F.when(price > 400000, None).when(price > 300000, "nowhere").otherwise(F.col("o_orderpriority")).alias("anchor"),
        F.concat(F.lit("x"), "o_orderkey").alias("text"),
    )
    return units.merge_located_units(base, extra, "doc").select("doc", "text", "is_extra", "unit_index")


@query(
    "recognised_lines_to_text",
    "U15",
    """SELECT doc_id, image_id, string_agg(text, chr(10) ORDER BY ordinal, text) AS text, round(avg(confidence), 6) AS mean_confidence, count(*) AS line_count
      FROM {image_lines} WHERE confidence >= 0.35 GROUP BY doc_id, image_id""",
)
def _(t):
    return units.recognised_lines_to_text(t("image_lines"), ["doc_id", "image_id"])


@query(
    "context_text",
    "U16",
    """WITH p AS (SELECT p_partkey, trim(p_name) AS a, trim(p_brand) AS b, CASE WHEN p_size > 20 THEN trim(p_name) ELSE '' END AS c FROM {part})
      SELECT p_partkey, rtrim(left(a || chr(10) || b || CASE WHEN c <> '' AND c <> a AND c <> b THEN chr(10) || c ELSE '' END, 15), ' ' || chr(10)) AS context FROM p""",
)
def _(t):
    after = F.when(F.col("p_size") > 20, F.concat(F.lit("  "), "p_name")).otherwise("")
    parts = [F.col("p_name"), F.concat(F.lit(" "), "p_brand"), after]
    return t("part").select("p_partkey", units.context_text(parts, 15).alias("context"))


_GREEDY = """WITH RECURSIVE o AS (SELECT {key}, {ord}, n_bytes, row_number() OVER (PARTITION BY {key} ORDER BY {ord}) AS rn FROM {src}),
  g AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS cnt, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS ord, FALSE AS selected FROM o
    UNION ALL SELECT {key}, nrn, cnt + CASE WHEN ok THEN 1 ELSE 0 END, used + CASE WHEN ok THEN n_bytes ELSE 0 END, next_ord, ok
    FROM (SELECT g.{key}, o.rn AS nrn, g.cnt, g.used, o.n_bytes, o.{ord} AS next_ord, (g.cnt < {count} AND g.used + o.n_bytes <= {total}) AS ok
          FROM g JOIN o ON g.{key} = o.{key} AND o.rn = g.rn + 1))"""


def greedy_sql(src: str, key: str, ord_: str, count: int, total: int) -> str:
    """SQL twin of the greedy budget walk."""
    return _GREEDY.format(src=src, key=key, ord=ord_, count=count, total=total)


@query(
    "budget_select",
    "U17",
    greedy_sql("(SELECT doc_id, ordinal, n_bytes FROM {images})", "doc_id", "ordinal", 4, 250000)
    + " SELECT doc_id, ord AS ordinal, selected FROM g WHERE rn > 0",
)
def _(t):
    df = units.budget_select(t("images"), ["doc_id"], ["ordinal"], "n_bytes", 4, 250_000)
    return df.select("doc_id", "ordinal", "selected")


@query(
    "image_only_anchors",
    "U18",
    """SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page, '' AS text, 'image_only_anchor' AS unit_type FROM {lineitem} l
      WHERE NOT EXISTS (SELECT 1 FROM {lineitem} x WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = l.l_linenumber AND x.l_returnflag = 'A')""",
)
def _(t):
    loc = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return units.image_only_anchors(loc, loc.where("l_returnflag = 'A'"), ["doc_id", "page"])


@query(
    "filter_image_candidates",
    "U19",
    greedy_sql(
        """(SELECT doc_id, min(ordinal) AS ordinal, arg_min(n_bytes, ordinal) AS n_bytes FROM {images}
           WHERE n_bytes BETWEEN 1024 AND 26214400 AND (width IS NULL OR (width >= 64 AND height >= 32)) GROUP BY doc_id, sha256)""",
        "doc_id", "ordinal", 300, 400000,
    )
    + " SELECT doc_id, ord AS ordinal FROM g WHERE rn > 0 AND selected",
)
def _(t):
    limits = units.IMAGE_LIMITS | {"max_total_bytes": 400_000}
    return units.filter_image_candidates(t("images"), "doc_id", "ordinal", limits).select("doc_id", "ordinal")


@query(
    "scan_page_flag",
    "U20",
    """WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 20 ELSE 30 END AS len, o_orderpriority = '1-URGENT' AS vec FROM {orders}),
      i AS (SELECT l_orderkey, count(*) AS n, round(least(sum(l_quantity / 200.0::DOUBLE), 1.0), 9) AS cov FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1)
      SELECT o_orderkey, coalesce(n, 0) AS image_count, coalesce(cov, 0.0) AS coverage,
        CASE WHEN len > 24 THEN FALSE WHEN n IS NULL AND NOT vec THEN FALSE WHEN n IS NULL THEN len = 0 WHEN len = 0 THEN TRUE ELSE cov >= 0.6 END AS is_scan
      FROM p LEFT JOIN i ON o_orderkey = l_orderkey""",
)
def _(t):
    status = F.col("o_orderstatus")
    pages = t("orders").select(
        "o_orderkey",
        F.when(status == "P", 0).when(status == "O", 20).otherwise(30).alias("compact_text_length"),
        (F.col("o_orderpriority") == "1-URGENT").alias("has_vector"),
    )
    images = t("lineitem").where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") / 200.0).alias("coverage")
    )
    return units.scan_page_flag(pages, images, ["o_orderkey"])
