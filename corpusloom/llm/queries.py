"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from corpusloom.llm import (
    byte_bpe, chat_tree, exact_dedup, importance, language_id, merkle, nearest, ngram_join, packing, token_counts, toxicity, warc, word_bpe,
)
from corpusloom.llm.common import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length curve of the corpus in tokens, a row for each distinct length."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out are the documents whose fold of 5 is 0; the model learns from the others."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold_of("doc_id", 5) != 0))
    return language_id.predict(docs, model, extra=[(fold_of("doc_id", 5) == 0).alias("held_out")])


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op6_exact_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS original,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), judged AS (
  SELECT doc_id, content,
         first_value(doc_id) OVER best AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size,
         row_number() OVER best = 1 AS kept
  FROM rows
  WINDOW best AS (PARTITION BY content ORDER BY length(original) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, sha256(content) AS text_sha256 FROM judged
"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out are the documents whose fold of 4 is 2; no label of theirs is read."""
    docs = table(spark, sf_dir, "documents")
    fold = fold_of("doc_id", 4)
    labels = table(spark, sf_dir, "labels").where(fold != 2)
    model = toxicity.fit(docs.where(fold != 2), labels)
    return toxicity.score(docs, model, extra=[(fold == 2).alias("held_out")])


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of copies, number of links to other classes, and group of each document."""
    return ngram_join.similarity_links(table(spark, sf_dir, "documents"))


@query
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages into archives in the shared folder, and read them back."""
    folder = warc.archive_folder(spark)
    files = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    rows = warc.read_archives(files, folder)
    checked = rows.withColumn("record_type", F.coalesce(warc.failed(F.col("problem")).cast("string"), F.col("record_type")))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc"] = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""


@query
def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings whose id is -1."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema)
    return chat_tree.conversation_digests(rows.unionByName(own))


ORACLES["op7_chat_tree"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), formatted AS (
  SELECT *, '<|im_start|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')
            || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS whole
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(whole)) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id
"""


@query
def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


@query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The table of crc32 has a rule: eight shifts of each byte value.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS crcs
  FROM (SELECT unnest(range(256)) AS b)
)"""


def crc_sql(blob: str) -> str:
    """crc32 of a blob, given the one row of ``crc_table``."""
    values = f"list_transform(range(octet_length({blob})), lambda i: CAST('0x' || substr(hex({blob}), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {values}), lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), 4294967295)"


ORACLES["op12_importance"] = f"""
WITH {CRC_TABLE}, folded AS (
  SELECT 'd' AS side, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', item_id, coalesce(text, '') FROM benchmark
), split AS (
  SELECT side, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM folded
), grams AS (
  SELECT side, doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS gram FROM split
), spelled AS MATERIALIZED (
  SELECT gram, {crc_sql("encode(gram)")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM grams), crc_table
), told AS MATERIALIZED (SELECT side, doc_id, bucket FROM grams JOIN spelled USING (gram)
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 't') AS t FROM told GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ()) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + 10000)::DOUBLE))) AS gain
  FROM counts
), weighed AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight
  FROM told JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(words) < 20 AS short,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (doc_id) WHERE side = 'd'
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN NOT short AND row_number() OVER best <= 25 * count(*) OVER (PARTITION BY short) // 100 THEN row_number() OVER best END AS rank
FROM scored WINDOW best AS (PARTITION BY short ORDER BY score DESC, doc_id)
"""


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked after every document whose id's crc32 is divisible by 7 was changed."""
    docs = table(spark, sf_dir, "documents")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return merkle.proof_report(docs, changed, F.col("n_chars") + 1)


ORACLES["op13_merkle"] = f"""
WITH RECURSIVE {CRC_TABLE}, framed AS (
  SELECT doc_id, lang,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
         coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS size,
         coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other_size,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS k, sha256(head || size || tail) AS leaf,
         CASE WHEN {crc_sql("encode(doc_id::VARCHAR)")} % 7 = 0 THEN sha256(head || other_size || tail) END AS other
  FROM framed, crc_table
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM leaves
), nodes AS (
  SELECT k, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT k, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY k, level, i // 2
), tree AS MATERIALIZED (SELECT * FROM nodes
), subroots AS MATERIALIZED (
  SELECT k, h AS subroot, level AS height, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS groups FROM tree WHERE n = 1
), summit AS (
  SELECT 0 AS level, place AS i, groups AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM summit WHERE n > 1 GROUP BY level, i // 2
), heads AS MATERIALIZED (SELECT * FROM summit
), steps AS MATERIALIZED (
  SELECT k, level, i, h, 0 AS part FROM tree UNION ALL SELECT '', level, i, h, 1 FROM heads
), ways AS (
  SELECT p.k, p.i AS leaf_place, u.part, u.level, CASE WHEN u.part = 0 THEN p.i ELSE s.place END >> u.level AS spot
  FROM placed p JOIN subroots s USING (k)
  JOIN (SELECT DISTINCT k, 0 AS part, level FROM tree WHERE n > 1 UNION ALL
        SELECT DISTINCT s.k, 1, t.level FROM subroots s, heads t WHERE t.n > 1) u USING (k)
), met AS MATERIALIZED (
  SELECT w.k, leaf_place, row_number() OVER (PARTITION BY w.k, leaf_place ORDER BY w.part, w.level) AS step, spot, coalesce(s.h, '') AS h
  FROM ways w LEFT JOIN steps s ON s.k = CASE WHEN w.part = 0 THEN w.k ELSE '' END AND s.part = w.part AND s.level = w.level AND s.i = xor(w.spot, 1)
), folding AS (
  SELECT k, i AS leaf_place, 1 AS step, coalesce(other, leaf) AS node FROM placed
  UNION ALL
  SELECT f.k, f.leaf_place, f.step + 1, sha256(CASE WHEN m.spot % 2 = 1 THEN m.h || f.node ELSE f.node || m.h END)
  FROM folding f JOIN met m ON m.k = f.k AND m.leaf_place = f.leaf_place AND m.step = f.step
), folded AS (SELECT k, leaf_place, arg_max(node, step) AS folded_root FROM folding GROUP BY k, leaf_place
), proofs AS (SELECT k, leaf_place, string_agg(h, '' ORDER BY step) AS proof FROM met GROUP BY k, leaf_place)
SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM heads WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       folded_root, folded_root = (SELECT h FROM heads WHERE n = 1) AS verified
FROM placed p JOIN subroots s USING (k) JOIN folded f ON f.k = p.k AND f.leaf_place = p.i
LEFT JOIN proofs q ON q.k = p.k AND q.leaf_place = p.i
"""
