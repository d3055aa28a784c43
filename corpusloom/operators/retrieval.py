"""Query routing, context packing and citation checks over tables of requests.

A request holds at most 20 files and 20 hits (60 in a synthesis), so per-request arrays
and windows are bounded; requests themselves spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.constants import (
    CHUNK_CONTEXT_CHARS,
    CHUNKS_PER_DOCUMENT,
    ELLIPSIS,
    EXCERPT_CHARS,
    INSUFFICIENT_ANSWER,
    MAX_CALLS,
    MAX_INPUT_TOKENS,
    MAX_OUTPUT_TOKENS,
    TOTAL_CONTEXT_CHARS,
)
from corpusloom.functions.text import (
    escape_prompt_json,
    is_synthesis_query,
    strip,
    truncate_ellipsis,
)
from corpusloom.operators.chunks import reject_rows
from corpusloom.operators.ordered import ordered_fold

# Citation formats.
CITATION = r"\[(SOURCE-[0-9]+)\]"
STRICT_CITATION = r"\[(SOURCE-[1-9][0-9]*)\]"
SOURCE_ID = r"^SOURCE-[1-9][0-9]*\z"
# Fixed value: tokens added to every estimate.
TOKEN_OVERHEAD = 32


def _by_rank():
    return Window.partitionBy("request_id").orderBy("rank")


def classify_query(query: Column, n_files: Column) -> Column:
    """``lookup`` or ``synthesis``; fewer than two files are always a lookup."""
    return F.when((n_files >= 2) & is_synthesis_query(query), F.lit("synthesis")).otherwise(F.lit("lookup"))


def group_by_document(hits: DataFrame) -> DataFrame:
    """Add group_rank (first-seen order of the hit's document) and position inside it."""
    per_file = Window.partitionBy("request_id", "file_idx")
    df = hits.withColumn("_first", F.min("rank").over(per_file))
    df = df.withColumn("position", F.row_number().over(per_file.orderBy("rank")) - 1)
    order = Window.partitionBy("request_id").orderBy("_first")
    return df.withColumn("group_rank", F.dense_rank().over(order) - 1).drop("_first")


def conflicting_documents(hits: DataFrame, described_by: list[str]) -> DataFrame:
    """Documents described differently by hits of one request."""
    kinds = hits.select("request_id", "file_idx", *described_by).distinct()
    many = kinds.groupBy("request_id", "file_idx").agg(F.count("*").alias("detail")).where("detail > 1")
    return many.select("request_id", "file_idx", F.lit("conflicting_document").alias("rule"), "detail")


def route(hits: DataFrame, query_types: DataFrame) -> DataFrame:
    """Order of hits for the prompt: rank for a lookup, grouped by document for a synthesis."""
    df = group_by_document(hits).join(query_types.select("request_id", "query_type"), "request_id")
    key = F.when(
        F.col("query_type") == "synthesis",
        F.struct(F.col("group_rank").alias("a"), F.col("position").alias("b")),
    ).otherwise(F.struct(F.col("rank").alias("a"), F.lit(0).alias("b")))
    order = Window.partitionBy("request_id").orderBy(key)
    return df.withColumn("route_order", F.row_number().over(order))


def validate_routing(hits: DataFrame, routed: DataFrame) -> DataFrame:
    """Requests whose routed hits are not exactly their hits, or whose lookup order moved."""
    cols = ["request_id", "chunk_id"]
    tag = F.sum("side")
    both = hits.select(*cols, F.lit(1).alias("side")).unionByName(routed.select(*cols, F.lit(-1).alias("side")))
    lost = both.groupBy(*cols).agg(tag.alias("side")).where("side != 0")
    lost = lost.groupBy("request_id").agg(F.count("*").alias("detail"))
    moved = routed.where((F.col("query_type") == "lookup") & (F.col("route_order") != F.col("rank")))
    moved = moved.groupBy("request_id").agg(F.count("*").alias("detail"))
    return lost.select("request_id", F.lit("hits_changed").alias("rule"), "detail").unionByName(
        moved.select("request_id", F.lit("lookup_order_changed").alias("rule"), "detail")
    )


def pack_context_lookup(
    hits: DataFrame,
    total: int = TOTAL_CONTEXT_CHARS,
    per_chunk: int = CHUNK_CONTEXT_CHARS,
    excerpt: int = EXCERPT_CHARS,
) -> DataFrame:
    """Hits of each request that fit its context, numbered SOURCE-1, SOURCE-2, ...

    A hit is charged min(length, limit) before any trimming, so what is left for it is
    the total minus a running sum of capped lengths. Once fewer than two characters are
    left, a hit that would need cutting ends the context.
    """
    text = strip(F.col("content"))
    df = hits.withColumn("_text", text).where(F.col("_text") != "")
    n = F.length("_text")
    before = F.coalesce(F.sum(F.least(n, F.lit(per_chunk))).over(_by_rank().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_limit", F.least(F.lit(per_chunk), F.lit(total) - before)).withColumn(
        "_n", F.row_number().over(_by_rank())
    )
    marker_only = (F.col("_n") > 1) & (F.length("_text") > F.col("_limit")) & (F.col("_limit") <= len(ELLIPSIS))
    df = df.where((F.col("_limit") > 0) & ~marker_only)
    return df.select(
        *hits.columns,
        F.concat(F.lit("SOURCE-"), F.col("_n").cast("string")).alias("source_id"),
        truncate_ellipsis(F.col("_text"), F.col("_limit").cast("int")).alias("prompt_content"),
        truncate_ellipsis(F.col("_text"), excerpt).alias("excerpt"),
    )


def pack_context_round_robin(
    hits: DataFrame,
    per_document: int = CHUNKS_PER_DOCUMENT,
    total: int = TOTAL_CONTEXT_CHARS,
    per_chunk: int = CHUNK_CONTEXT_CHARS,
) -> DataFrame:
    """Context shared evenly by documents: first chunks of all, then second chunks, ...

    The charge is the length after cutting and right-trimming, so a cut chunk can hand
    characters on; that is a fold over the at most 60 ordered chunks of a request.
    """
    df = group_by_document(hits).where(F.col("position") < per_document)
    df = df.withColumn("content", strip(F.col("content"))).where(F.col("content") != "")
    item = F.struct("position", "group_rank", "chunk_id", "file_idx", "content")
    per_request = df.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = per_request.schema["items"].dataType.elementType.simpleString()

    def take(acc: Column, x: Column) -> Column:
        limit = F.least(F.lit(per_chunk), acc["left"])
        cut = truncate_ellipsis(x["content"], limit)
        useless = (cut == ELLIPSIS) & (x["content"] != ELLIPSIS)
        kept = F.concat(acc["out"], F.array(x.withField("content", cut)))
        return (
            F.when(acc["left"] <= 0, acc)
            .when(useless, F.struct(F.lit(0).alias("left"), acc["out"].alias("out")))
            .otherwise(F.struct((acc["left"] - F.length(cut)).alias("left"), kept.alias("out")))
        )

    start = F.struct(F.lit(total).alias("left"), F.array().cast(f"array<{kind}>").alias("out"))
    packed = per_request.select("request_id", F.inline(F.aggregate("items", start, take, lambda a: a["out"])))
    return packed


DEFAULT_TEMPLATE = (
    "Answer the question from the selected document sources only.\n"
    "<user_question_json>\n{question}\n</user_question_json>\n"
    "<document_sources_json>\n{sources}\n</document_sources_json>\n"
    "Mark every supported statement with its [SOURCE-N].\n"
)


def _fill(template: str, **parts: Column) -> Column:
    import re

    out = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if piece.startswith("{") else None
        out.append(parts[name] if name in parts else F.lit(piece))
    return F.concat(*out)


def build_prompt_rows(
    packed: DataFrame, queries: DataFrame, fields: list[str], template: str = DEFAULT_TEMPLATE
) -> DataFrame:
    """One prompt per request: its question and its packed sources as escaped JSON.

    ``fields`` lists the source columns to show; null ones are left out of the JSON.
    """
    order = F.regexp_extract("source_id", "([0-9]+)", 1).cast("int")
    source = F.struct("source_id", *fields, F.col("prompt_content").alias("content"))
    per = packed.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), source.alias("s")))).alias("l")
    )
    sources = escape_prompt_json(F.to_json(F.transform("l", lambda x: x["s"])))
    question = escape_prompt_json(F.to_json(F.struct("query")))
    df = per.join(queries.select("request_id", "query"), "request_id")
    return df.select(
        "request_id",
        F.size("l").alias("source_count"),
        _fill(template, question=question, sources=sources).alias("user_prompt"),
    )


SYNTHESIS_TEMPLATE = (
    "Combine the partial answers of each document into one answer.\n"
    "<user_question_json>\n{question}\n</user_question_json>\n"
    "<partial_answers_json>\n{partials}\n</partial_answers_json>\n"
    "Use only SOURCE-N ids that occur in the partial answers.\n"
)


def build_synthesis_rows(
    partials: DataFrame, sources: DataFrame, requests: DataFrame, template: str = SYNTHESIS_TEMPLATE
) -> tuple[DataFrame, DataFrame]:
    """One synthesis prompt per request, from partial answers without chunk contents.

    ``partials``: request_id, group_rank, file_idx, answer. ``sources``: request_id,
    file_idx, source_id, chunk_id. Returns the prompts and the rejects.
    """
    cited = sources.groupBy("request_id", "file_idx").agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.regexp_extract("source_id", "([0-9]+)", 1).cast("int").alias("n"), "source_id", "chunk_id")
            )
        ).alias("s")
    )
    df = partials.join(cited, ["request_id", "file_idx"])
    item = F.struct(
        "group_rank",
        F.struct(
            "file_idx",
            F.col("answer").alias("partial_answer"),
            F.col("s.source_id").alias("cited_source_ids"),
            F.transform("s", lambda x: F.struct(x["source_id"], x["chunk_id"])).alias("source_metadata"),
        ).alias("p"),
    )
    per = df.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    text = escape_prompt_json(F.to_json(F.transform("l", lambda x: x["p"])))
    question = escape_prompt_json(F.to_json(F.struct("query")))
    prompts = per.join(requests.select("request_id", "query"), "request_id").select(
        "request_id", F.size("l").alias("partial_count"), _fill(template, question=question, partials=text).alias("user_prompt")
    )
    rejects = final_scope_check(partials, requests)
    for name in ("source_id", "chunk_id"):
        twice = sources.groupBy("request_id", name).count().where("count > 1")
        twice = twice.groupBy("request_id").agg(F.count("*").alias("detail"))
        rejects = rejects.unionByName(twice.select("request_id", F.lit(f"duplicate_{name}").alias("rule"), "detail"))
    return prompts, rejects


def extract_citations(answer: Column) -> Column:
    """Distinct cited ids in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), 1))


def validate_citations(answers: DataFrame, prompt_sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve the citations of each answer.

    ``answers``: request_id, answer, declared (array, null when not declared).
    ``prompt_sources``: request_id, source_id, chunk_id, ... Returns resolved sources in
    citation order, for answers without a broken rule, and the first broken rule of the rest.
    """
    cited = answers.withColumn("cited", extract_citations(F.col("answer")))
    known = prompt_sources.groupBy("request_id").agg(
        F.collect_set("source_id").alias("known"), F.count("*").alias("known_rows")
    )
    df = cited.join(known, "request_id", "left")
    empty = F.array().cast("array<string>")
    unknown = F.size(F.array_except("cited", F.coalesce("known", empty)))
    rule = (
        F.when(F.col("known_rows") > F.size("known"), F.lit("duplicate_prompt_source"))
        .when(F.size("cited") == 0, F.lit("citation_required"))
        .when(F.col("declared").isNotNull() & (F.col("declared") != F.col("cited")), F.lit("declared_citation_mismatch"))
        .when(unknown > 0, F.lit("unknown_source"))
    )
    df = df.withColumn("rule", rule).withColumn("detail", F.size("cited"))
    rejects = df.where(F.col("rule").isNotNull()).select("request_id", "rule", "detail")
    good = df.where(F.col("rule").isNull()).select(
        "request_id", F.posexplode("cited").alias("citation_index", "source_id")
    )
    return good.join(prompt_sources, ["request_id", "source_id"]), rejects


def validate_structured_answer(answers: DataFrame, insufficient: str = INSUFFICIENT_ANSWER) -> DataFrame:
    """First broken rule of each structured answer; status is compared without case.

    ``answers``: request_id, status, answer, cited_source_ids.
    """
    status = F.lower(strip(F.col("status")))
    ids = F.coalesce("cited_source_ids", F.array().cast("array<string>"))
    text = strip(F.col("answer"))
    answered = status == "answered"
    rule = (
        F.when(~F.coalesce(status.isin("answered", "insufficient_evidence"), F.lit(False)), F.lit("invalid_status"))
        .when(F.coalesce(text, F.lit("")) == "", F.lit("empty_answer"))
        .when(F.exists(ids, lambda x: ~x.rlike(SOURCE_ID)), F.lit("invalid_source_id"))
        .when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("duplicate_source_id"))
        .when(answered & (F.size(ids) == 0), F.lit("answered_without_sources"))
        .when(answered & (text == insufficient), F.lit("answered_with_insufficient_text"))
        .when(~answered & (F.size(ids) > 0), F.lit("insufficient_with_sources"))
        .when(~answered & (text != insufficient), F.lit("insufficient_without_fixed_text"))
    )
    return answers.select("request_id", rule.alias("rule")).where(F.col("rule").isNotNull())


def answer_status(
    requests: DataFrame, hits: DataFrame, answers: DataFrame, insufficient: str = INSUFFICIENT_ANSWER
) -> DataFrame:
    """Final status per request: no hits, or the fixed text, mean insufficient evidence."""
    found = hits.groupBy("request_id").agg(F.count("*").alias("hit_count"))
    df = requests.select("request_id").join(found, "request_id", "left").join(
        answers.select("request_id", "status", "answer"), "request_id", "left"
    )
    lacking = (
        F.col("hit_count").isNull()
        | (F.lower(strip(F.col("status"))) == "insufficient_evidence")
        | (strip(F.col("answer")) == insufficient)
    )
    status = (
        F.when(F.coalesce(lacking, F.lit(False)), F.lit("insufficient_evidence"))
        .when(F.col("answer").isNull(), F.lit("missing_answer"))
        .otherwise(F.lit("answered"))
    )
    shown = F.when(status == "insufficient_evidence", F.lit(insufficient)).otherwise(F.col("answer"))
    return df.select("request_id", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), status.alias("status"), shown.alias("answer"))


def remap_sources(partials: DataFrame) -> DataFrame:
    """Renumber document-local citations request-wide and rewrite the answer texts.

    ``partials``: request_id, group_rank, file_idx, answer. The documents of a request
    number on from each other; inside one, ids follow the order of first citation. The
    text is cut at its citations and joined again, so no replacement can hit another.
    """
    df = partials.withColumn("_ids", F.array_distinct(F.regexp_extract_all("answer", F.lit(STRICT_CITATION), 1)))
    order = Window.partitionBy("request_id").orderBy("group_rank").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_base", F.coalesce(F.sum(F.size("_ids")).over(order), F.lit(0)))
    number = lambda x: (F.col("_base") + F.array_position("_ids", x)).cast("string")
    tokens = F.transform(
        F.regexp_extract_all("answer", F.lit(STRICT_CITATION), 1),
        lambda x: F.concat(F.lit("[SOURCE-"), number(x), F.lit("]")),
    )
    pieces = F.split("answer", STRICT_CITATION, -1)
    text = F.array_join(F.zip_with(pieces, tokens, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    return df.select(
        *[c for c in partials.columns if c != "answer"],
        text.alias("answer"),
        F.transform("_ids", lambda x: F.concat(F.lit("SOURCE-"), number(x))).alias("source_ids"),
    )


def final_scope_check(cited: DataFrame, requests: DataFrame) -> DataFrame:
    """Cited files that the request had not selected."""
    scope = requests.select("request_id", F.explode("file_idxs").alias("file_idx"))
    out = cited.join(scope, ["request_id", "file_idx"], "left_anti")
    out = out.groupBy("request_id").agg(F.count("*").alias("detail"))
    return out.select("request_id", F.lit("file_outside_scope").alias("rule"), "detail")


def estimate_tokens(*texts: Column, overhead: int = TOKEN_OVERHEAD) -> Column:
    """Upper bound of prompt tokens: UTF-8 bytes of all parts plus a fixed overhead."""
    total = F.lit(overhead)
    for t in texts:
        total = total + F.coalesce(F.octet_length(t), F.lit(0))
    return F.greatest(F.lit(1), total)


def budget_audit(
    calls: DataFrame,
    per_call: int,
    max_calls: int = MAX_CALLS,
    max_input: int = MAX_INPUT_TOKENS,
    max_output: int = MAX_OUTPUT_TOKENS,
) -> DataFrame:
    """Admit each generation call of a request against what the admitted ones used.

    ``calls``: request_id, call_index, estimated_input, requested_output (nullable),
    input_tokens, output_tokens. A refused call uses nothing, so this is a fold. Adds
    ``output_limit`` (null when refused) and ``exceeded`` (the first limit, or null). A call
    whose request or counts are null or negative is refused as ``invalid_amount`` and uses nothing.
    """
    amounts = [F.col(c) >= 0 for c in ("estimated_input", "input_tokens", "output_tokens")]
    valid = F.col("request_id").isNotNull()
    for amount in amounts:
        valid = valid & F.coalesce(amount, F.lit(False))
    invalid = calls.where(~valid).select(
        *calls.columns, F.lit(None).cast("bigint").alias("output_limit"), F.lit("invalid_amount").alias("exceeded")
    )

    def step(state, values):
        n, used_in, used_out = state
        estimate, requested, spent_in, spent_out = values
        if n >= max_calls:
            return state, {"output_limit": None, "exceeded": "call_count"}
        if estimate > max_input - used_in:
            return state, {"output_limit": None, "exceeded": "input_tokens"}
        left = max_output - used_out
        if left <= 0:
            return state, {"output_limit": None, "exceeded": "output_tokens"}
        asked = per_call if requested is None else int(requested)
        limit = min(asked, per_call, left)
        state = (n + 1, used_in + spent_in, used_out + spent_out)
        over = None
        if state[1] > max_input:
            over = "input_tokens"
        elif spent_out > limit or state[2] > max_output:
            over = "output_tokens"
        return state, {"output_limit": int(limit), "exceeded": over}

    folded = ordered_fold(
        calls.where(valid),
        ["request_id"],
        ["call_index"],
        lambda: (0, 0, 0),
        step,
        ["estimated_input", "requested_output", "input_tokens", "output_tokens"],
        "_r",
        "struct<output_limit: bigint, exceeded: string>",
    )
    return folded.select(*calls.columns, "_r.output_limit", "_r.exceeded").unionByName(invalid)


def dedup_citations_by_file(citations: DataFrame, key: str = "message_id") -> DataFrame:
    """First citation of each file of a message, in citation order; reduced map-side."""
    rest = [c for c in citations.columns if c not in (key, "file_idx")]
    first = citations.groupBy(key, "file_idx").agg(F.min_by(F.struct(*rest), "citation_order").alias("c"))
    return first.select(key, "file_idx", "c.*")


def blank_content_rejects(hits: DataFrame) -> DataFrame:
    """Hits without content, which no prompt may hold."""
    return reject_rows(
        hits, ["request_id", "chunk_id"], [("blank_content", strip(F.col("content")) == "", F.col("rank"))]
    )
