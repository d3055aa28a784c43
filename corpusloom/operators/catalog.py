"""Catalog queries: files, metadata, jobs, quotas, accounts, conversations."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import escape_like, file_extension, strip
from corpusloom.operators.chunks import reject_rows
from corpusloom.operators.dealing import deal
from corpusloom.operators.ordered import ordered_fold

# Upload limits and metadata limits.
MAX_UPLOAD_FILES = 5
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
ALLOWED_EXTENSIONS = ("pdf", "docx", "pptx", "xlsx", "txt")
MAX_TAGS = 30
MAX_TAG_CHARS = 50
MAX_LIST_ITEMS = 5
SAMPLE_CHUNKS = 6
SAMPLE_CHARS = 4000
SUSPENSIONS = ("TEMP_SUSPEND", "PERMANENT_SUSPEND")
# Fixed value: numbered default titles.
NUMBERED_TITLE = "^대화 ([1-9][0-9]*)\\z"
# Fixed value: characters a plain (ASCII) trim removes.
ASCII_BLANKS = "".join(map(chr, range(0x21)))


def is_live() -> Column:
    return F.col("deleted_at").isNull()


def day_range(column: Column, first: str | None, last: str | None) -> Column:
    """Whole days from ``first`` to ``last``, both inclusive, as a half-open time range."""
    ok = F.lit(True)
    if first is not None:
        ok = ok & (column >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz"))
    if last is not None:
        ok = ok & (column < F.lit(f"{last} 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return ok


def json_list(c: Column) -> Column:
    """A JSON array of texts; anything else is the empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def search_files(
    files: DataFrame,
    metadata: DataFrame,
    user: int | None = None,
    folder: int | None = None,
    keyword: str | None = None,
    file_type: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    document_type: str | None = None,
    tag: str | None = None,
) -> DataFrame:
    """Live files that meet every given condition, newest first.

    The keyword is matched literally; a tag matches by membership, not as a part of the
    stored JSON text.
    """
    out = files.where(is_live() & day_range(F.col("created_at"), date_from, date_to))
    if user is not None:
        out = out.where(F.col("users_idx") == user)
    if folder is not None:
        out = out.where(F.col("folder_idx") == folder)
    if keyword is not None:
        pattern = F.concat(F.lit("%"), escape_like(F.lit(keyword)), F.lit("%"))
        out = out.where(F.like(F.col("name"), pattern, F.lit("\\")))
    if file_type is not None:
        out = out.where(F.col("file_type") == file_type)
    if document_type is not None:
        known = metadata.where(F.col("document_type") == document_type)
        out = out.join(known.select("file_idx"), "file_idx", "left_semi")
    if tag is not None:
        tagged = metadata.where(F.array_contains(json_list(F.col("tags")), tag))
        out = out.join(tagged.select("file_idx"), "file_idx", "left_semi")
    return out.orderBy(F.desc("created_at"), "file_idx")


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered result."""
    return df.offset(number * size).limit(size)


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def files_with_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files with summary, tags, keywords and entities; missing or broken JSON gives empty values."""
    m = metadata.select("file_idx", "summary", "tags", "keywords", "entities")
    df = files.join(m, "file_idx", "left")
    kind = "dates array<string>, people array<string>, amounts array<string>, project string"
    e = F.from_json("entities", kind)
    empty = F.array().cast("array<string>")
    entities = F.struct(
        *[F.coalesce(e[n], empty).alias(n) for n in ("dates", "people", "amounts")], e["project"].alias("project")
    )
    return df.select(
        *files.columns,
        F.coalesce("summary", F.lit("")).alias("summary"),
        json_list(F.col("tags")).alias("tags"),
        json_list(F.col("keywords")).alias("keywords"),
        entities.alias("entities"),
    )


def client_filter(
    docs: DataFrame,
    search: str = "",
    closure: DataFrame | None = None,
    folder: int | None = None,
    unclassified: bool = False,
    starred: bool = False,
    file_type: str | None = None,
    document_type: str | None = None,
    tag: str = "",
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Filter of a document list: text in name, summary, tags or keywords, subtree, flags, dates."""
    words = F.concat("tags", "keywords")

    def mentions(text: str) -> Column:
        needle = text.lower()
        return F.exists(words, lambda w: F.lower(w).contains(needle))

    ok = F.lower("name").contains(search.lower()) | F.lower("summary").contains(search.lower()) | mentions(search)
    out = docs.where(ok & day_range(F.col("created_at"), date_from, date_to))
    if unclassified:
        out = out.where(F.col("folder_idx").isNull())
    elif folder is not None:
        below = closure.where(F.col("ancestor") == folder).select(F.col("descendant").alias("folder_idx"))
        out = out.join(below, "folder_idx", "left_semi")
    if starred:
        out = out.where("star")
    if file_type is not None:
        out = out.where(F.col("file_type") == file_type)
    if document_type is not None:
        out = out.where(F.col("document_type") == document_type)
    if tag.strip():
        out = out.where(mentions(tag.strip()))
    return out


def storage_usage(users: DataFrame, files: DataFrame, quota: int) -> DataFrame:
    """Bytes of live files per user, against the quota."""
    used = files.where(is_live()).groupBy("users_idx").agg(F.sum("size_bytes").alias("used_bytes"))
    df = users.select("users_idx").join(used, "users_idx", "left").fillna(0, ["used_bytes"])
    return df.withColumn("quota_bytes", F.lit(quota).cast("long")).withColumn(
        "over_quota", F.col("used_bytes") > quota
    )


def quota_check(batches: DataFrame, usage: DataFrame, quota: int) -> DataFrame:
    """Decide upload batches in arrival order: accepted, rejected, existing, or invalid.

    ``batches``: users_idx, arrival, idempotency_key (nullable), incoming_bytes. A key
    that was accepted before is answered as existing and uses nothing. While a user's batches
    stream by, only keys that come again are remembered, and each until its last arrival, which is
    worked out beforehand; so what is held are the keys that are open at one time. A batch without an owner, or whose
    size is null or negative, is invalid and takes no part in the decisions.
    """
    valid = F.coalesce(F.col("users_idx").isNotNull() & (F.col("incoming_bytes") >= 0), F.lit(False))
    invalid = batches.where(~valid).withColumn("outcome", F.lit("invalid"))
    batches = batches.where(valid)
    repeats = batches.where(F.col("idempotency_key").isNotNull()).groupBy("users_idx", "idempotency_key").agg(
        (F.count("*") > 1).alias("_repeats"), F.max("arrival").alias("_last")
    )
    df = batches.join(repeats, ["users_idx", "idempotency_key"], "left").select(*batches.columns, "_repeats", "_last")
    df = df.join(usage.select("users_idx", F.col("used_bytes").alias("_used")), "users_idx", "left")
    df = df.withColumn("_used", F.coalesce("_used", F.lit(0))).withColumn("_repeats", F.coalesce("_repeats", F.lit(False)))

    folded = ordered_fold(
        df, ["users_idx"], ["arrival"], _QuotaState, lambda state, values: (state, state.decide(quota, *values)),
        ["arrival", "idempotency_key", "_repeats", "_last", "incoming_bytes", "_used"], "outcome", "string",
    )
    return folded.drop("_repeats", "_used", "_last").unionByName(invalid)


class _QuotaState:
    """Bytes that one user has added, and the accepted keys that will come again."""

    def __init__(self) -> None:
        self.added = 0
        self.open: set[str] = set()
        self.ends: list[tuple] = []  # heap of (last arrival, key)

    def decide(self, quota: int, arrival, key: str | None, repeats: bool, last, size: int, used: int) -> str:
        # Equal arrivals may still be of a key whose last arrival this is.
        while self.ends and arrival is not None and self.ends[0][0] < arrival:
            self.open.discard(heapq.heappop(self.ends)[1])
        if repeats and key in self.open:
            return "existing"
        if used + self.added + size > quota:
            return "rejected"
        if repeats:
            self.open.add(key)
            if last is not None:
                heapq.heappush(self.ends, (last, key))
        self.added += size
        return "accepted"


def validate_upload(files: DataFrame, batch: str) -> DataFrame:
    """Broken upload rules per batch; detail counts the files concerned."""
    per = files.groupBy(batch).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("size_bytes") == 0).alias("empty"),
        F.count_if(F.col("size_bytes") > MAX_UPLOAD_BYTES).alias("large"),
        F.count_if(~file_extension(F.col("name")).isin(*ALLOWED_EXTENSIONS)).alias("foreign"),
    )
    return reject_rows(
        per,
        [batch],
        [
            ("too_many_files", F.col("n") > MAX_UPLOAD_FILES, F.col("n")),
            ("empty_file", F.col("empty") > 0, F.col("empty")),
            ("file_too_large", F.col("large") > 0, F.col("large")),
            ("unsupported_extension", F.col("foreign") > 0, F.col("foreign")),
        ],
    )


def users_with_document_count(users: DataFrame, files: DataFrame) -> DataFrame:
    """Users with the number of their live files, newest users first."""
    counts = files.where(is_live()).groupBy("users_idx").agg(F.count("*").alias("document_count"))
    df = users.join(counts, "users_idx", "left").fillna(0, ["document_count"])
    return df.orderBy(F.desc("created_at"), "users_idx")


def recent_files(files: DataFrame, limit: int) -> DataFrame:
    """Newest live files of each user; the limit is held between 1 and 100."""
    n = max(1, min(limit, 100))
    order = Window.partitionBy("users_idx").orderBy(F.desc("created_at"), "file_idx")
    return files.where(is_live()).withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def latest_job_per_file(
    jobs: DataFrame, job_type: str | None = None, statuses: tuple[str, ...] | None = None
) -> DataFrame:
    """Newest job of each file, of one type or within a status set; reduced map-side."""
    if job_type is not None:
        jobs = jobs.where(F.col("job_type") == job_type)
    if statuses is not None:
        jobs = jobs.where(F.col("job_status").isin(*statuses))
    rest = [c for c in jobs.columns if c != "file_idx"]
    newest = jobs.groupBy("file_idx").agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "job_idx")).alias("j")
    )
    return newest.select("file_idx", "j.*")


def file_status(files: DataFrame, jobs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Status of each file with the attempts of its latest job and its extraction status."""
    latest = latest_job_per_file(jobs).select("file_idx", "attempts")
    m = metadata.select("file_idx", "extraction_status")
    df = files.select("file_idx", "status").join(latest, "file_idx", "left").join(m, "file_idx", "left")
    return df.fillna(0, ["attempts"])


def all_owned(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Whether every distinct file of a request is live and owned by its user."""
    asked = requests.select("request_id", "user_idx", F.explode(F.array_distinct("file_idxs")).alias("file_idx"))
    live = files.where(is_live()).select("file_idx", F.col("users_idx").alias("_owner"))
    df = asked.join(live, "file_idx", "left")
    return df.groupBy("request_id").agg(
        F.count("*").alias("asked"),
        F.count_if(F.col("_owner") == F.col("user_idx")).alias("owned"),
        (F.count("*") == F.count_if(F.col("_owner") == F.col("user_idx"))).alias("all_owned"),
    )


def normalize_tags(tags: Column) -> Column:
    """Trimmed tags without empty, long or repeated ones, at most thirty."""
    trimmed = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.btrim(t, F.lit(ASCII_BLANKS)))
    kept = F.filter(trimmed, lambda t: (t != "") & (F.length(t) <= MAX_TAG_CHARS))
    return F.coalesce(F.slice(F.array_distinct(kept), 1, MAX_TAGS), F.array().cast("array<string>"))


def sample_for_metadata(chunks: DataFrame, max_chunks: int = SAMPLE_CHUNKS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Text sample of each file: its first chunks, blank-line separated and cut."""
    order = Window.partitionBy("file_idx").orderBy("chunk_index", "chunk_id")
    first = chunks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_chunks)
    first = first.where(F.col("content").isNotNull())
    per = first.groupBy("file_idx").agg(F.array_sort(F.collect_list(F.struct("_n", "content"))).alias("l"))
    return per.select("file_idx", F.left(F.array_join(F.col("l.content"), "\n\n"), F.lit(max_chars)).alias("sample"))


def clean_generated_metadata(df: DataFrame, document_types: tuple[str, ...], max_summary: int) -> DataFrame:
    """Generated metadata in bounds; a blank summary means the generation failed.

    ``df``: summary, keywords, dates, people, amounts, confidence, document_type.
    """
    summary = F.left(F.btrim("summary", F.lit(ASCII_BLANKS)), F.lit(max_summary))
    ok = F.coalesce(strip(summary) != "", F.lit(False))
    confidence = F.col("confidence")
    finite = ~F.isnan(confidence) & (F.abs(confidence) < float("inf"))
    kind = F.btrim("document_type", F.lit(ASCII_BLANKS))
    cleaned = {
        "summary": summary,
        **{n: F.slice(n, 1, MAX_LIST_ITEMS) for n in ("keywords", "dates", "people", "amounts")},
        "confidence": F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))),
        "document_type": F.when(kind.isin(*document_types), kind),
    }
    rest = [c for c in df.columns if c not in cleaned]
    return df.select(
        *rest,
        F.when(ok, F.lit("READY")).otherwise(F.lit("FAILED")).alias("extraction_status"),
        *[F.when(ok, c).alias(n) for n, c in cleaned.items()],
    )


def pending_metadata_files(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Ready live files whose metadata waits for generation, in order."""
    ready = files.where((F.col("status") == "READY") & is_live()).select("file_idx")
    waiting = metadata.where(F.col("extraction_status") == "PROCESSING").select("file_idx")
    return waiting.join(ready, "file_idx").orderBy("file_idx")


def claimed_metadata_version(pending: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claimed files with the highest version of their chunks."""
    newest = chunks.groupBy("file_idx").agg(F.max("index_version").alias("extraction_index_version"))
    return pending.select("file_idx").join(newest, "file_idx", "left").withColumn("extraction_status", F.lit("GENERATING"))


def coalesce_document_type(stored: Column, generated: Column) -> Column:
    """A type the user has set wins over a generated one."""
    return F.coalesce(F.nullif(stored, F.lit("")), generated)


def dashboard_counts(files: DataFrame) -> DataFrame:
    """Totals of a document list."""
    return files.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("star")).alias("starred"),
        F.count_if(F.col("status").isin("PROCESSING", "UPLOADED")).alias("processing"),
    )


def root_folder_counts(files: DataFrame, folders: DataFrame, closure: DataFrame) -> DataFrame:
    """Documents below each root folder, plus one row for those in no folder.

    Files are counted per folder before they meet the tree.
    """
    direct = files.groupBy("folder_idx").agg(F.count("*").alias("n"))
    roots = folders.where(F.col("parent_folder_idx").isNull()).select(F.col("folder_idx").alias("ancestor"), "name")
    per = closure.join(direct.withColumnRenamed("folder_idx", "descendant"), "descendant")
    per = per.groupBy("ancestor").agg(F.sum("n").alias("document_count"))
    rooted = roots.join(per, "ancestor", "left").fillna(0, ["document_count"])
    loose = direct.where(F.col("folder_idx").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("document_count"))
    loose = loose.select(F.lit(None).cast("long").alias("folder_idx"), F.lit("unclassified").alias("name"), "document_count")
    return rooted.select(F.col("ancestor").alias("folder_idx"), "name", "document_count").unionByName(loose).orderBy(F.desc("document_count"))


def sanction_history(sanctions: DataFrame) -> DataFrame:
    return sanctions.orderBy("users_idx", F.desc("started_at"), "sanction_idx")


def active_suspension(sanctions: DataFrame) -> DataFrame:
    """Newest active suspension of each user; deletions are no suspensions."""
    active = sanctions.where((F.col("status") == "ACTIVE") & F.col("sanction_type").isin(*SUSPENSIONS))
    newest = active.groupBy("users_idx").agg(
        F.max_by(F.struct("sanction_idx", "sanction_type", "started_at"), F.struct("started_at", "sanction_idx")).alias("s")
    )
    return newest.select("users_idx", "s.*")


def token_state(revoked_at: Column, expires_at: Column, now: Column) -> Column:
    """revoked, expired (at or before now), or valid."""
    return (
        F.when(revoked_at.isNotNull(), F.lit("revoked"))
        .when(expires_at <= now, F.lit("expired"))
        .otherwise(F.lit("valid"))
    )


def conversation_list(conversations: DataFrame) -> DataFrame:
    """Live conversations of each user, latest activity first."""
    return conversations.where(~F.col("del")).orderBy("users_idx", F.desc("updated_at"), "conversation_idx")


def next_default_title(titles: DataFrame, users: DataFrame, prefix: str = "대화 ", pattern: str = NUMBERED_TITLE) -> DataFrame:
    """Smallest free number of each user's numbered titles.

    The answer is the lowest n + 1 that is not taken, over the taken numbers and zero.
    """
    number = F.regexp_extract("title", pattern, 1).try_cast("int")
    taken = titles.select("users_idx", number.alias("n")).where(F.col("n").isNotNull()).distinct()
    starts = users.select("users_idx", F.lit(0).alias("n")).unionByName(taken)
    free = starts.select("users_idx", (F.col("n").cast("long") + 1).alias("n"))
    free = free.join(taken.withColumn("n", F.col("n").cast("long")), ["users_idx", "n"], "left_anti")
    best = free.groupBy("users_idx").agg(F.min("n").alias("number"))
    return best.withColumn("title", F.concat(F.lit(prefix), F.col("number").cast("string")))


def message_history(messages: DataFrame, citations: DataFrame, files: DataFrame) -> DataFrame:
    """Messages with their citations in order and their reference files in list order.

    Current file names replace the stored ones. Citations and references are at most
    twenty per message.
    """
    names = files.select("file_idx", F.col("name").alias("_now"))
    cited = citations.join(names, "file_idx", "left").groupBy("message_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("citation_order", "source_id", "file_idx", F.coalesce("_now", "file_name").alias("file_name"))
            )
        ).alias("citations")
    )
    ids = F.from_json("reference_file_idxs", "array<bigint>")
    listed = messages.select("message_id", F.posexplode(ids).alias("_p", "file_idx")).join(names, "file_idx", "left")
    references = listed.groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.struct("_p", "file_idx", F.col("_now").alias("name")))).alias("references")
    )
    return messages.join(cited, "message_id", "left").join(references, "message_id", "left")


def citations_from_sources(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations to store: sources whose chunk exists, renumbered without gaps."""
    known = chunks.groupBy("chunk_id", "file_idx").agg(F.min("chunk_index").alias("chunk_index"))
    kept = sources.join(known, ["chunk_id", "file_idx"])
    order = Window.partitionBy("message_id").orderBy("source_order")
    return kept.withColumn("citation_order", F.row_number().over(order))


def total_tokens(input_tokens: Column, output_tokens: Column) -> Column:
    """Sum of both counts, null when one is missing."""
    return input_tokens + output_tokens


def cascade_delete(deleted: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each dependent table without the rows of the deleted files."""
    ids = deleted.select("file_idx").distinct()
    return {name: df.join(ids, "file_idx", "left_anti") for name, df in tables.items()}


def owned_row_counts(owned: DataFrame, tables: dict[str, DataFrame], partitions: int | None = None) -> DataFrame:
    """Rows that each table still holds for a set of (user, file) owners, with the total.

    ``partitions`` is the number that rows are dealt into by owner.
    """
    keys = ["users_idx", "file_idx"]
    ids = deal(owned.select(*keys), keys, partitions).distinct()
    parts = None
    for name, df in tables.items():
        hit = deal(df.select(*keys), keys, partitions).join(ids, keys, "left_semi").agg(F.count("*").alias("row_count"))
        row = hit.select(F.lit(name).alias("table_name"), "row_count")
        parts = row if parts is None else parts.unionByName(row)
    total = parts.agg(F.sum("row_count").alias("row_count")).select(F.lit("total").alias("table_name"), "row_count")
    return parts.unionByName(total).withColumn("is_clean", F.col("row_count") == 0)
