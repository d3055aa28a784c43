"""Index lifecycle: versioned upserts, current-run guards and snapshots.

Each operator maps whole tables to whole tables: the state after a set of events. On a
table format with transactions the result is one new version, so a reader never sees a
half-applied change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.chunks import reject_rows
from corpusloom.operators.dealing import deal
from corpusloom.operators.ordered import by_group_size, running_max, running_max_small

IDENTITY = ["file_idx", "users_idx", "file_hash", "parser_version", "embedding_model", "index_version"]
OWNER = ["users_idx", "file_idx"]


def exact_document_match(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """Decide per incoming document whether an existing index can be reused.

    Adds rag_document_idx of the live document with the same identity, if any, and
    ``action``: reuse when it is INDEXED, retry when it exists unfinished, else new.
    """
    live = documents.where(F.col("deleted_at").isNull())
    known = live.groupBy(*IDENTITY).agg(
        F.min_by(F.struct("rag_document_idx", "index_status"), "rag_document_idx").alias("_d")
    )
    action = (
        F.when(F.col("_d").isNull(), F.lit("new"))
        .when(F.col("_d.index_status") == "INDEXED", F.lit("reuse"))
        .otherwise(F.lit("retry"))
    )
    return incoming.join(known, IDENTITY, "left").select(
        *incoming.columns, F.col("_d.rag_document_idx").alias("rag_document_idx"), action.alias("action")
    )


def chunk_identity_mismatches(stored: DataFrame, incoming: DataFrame, doc: str = "rag_document_idx") -> DataFrame:
    """Documents whose reused index and incoming chunks differ in any ordered id."""
    keys = [doc, "chunk_index"]
    a = stored.select(*keys, F.col("chunk_id").alias("_stored"))
    b = incoming.select(*keys, F.col("chunk_id").alias("_incoming"))
    both = a.join(b, keys, "full").where(~F.col("_stored").eqNullSafe(F.col("_incoming")))
    return both.groupBy(doc).agg(F.count("*").alias("mismatch_count"))


def upsert_documents(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new documents or overwrite the mutable columns of known ones.

    A known identity keeps its rag_document_idx; it becomes INDEXING again and live. Of
    several incoming rows for one identity the one with the highest ``seq`` wins.
    """
    mutable = [c for c in documents.columns if c not in (*IDENTITY, "rag_document_idx", "index_status", "deleted_at")]
    latest = incoming.groupBy(*IDENTITY).agg(
        F.max_by(F.struct("rag_document_idx", *mutable), "seq").alias("_new")
    )
    kept = documents.groupBy(*IDENTITY).agg(
        F.min_by(F.struct(*[c for c in documents.columns if c not in IDENTITY]), "rag_document_idx").alias("_old")
    )
    both = kept.join(latest, IDENTITY, "full")
    touched = F.col("_new").isNotNull()

    def pick(c: str) -> Column:
        if c in IDENTITY:
            return F.col(c)
        if c == "rag_document_idx":
            return F.coalesce("_old.rag_document_idx", "_new.rag_document_idx").alias(c)
        if c == "index_status":
            return F.when(touched, F.lit("INDEXING")).otherwise(F.col("_old.index_status")).alias(c)
        if c == "deleted_at":
            return F.when(~touched, F.col("_old.deleted_at")).alias(c)
        return F.when(touched, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)

    return both.select(*[pick(c) for c in documents.columns])


def replace_chunks(chunks: DataFrame, incoming: DataFrame, keys=("rag_document_idx", "index_version")) -> DataFrame:
    """Chunks after each incoming document version replaced its stored chunks."""
    touched = incoming.select(*keys).distinct()
    return chunks.join(touched, list(keys), "left_anti").unionByName(incoming.select(*chunks.columns))


def latest_successful_snapshot(documents: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the newest successfully indexed live document of each (user, file)."""
    live = documents.where((F.col("index_status") == "INDEXED") & F.col("deleted_at").isNull())
    done = runs.where(F.col("status") == "SUCCESS").select("rag_document_idx", *OWNER, "run_id")
    newest = done.join(live, ["rag_document_idx", *OWNER]).groupBy(*OWNER).agg(
        F.max_by(F.struct("rag_document_idx", "index_version", "chunk_count"), "run_id").alias("d")
    )
    current = newest.select(*OWNER, "d.*")
    return current.join(chunks, ["rag_document_idx", "index_version"])


def validate_snapshot(snapshot: DataFrame) -> DataFrame:
    """Broken snapshot contracts as (users_idx, file_idx, rule, detail) rows."""
    per = snapshot.groupBy(*OWNER).agg(
        F.count("*").alias("n"),
        F.min("rag_document_idx").alias("lo_doc"),
        F.max("rag_document_idx").alias("hi_doc"),
        F.max("chunk_count").alias("chunk_count"),
        F.min("chunk_index").alias("lo"),
        F.max("chunk_index").alias("hi"),
    )

    def copies(column: str, name: str) -> DataFrame:
        twice = snapshot.groupBy(*OWNER, column).count().where("count > 1")
        return twice.groupBy(*OWNER).agg(F.count("*").alias(name))

    per = per.join(copies("chunk_index", "dup_index"), OWNER, "left").join(copies("chunk_id", "dup_id"), OWNER, "left")
    per = per.fillna(0, ["dup_index", "dup_id"])
    gap = (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("dup_index") > 0)
    return reject_rows(
        per,
        OWNER,
        [
            ("several_documents", F.col("lo_doc") != F.col("hi_doc"), F.col("n")),
            ("chunk_count_mismatch", F.col("chunk_count") != F.col("n"), F.col("n")),
            ("index_not_contiguous", gap, F.col("n")),
            ("duplicate_chunk_id", F.col("dup_id") > 0, F.col("dup_id")),
        ],
    )


def merge_snapshot_metadata(df: DataFrame, json: str, legacy: dict[str, Column]) -> DataFrame:
    """Merge stored JSON metadata with normalised columns; JSON wins, columns fill gaps.

    Adds ``metadata`` (compact JSON with sorted keys) and ``problem``, which is set, with
    metadata null, for JSON that is no object, has nested objects, or has empty or
    colliding keys after trimming. Missing JSON counts as an empty object.
    """
    raw = F.col(json)
    parsed = F.try_parse_json(F.coalesce(raw, F.lit("{}")))
    df = df.withColumn("_v", parsed)
    shape = F.schema_of_variant("_v")
    df = df.withColumn(
        "_m", F.when(F.startswith(shape, F.lit("OBJECT")), F.expr("try_cast(_v AS map<string, variant>)"))
    )
    keys = F.transform(F.map_keys("_m"), strip)
    nested = F.exists(F.map_values("_m"), lambda v: F.schema_of_variant(v).rlike("^OBJECT|^ARRAY<(OBJECT|ARRAY|VARIANT.*OBJECT)"))
    problem = (
        F.when(raw.isNotNull() & (strip(raw) == ""), F.lit("empty_json"))
        .when(F.col("_m").isNull(), F.lit("not_an_object"))
        .when(F.exists(keys, lambda k: k == ""), F.lit("empty_key"))
        .when(F.size(F.array_distinct(keys)) < F.size(keys), F.lit("duplicate_key"))
        .when(nested, F.lit("nested_object"))
    )
    own = F.transform(F.map_entries("_m"), lambda e: F.struct(strip(e["key"]).alias("k"), F.to_json(e["value"]).alias("v")))
    gaps = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), c.alias("v")) for k, c in legacy.items()]),
        lambda e: e["v"].isNotNull() & ~F.array_contains(keys, e["k"]),
    )
    fields = F.transform(
        F.array_sort(F.concat(own, gaps)), lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["v"])
    )
    text = F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))
    out = df.withColumn("problem", problem)
    return out.withColumn("metadata", F.when(F.col("problem").isNull(), text)).drop("_v", "_m")


def newest_runs(runs: DataFrame, keys: list[str] = OWNER) -> DataFrame:
    """Newest run id per key; a max aggregate instead of a theta self-join."""
    return runs.groupBy(*keys).agg(F.max("run_id").alias("newest_run"))


def mark_success_if_current(runs: DataFrame, finished: DataFrame, partitions: int | None = None) -> DataFrame:
    """Finished runs become SUCCESS when RUNNING and no newer run of (user, file) exists.

    ``finished``: run_id, finished_at. ``partitions`` is the number that runs are dealt into by owner and by run.
    """
    df = deal(runs, OWNER, partitions).join(newest_runs(deal(runs, OWNER, partitions)), OWNER)
    at = finished.select("run_id", F.col("finished_at").alias("_at"))
    df = deal(df, ["run_id"], partitions).join(deal(at, ["run_id"], partitions), "run_id", "left")
    ok = F.col("_at").isNotNull() & (F.col("status") == "RUNNING") & (F.col("run_id") == F.col("newest_run"))
    return df.select(
        *[c for c in runs.columns if c not in ("status", "finished_at")],
        F.when(ok, F.lit("SUCCESS")).otherwise(F.col("status")).alias("status"),
        F.when(ok, F.col("_at")).otherwise(F.col("finished_at") if "finished_at" in runs.columns else F.lit(None)).alias("finished_at"),
    )


def _current_owners(runs: DataFrame, partitions: int | None) -> DataFrame:
    """Documents whose run succeeded and is the newest of its (user, file), dealt by document."""
    ok = deal(runs.where(F.col("status") == "SUCCESS"), OWNER, partitions).join(newest_runs(deal(runs, OWNER, partitions)), OWNER)
    ok = ok.where(F.col("run_id") == F.col("newest_run")).select("rag_document_idx")
    return deal(ok, ["rag_document_idx"], partitions).distinct()


def mark_document_indexed_if_current(documents: DataFrame, runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Documents that own the newest, successful run become INDEXED and live.

    ``partitions`` is the number that rows are dealt into by owner and by document.
    """
    owners = _current_owners(runs, partitions).withColumn("_owner", F.lit(True))
    df = deal(documents, ["rag_document_idx"], partitions).join(owners, "rag_document_idx", "left")
    mine = F.coalesce("_owner", F.lit(False))
    return df.select(
        *[c for c in documents.columns if c not in ("index_status", "deleted_at")],
        F.when(mine, F.lit("INDEXED")).otherwise(F.col("index_status")).alias("index_status"),
        F.when(~mine, F.col("deleted_at")).alias("deleted_at"),
    )


def soft_delete_superseded(documents: DataFrame, runs: DataFrame, now: Column, partitions: int | None = None) -> DataFrame:
    """Delete other live INDEXED documents of a (user, file) with a current document.

    ``partitions`` is the number that rows are dealt into by owner and by document.
    """
    live = (F.col("index_status") == "INDEXED") & F.col("deleted_at").isNull()
    current = deal(documents.where(live), ["rag_document_idx"], partitions).join(_current_owners(runs, partitions), "rag_document_idx")
    current = deal(current.select(*OWNER, "rag_document_idx"), OWNER, partitions).groupBy(*OWNER).agg(F.max("rag_document_idx").alias("_current"))
    df = deal(documents, OWNER, partitions).join(current, OWNER, "left")
    gone = live & F.col("_current").isNotNull() & (F.col("rag_document_idx") != F.col("_current"))
    return df.select(
        *[c for c in documents.columns if c != "deleted_at"],
        F.when(gone, now).otherwise(F.col("deleted_at")).alias("deleted_at"),
    )


def mark_failed(documents: DataFrame, runs: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed runs and their documents.

    A RUNNING run in ``failures`` (run_id, error_message) becomes FAILED; a document that
    is INDEXING becomes FAILED when its newest run is one of those.
    """
    df = runs.join(failures.select("run_id", F.col("error_message").alias("_e")), "run_id", "left")
    failed = F.col("_e").isNotNull() & (F.col("status") == "RUNNING")
    new_runs = df.select(
        *[c for c in runs.columns if c != "status"],
        F.when(failed, F.lit("FAILED")).otherwise(F.col("status")).alias("status"),
        F.when(failed, F.col("_e")).alias("error_message"),
    )
    last = new_runs.groupBy("rag_document_idx").agg(F.max_by(F.struct("status", "error_message"), "run_id").alias("_r"))
    docs = documents.join(last, "rag_document_idx", "left")
    hit = (F.col("index_status") == "INDEXING") & (F.col("_r.status") == "FAILED") & F.col("_r.error_message").isNotNull()
    new_docs = docs.select(
        *[c for c in documents.columns if c != "index_status"],
        F.when(F.coalesce(hit, F.lit(False)), F.lit("FAILED")).otherwise(F.col("index_status")).alias("index_status"),
    )
    return new_runs, new_docs


def activate_documents(points: DataFrame, activations: DataFrame) -> DataFrame:
    """Points after switching documents on or off; ``activations``: rag_document_idx, active.

    All switches land in one table version, so there is neither an overlap nor a gap. A
    document switched both ways ends up on.
    """
    flags = activations.groupBy("rag_document_idx").agg(F.max("active").alias("_active"))
    df = points.join(flags, "rag_document_idx", "left")
    return df.select(
        *[c for c in points.columns if c != "is_active"],
        F.coalesce("_active", "is_active").alias("is_active"),
    )


def stale_version_guard(stored: DataFrame, incoming: DataFrame, partitions: int | None = None) -> DataFrame:
    """Outcome per incoming (file, version): STALE below the stored version, NO_DATA, or STORED.

    ``incoming``: file_idx, index_version, n_chunks. ``stored``: file_idx, index_version.
    ``partitions`` is the number that rows are dealt into by file.
    """
    stored = deal(stored.select("file_idx", "index_version"), ["file_idx"], partitions)
    incoming = deal(incoming, ["file_idx"], partitions)
    current = stored.groupBy("file_idx").agg(F.max("index_version").alias("stored_version"))
    outcome = (
        F.when(F.col("index_version").isNull() | (F.coalesce("n_chunks", F.lit(0)) == 0), F.lit("NO_DATA"))
        .when(F.col("index_version") < F.col("stored_version"), F.lit("STALE"))
        .otherwise(F.lit("STORED"))
    )
    return incoming.join(current, "file_idx", "left").withColumn("outcome", outcome)


def apply_chunk_sync(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunks after a batch of synchronised documents.

    ``incoming`` holds chunk rows. The batch is reduced to the highest version of each
    file first; an equal version replaces, a lower one is dropped.
    """
    versions = incoming.groupBy("file_idx", "index_version").agg(F.count("*").alias("n_chunks"))
    newest = versions.groupBy("file_idx").agg(F.max_by(F.struct("index_version", "n_chunks"), "index_version").alias("v"))
    judged = stale_version_guard(stored, newest.select("file_idx", "v.*")).where("outcome = 'STORED'")
    winners = judged.select("file_idx", "index_version")
    return stored.join(winners.select("file_idx"), "file_idx", "left_anti").unionByName(
        incoming.join(winners, ["file_idx", "index_version"], "left_semi").select(*stored.columns)
    )


def validate_callback(callbacks: DataFrame, keys: list[str]) -> DataFrame:
    """Callbacks without a version, without chunks, or with a wrong chunk count."""
    n = F.coalesce("n_chunks", F.lit(0))
    return reject_rows(
        callbacks,
        keys,
        [
            ("missing_version", F.col("index_version").isNull(), n),
            ("no_chunks", n == 0, n),
            ("chunk_count_mismatch", F.col("chunk_count").isNull() | (F.col("chunk_count") != n), n),
        ],
    )


def summarize_applicable(stored: DataFrame, incoming: DataFrame, aggs: list[Column], partitions: int | None = None) -> DataFrame:
    """Aggregates, per file, of the callbacks that apply: those not older than any version before them.

    ``stored``: file_idx, index_version. The version reached before a callback is a running maximum, in
    one window for a file of few callbacks, in blocks for a large one.
    """
    base = deal(stored.select("file_idx", F.col("index_version").alias("_stored")), ["file_idx"], partitions)
    small, large = by_group_size(deal(incoming, ["file_idx"], partitions), ["file_idx"])
    reached = {"_before": F.col("index_version")}

    def summary(df: DataFrame) -> DataFrame:
        floor = F.greatest("_stored", "_before")
        applies = F.col("index_version").isNull() | floor.isNull() | (F.col("index_version") >= floor)
        return df.where(applies).groupBy("file_idx").agg(*aggs)

    few = summary(running_max_small(small.join(base, "file_idx", "left"), ["file_idx"], "seq", reached))
    many = summary(running_max(large.join(base, "file_idx", "left"), ["file_idx"], "seq", reached))
    return few.unionByName(many)


def metadata_version_upsert(stored: DataFrame, incoming: DataFrame, values: list[str], partitions: int | None = None) -> DataFrame:
    """Metadata after a batch of callbacks, guarded by version.

    ``incoming``: file_idx, seq, success, index_version and the value columns. A callback
    applies when it has no version, when none is stored, or when it is not older than the
    stored one; a failure changes only the status. Callbacks of one file apply in order,
    so the last applicable one decides the status and the last success the values.
    ``partitions`` is the number that rows are dealt into by file.
    """
    done = F.col("success")
    aggs = [
        F.max_by("success", "seq").alias("_ok"),
        F.max("index_version").alias("_version"),
        F.max_by(F.struct(*values), F.when(done, F.col("seq"))).alias("_new"),
        F.max(F.when(done, F.col("seq"))).alias("_any"),
    ]
    last = deal(summarize_applicable(stored, incoming, aggs, partitions), ["file_idx"], partitions)
    both = deal(stored, ["file_idx"], partitions).join(last, "file_idx", "full")
    hit = F.col("_ok").isNotNull()
    return both.select(
        "file_idx",
        *[F.when(F.col("_any").isNotNull(), F.col(f"_new.{v}")).otherwise(F.col(v)).alias(v) for v in values],
        F.when(hit, F.when(F.col("_ok"), F.lit("READY")).otherwise(F.lit("FAILED"))).otherwise(F.col("extraction_status")).alias("extraction_status"),
        F.when(hit, F.coalesce("_version", "index_version")).otherwise(F.col("index_version")).alias("index_version"),
    )


def extract_page(meta: Column) -> Column:
    """Page number of a chunk's metadata as an integer; fractions are cut, texts give null."""
    kind = F.schema_of_variant(F.try_variant_get(meta, "$.page_number", "variant"))
    number = (kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(number, F.try_variant_get(meta, "$.page_number", "double").cast("int"))


def chunk_sync_payload(chunks: DataFrame, doc: list[str], fields: list[str]) -> DataFrame:
    """One snapshot row per document with its chunks in order; a document bounds the array."""
    per = chunks.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("chunks"))
    return per.withColumn("chunk_count", F.size("chunks"))
