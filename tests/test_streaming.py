import tempfile

from pyspark.sql import functions as F

from corpusloom.sources import readers, sinks
from corpusloom.streaming import admission, upserts

SECOND = 1_000_000


def run(stream, source_schema=None):
    out, state = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    q = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def as_stream(spark, df, files=1):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/in"
    for part in range(files):
        df.where(F.col("batch") == part).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)


def requests(spark):
    # Twenty-one requests in a minute, one that is refused again, one after the oldest admitted is too old.
    times = [i * 2 * SECOND for i in range(21)] + [59 * SECOND, 61 * SECOND]
    rows = [(1, i, t, 0 if i < 10 else 1) for i, t in enumerate(times)] + [(2, 100, 5 * SECOND, 0)]
    return spark.createDataFrame(rows, "user_id long, id long, at_us long, batch int")


def test_rate_limit_batch_and_stream(spark):
    df = requests(spark)
    want = {i: True for i in range(20)} | {20: False, 21: False, 22: True, 100: True}
    batch = admission.rate_limit(df.drop("batch"), "user_id", "at_us", "id", block=7 * SECOND)
    assert {r["id"]: r["admitted"] for r in batch.collect()} == want
    streamed = run(admission.rate_limit_stream(as_stream(spark, df, 2), "user_id", "at_us", "id"))
    assert {r["id"]: r["admitted"] for r in streamed.collect()} == want


def test_idempotent_apply(spark):
    rows = [(1, "k", 1, 0), (1, "k", 2, 299 * SECOND), (1, "k", 3, 300 * SECOND), (1, " ", 4, 1), (1, " ", 5, 1), (2, "k", 6, 5)]
    df = spark.createDataFrame(rows, "u int, k string, id long, at_us long").withColumn("batch", F.lit(0))
    want = {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}
    batch = admission.idempotent_apply(df.drop("batch"), "u", "k", "at_us", "id")
    assert {r["id"]: r["applied"] for r in batch.collect()} == want
    streamed = run(admission.idempotent_apply_stream(as_stream(spark, df), "u", "k", "at_us", "id"))
    assert {r["id"]: r["applied"] for r in streamed.collect()} == want


def test_chunk_batches_can_run_again(spark):
    base = spark.createDataFrame([(1, 5, "old"), (2, 1, "keep")], "file_idx long, index_version long, chunk_id string")
    path, outcomes = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    fn = upserts.versioned_chunk_batch(base, path, outcomes)
    first = spark.createDataFrame([(1, 4, "stale"), (3, 1, "new")], base.schema)
    second = spark.createDataFrame([(1, 5, "same"), (3, 2, "newer"), (3, 1, "older")], base.schema)
    for batch_id, batch in ((0, first), (0, first), (1, second), (1, second)):
        fn(batch, batch_id)
    assert {r["chunk_id"] for r in upserts.chunk_state(base, path).collect()} == {"same", "keep", "newer"}
    assert {(r["batch"], r["outcome"]): r["files"] for r in spark.read.parquet(outcomes).collect()} == {(0, "STALE"): 1, (0, "STORED"): 1, (1, "STORED"): 2}


def test_index_versions(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.createDataFrame([("a", 1, True), ("b", 2, True)], "chunk_id string, users_idx long, is_active boolean")
    sinks.write_index(rows, path, 4)
    sinks.write_index(rows.where("chunk_id = 'b'").withColumn("is_active", F.lit(False)), path, 4)
    assert {r["chunk_id"]: r["is_active"] for r in sinks.read_index(spark, path).collect()} == {"a": True, "b": False}


def test_text_files(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, content in (("a.txt", b"\xef\xbb\xbfhi"), ("b.txt", b"%PDF-1"), ("c.txt", b"  \n"), ("d.txt", "글".encode("cp949"))):
        with open(f"{path}/{name}", "wb") as f:
            f.write(content)
    good, bad = readers.read_text_files(spark, path)
    assert {r["path"][-5:]: (r["text"], r["encoding"]) for r in good.collect()} == {"a.txt": ("hi", "utf-8-sig"), "d.txt": ("글", "cp949")}
    assert {r["path"][-5:]: r["problem"] for r in bad.collect()} == {"b.txt": "binary_content", "c.txt": "no_text"}


def test_csv_with_byte_order_mark(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/r.csv"
    names = [f.name for f in readers.schemas.REQUEST_RECORDS.fields]
    ok = dict.fromkeys(names, "1") | {"success": "True", "error_type": "", "operation": "search"}
    bad = ok | {"success": "1"}
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write(",".join(names) + "\n")
        for row in (ok, bad):
            f.write(",".join(row[n] for n in names) + "\n")
    good, rejects = readers.read_request_records(spark, path)
    assert good.first()["success"] is True and good.first()["error_type"] is None and good.count() == 1
    assert [r["bad_column"] for r in rejects.collect()] == ["success"]


def test_text_files_stay_small(spark):
    import glob

    import __spark_entry__ as entry
    from corpusloom.session import ensure_checkpoint_dir

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("en").alias("lang"))
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{shared}/texts-*"))
    assert [tuple(r) for r in entry.queries()["read_text_files"](spark, path).collect()] == [("en", 10000, 0)]
    (folder,) = set(glob.glob(f"{shared}/texts-*")) - before
    assert [r["n"] for r in spark.read.text(f"{folder}/*/*.txt").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).orderBy("n").collect()] == [500, 1000, 1000]
