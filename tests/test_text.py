import re
import tempfile
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import binary, redact, text
from corpusloom.functions.identity import CHUNK_NAMESPACE, uuid5

SAMPLES = [
    "",
    "  a \r\n\r\n\r\n\r\nb\t \rc\x00d  ",
    "x y　\n  z w\x1f",
    "one.\n\n\n\ntwo  \n three",
    "ﬁ ½ Å café​﻿� wo-\nrd ( a ) , b !",
    "한글 문장。 다음 문장! [SOURCE-1] 끝",
    "\n\n",
]


def values(spark, expr, samples=SAMPLES):
    rows = [(i, s) for i, s in enumerate(samples)]
    df = spark.createDataFrame(rows, "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def plain_normalize(s):
    s = s.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in s.split("\n"))).strip()


def test_strip_is_unicode_aware(spark):
    assert values(spark, text.strip) == [s.strip() for s in SAMPLES]
    assert values(spark, text.rstrip) == [s.rstrip() for s in SAMPLES]


def test_normalize(spark):
    assert values(spark, text.normalize_text) == [plain_normalize(s) for s in SAMPLES]
    inline = [" ".join(p.strip() for p in plain_normalize(s).splitlines() if p.strip()) for s in SAMPLES]
    assert values(spark, text.normalize_inline_text) == inline


def test_nfkc_and_noise(spark):
    assert values(spark, text.nfkc) == [unicodedata.normalize("NFKC", s) for s in SAMPLES]
    assert values(spark, lambda c: text.normalize_noisy_text(c, 100))[4] == "fi 1⁄2 Å café word (a), b!"
    assert values(spark, lambda c: text.normalize_noisy_text(c, 9))[4] == "fi 1⁄2 Å"
    assert values(spark, text.strip_control_chars, ["a\x00b\tc\nd\x85"]) == ["ab\tc\nd"]


def test_truncations_differ(spark):
    s = ["abc def ghi"]
    assert values(spark, lambda c: text.truncate_ellipsis(c, 5), s) == ["abc…"]
    assert values(spark, lambda c: text.truncate_ellipsis(c, 1), s) == ["…"]
    assert values(spark, lambda c: text.snippet(c, 4), s) == ["abc …"]
    assert values(spark, lambda c: text.truncate_log(c, 16), ["x" * 17]) == ["xx...<truncated>"]


def test_single_line_and_like(spark):
    assert values(spark, text.single_line, ["a\r\n\tb\x1b\x7f"]) == ["a\\r\\n\\tb\\u001b\\u007f"]
    assert values(spark, text.escape_like, ["50%_a\\"]) == ["50\\%\\_a\\\\"]


def test_sizes(spark):
    sizes = ["1.5GiB", " 2 kB ", "3", "4 XB", "0.1MB"]
    assert values(spark, text.parse_human_size, sizes) == [1610612736, 2000, None, None, 100000]
    assert values(spark, text.parse_percent, [" 12.5% ", "x%"]) == [12.5, None]
    assert values(spark, text.optional_float, ["", "n/a", "1e3", "1d"]) == [None, None, 1000.0, None]
    shown = values(spark, lambda c: text.format_bytes(c.cast("long")), ["0", "512", "1536", "1048576"])
    assert shown == ["0 KB", "512 B", "1.5 KB", "1.0 MB"]


def test_names(spark):
    assert values(spark, text.file_extension, ["a.PDF", "a.", "a", "a.b.c"]) == ["pdf", "", "", "c"]
    assert values(spark, lambda c: text.build_file_name(c, F.lit(".Pdf")), ["n.PDF", "n"]) == ["n.pdf", "n.pdf"]


def test_query_from_content(spark):
    assert values(spark, text.query_from_content, ["Short. Then more text.", "A long sentence! Next."]) == [
        "Short. Then more text.",
        "A long sentence!",
    ]


def test_citation_context(spark):
    s = ["First. Second [SOURCE-1] statement", "A\nB [SOURCE-2]. "]
    assert values(spark, text.citation_context, s) == ["Second  statement", "B ."]


@pytest.mark.parametrize(
    "line, clean",
    [
        ('password="p w" x', 'password="[REDACTED]" x'),
        ("api_key: k1, ok", "api_key: [REDACTED], ok"),
        ("Authorization: Bearer abc.d then", "Authorization: [REDACTED] then"),
        ("go https://h/x?X-Amz-Signature=1&b=2 ok", "go [REDACTED_PRESIGNED_URL] ok"),
        ("mysql+pymysql://u:p@h/d ok", "[REDACTED_DATABASE_DSN] ok"),
        ("/cb?a=1&token=zz#f", "/cb?a=1&token=[REDACTED]#f"),
        ("\x1b[31mred\x1b[0m bearer abc", "red Bearer [REDACTED]"),
        ("plain", "plain"),
    ],
)
def test_redact_text(spark, line, clean):
    assert values(spark, redact.redact_text, [line]) == [clean]


def test_encodings(spark):
    korean = "안녕하세요 문서입니다".encode("cp949")
    rows = [
        ("utf-8", "abc é".encode()),
        ("utf-8-sig", b"\xef\xbb\xbfabc"),
        ("utf-16", "abc".encode("utf-16")),
        ("utf-32", "abc".encode("utf-32")),
        ("cp949", korean),
        ("cp1252", "café déjà".encode("latin-1")),
    ]
    df = spark.createDataFrame(rows, "want string, content binary")
    df = df.withColumn("got", binary.detect_encoding(F.col("content")))
    df = df.withColumn("text", binary.decode_bytes(F.col("content"), F.col("got")))
    out = {r["want"]: (r["got"], r["text"]) for r in df.collect()}
    assert all(want == got for want, (got, _) in out.items())
    assert out["cp949"][1] == "안녕하세요 문서입니다" and out["utf-16"][1] == "abc"


def test_accents_that_are_also_hangul():
    for western in ("Çèen en vich de.", "Èçvi de, ççle oieuxan", "ÉTÉ ÇÈEN EN VICH", "Çè en vich"):
        assert binary._guess_encoding(western.encode("latin-1")) == "cp1252"
    for korean in ("한글 글 plain words", "한 file", "의", "file의", "희", "문서는 PDF를"):
        assert binary._guess_encoding(korean.encode("cp949")) == "cp949"


def test_sniff(spark):
    rows = [
        (b"%PDF-1.4 x", "PDF"),
        (b"PK\x03\x04zz", "OOXML"),
        (b"hello", "TEXT"),
        (b"a\x00b\x01", "BINARY"),
        ("hi".encode("utf-16-le"), "TEXT"),
        (b"\x01\x02\x03abc", "BINARY"),
        (b"", "BINARY"),
    ]
    df = spark.createDataFrame(rows, "content binary, want string")
    out = df.select("want", binary.sniff_family(F.col("content")).alias("got")).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_uuid5(spark):
    import uuid

    names = ["", "a", "한글\x1f1", "x" * 500]
    want = [str(uuid.uuid5(uuid.UUID(CHUNK_NAMESPACE), n)) for n in names]
    assert values(spark, lambda c: uuid5(CHUNK_NAMESPACE, c), names) == want


def test_masks_of_any_type(spark):
    from pyspark.sql import functions as F

    from corpusloom.functions.redact import redact_columns

    df = spark.sql(
        """SELECT map('db_port', 12345, 'n', 7) AS counts, map('db_user', named_struct('v', 's3cret'), 'x', named_struct('v', 'a')) AS users,
           parse_json('{"a": [{"my_api_key": 1, "my_token": {"x": 2}, "content": "gone", "n": null}], "t": "password=abc ok"}') AS v,
           CAST(NULL AS VARIANT) AS none"""
    )
    r = redact_columns(df).select("counts", "users", F.to_json("v").alias("v"), "none").first()
    assert r.counts == {"db_port": "[REDACTED]", "n": "7"}
    assert r.users == {"db_user": "[REDACTED]", "x": '{"v":"a"}'}
    assert r.v == '{"a":[{"my_api_key":"[REDACTED]","my_token":"[REDACTED]","n":null}],"t":"password=[REDACTED] ok"}'
    assert r.none is None


def test_whole_seconds_as_text(spark):
    import duckdb

    import __spark_entry__ as entry
    from corpusloom.operators.units import value_to_text

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-09 22:58:04', 'click', 11.5::DOUBLE)) e(event_id, ts, event_type, value)")
    con.execute(f"COPY events TO '{path}/events.parquet' (FORMAT parquet)")
    got = entry.queries()["value_to_text"](spark, path)
    assert [tuple(r) for r in got.collect()] == con.execute(entry.oracle_sql()["value_to_text"]).fetchall()
    auto = spark.read.parquet(f"{path}/events.parquet").select(value_to_text(F.col("ts"), "timestamp_ntz"))
    assert auto.first()[0] == "2024-01-09T22:58:04"


def test_synthesis_normalises_once(spark):
    asked = {
        "각 파일": True, "모든 문서를 요약해": True, "파일 목록": False, "Compare  both": True, "SUMMARIZE each\nof the files": True,
        "all files, an analysis": True, "summary of it": False, "comparer": False, "": False, None: None,
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string").select("q", text.is_synthesis_query(F.col("q")).alias("got"))
    assert {r["q"]: r["got"] for r in df.collect()} == asked
    kind = F.when((F.length("q") > 1) & text.is_synthesis_query(F.col("q")), 1).alias("kind")
    plan = spark.range(1).select(F.col("id").cast("string").alias("q")).select(kind)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(lower(") == 1
