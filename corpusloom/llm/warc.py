"""WARC archives with Zstandard: one frame per record, and a dictionary in the file itself.

A file starts with a skippable frame that holds the dictionary of its records; then each record
is a frame of its own, so a reader can start at any of them and never has more than one record
in memory. Each task writes the rows of its partition into files of bounded size in a shared
folder, and returns a line for each file; the lines are kept, so a task that runs again after
a loss leaves files behind that no line names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import keep
from corpusloom.session import ensure_checkpoint_dir

#: Equal payloads shorter than this are stored each.
LEAST_REVISIT_BYTES = 100
#: Bytes of records after which a file is closed.
FILE_BYTES = 64 << 20
#: The dictionary is trained from the first records of a file, within these bounds.
DICTIONARY_RECORDS = 256
DICTIONARY_SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
SALTS = 32
#: Magic of the skippable frame that the archive format sets apart for dictionaries, of zstd
#: frames and of zstd dictionaries (fixed values).
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
READ_BYTES = 1 << 20
#: Most bytes of a record that a reader accepts.
RECORD_BYTES = 1 << 30
_MUST_HAVE = ("warc-type", "warc-record-id", "warc-date", "content-length")
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(place: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(place if "://" in place or place.startswith("file:") else f"file://{place}")


def _clean(value: str) -> str:
    """A header value on one line: controls and percent signs become escapes."""
    return "".join(c if c >= " " and c not in "%\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another page's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


class _FileWriter:
    def __init__(self, folder: str):
        fs, path = _file_system(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.held: list[bytes] | None = []
        self.held_bytes = self.records = self.size = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def _settle(self) -> None:
        """Train the dictionary and write what has been held back for it."""
        held, self.held = self.held or [], None
        trained = None
        if len(held) >= 8:
            try:
                trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, self.held_bytes // 8)), held)
            except zstandard.ZstdError:  # too little that repeats: the file goes without
                trained = None
        if trained is not None:
            raw = trained.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        options = {"level": LEVEL, "write_content_size": True, "write_checksum": True}
        self.compressor = zstandard.ZstdCompressor(**options, **({"dict_data": trained} if trained else {}))
        for record in held:
            self._write(record)

    def _write(self, record: bytes) -> None:
        self.out.write(self.compressor.compress(record))

    def add(self, record: bytes) -> None:
        self.records += 1
        self.size += len(record)
        if self.held is None:
            self._write(record)
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if len(self.held) >= DICTIONARY_RECORDS or self.held_bytes >= DICTIONARY_SAMPLE_BYTES:
            self._settle()

    def close(self) -> tuple[str, int]:
        if self.held is not None:
            self._settle()
        self.out.close()
        return self.name, self.records


def _first_of_equal(pages: DataFrame) -> DataFrame:
    """(page_id, digest, n, first): least page id among equal payloads, by way of salted groups.

    A row for each page id and digest; a payload that a third of all pages share is spread over
    the salts in both directions. Digests are sha256, which stand for their payloads.
    """
    rows = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("n"))
    rows = rows.where(F.col("n") >= LEAST_REVISIT_BYTES)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    salted = rows.groupBy("digest", "salt").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    whole = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    back = salted.select("digest", "salt").join(whole.select("digest", "first"), "digest")
    return rows.select("page_id", "digest", "salt").join(back, ["digest", "salt"]).select("page_id", "digest", "first").distinct()


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Write a record for each row into archives in ``folder``; one row for each file.

    Returns ``file`` and ``records``. The payload is the html in UTF-8, null counting as empty. Of
    records with equal payloads of at least ``LEAST_REVISIT_BYTES`` bytes, those of the smallest
    id are responses and others revisits of it; a null id is never the smallest, and where
    all ids of a payload are null, all are responses. Rows that repeat the smallest id are
    responses too. Other columns are not read, and an empty table writes no file.
    """
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    first = _first_of_equal(rows)
    # Only repeated payloads have a row there, so this side is small where copies are few.
    again = first.where("page_id IS NULL OR page_id <> first").select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")
    )
    same = (F.sha2("payload", 256) == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page"))
    joined = rows.join(again, same, "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page_id, address, payload, refers_to in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if writer is None:
                    writer = _FileWriter(folder)
                writer.add(record_bytes(page_id, address, payload, hashlib.sha256(payload).hexdigest(), refers_to))
                if writer.size >= FILE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        for name, records in done:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["file", "records"])

    return keep(joined.mapInArrow(run, "file string, records bigint"))


class InvalidArchive(ValueError):
    pass


def read_records(stream: BinaryIO) -> Iterator[bytes]:
    """The content of each frame of an archive, one at a time.

    A dictionary may come first in a skippable frame, plain or itself compressed. Other
    skippable frames are passed over. A frame that is cut short raises.
    """
    head = _Reader(stream)
    dictionary = None
    at_start = True
    while magic := head.peek(4):
        if len(magic) < 4:
            raise InvalidArchive("frame cut short")
        number = int.from_bytes(magic, "little")
        if 0x184D2A50 <= number <= 0x184D2A5F:
            size = int.from_bytes(head.take(8)[4:], "little")
            raw = head.take(size)
            if at_start and number == DICTIONARY_MAGIC:
                if int.from_bytes(raw[:4], "little") == FRAME_MAGIC:
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                dictionary = zstandard.ZstdCompressionDict(raw)
        elif number == FRAME_MAGIC:
            d = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {})).decompressobj()
            parts, total = [], 0
            while not d.eof:
                chunk = head.some()
                if not chunk:
                    raise InvalidArchive("frame cut short")
                parts.append(d.decompress(chunk))
                total += len(parts[-1])
                if total > RECORD_BYTES:
                    raise InvalidArchive("record too long")
            head.give_back(d.unused_data)
            yield b"".join(parts)
        else:
            raise InvalidArchive("no frame")
        at_start = False


class _Reader:
    def __init__(self, stream: BinaryIO):
        self.stream, self.buffer = stream, b""

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n and (more := self.stream.read(READ_BYTES)):
            self.buffer += more
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        if len(self.peek(n)) < n:
            raise InvalidArchive("frame cut short")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def some(self) -> bytes:
        """A small piece, so that little is given back at the end of a frame."""
        piece = self.peek(1 << 14)[: 1 << 14]
        self.buffer = self.buffer[len(piece) :]
        return piece

    def give_back(self, data: bytes) -> None:
        self.buffer = data + self.buffer


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; raises if it is not well formed."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise InvalidArchive("no WARC head")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise InvalidArchive("bad header line")
        headers[name.lower()] = value.strip()
    missing = [h for h in _MUST_HAVE if h not in headers]
    if missing:
        raise InvalidArchive(f"without {missing[0]}")
    if not headers["content-length"].isdigit():
        raise InvalidArchive("bad content length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise InvalidArchive("length differs from content length")
    return headers, rest[:n]


def page_of(record: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """(page_id, url, payload_bytes, digest, type, refers_to, payload) of a record written here."""
    headers, block = parse_record(record)
    kind = headers["warc-type"]
    http, gap, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode("utf-8").split("\r\n")[1:])
    n = int(fields["Content-Length"])
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if not gap or kind not in ("response", "revisit"):
        raise InvalidArchive("no page record")
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise InvalidArchive("payload differs from its digest or length")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise InvalidArchive("bad revisit")

    def page(urn: str) -> int | None:
        number = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    refers_to = page(headers["warc-refers-to"]) if kind == "revisit" else None
    body = payload if kind == "response" else None
    return page(headers["warc-record-id"]), headers.get("warc-target-uri"), n, digest, kind, refers_to, body


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the archives that ``files`` names, a row for each.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to, problem, and with
    ``payloads`` the payload of responses. Files are spread over tasks and read in a stream, one
    record at a time. A record that fails a check has a row with the reason in ``problem`` and
    nulls elsewhere; where a frame cannot be found, reading that file ends with such a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    records = read_records(stream)
                    while True:
                        try:
                            record = next(records, None)
                            if record is None:
                                break
                        except (InvalidArchive, zstandard.ZstdError) as e:
                            rows.append((None,) * 7 + (f"{name}: {e}",))
                            break
                        try:
                            rows.append((*page_of(record), None))
                        except (ValueError, KeyError) as e:
                            rows.append((None,) * 7 + (f"{name}: {e}",))
                        size += len(record) if payloads else 200
                        if size >= 4 << 20:
                            yield _batch(rows, payloads)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, payloads)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, problem string"
    # A number that is given is kept; without one, so few rows would be put into one task.
    spread = files.select("file").repartition(max(1, files.count()), F.col("file"))
    return spread.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    page, url, n, digest, kind, refers, body, problem = zip(*rows)
    arrays = [
        pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(n, pa.int64()), pa.array(digest, pa.string()),
        pa.array(kind, pa.string()), pa.array(refers, pa.int64()), pa.array(problem, pa.string()),
    ]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    if payloads:
        arrays, names = [*arrays, pa.array(body, pa.binary())], [*names, "payload"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def failed(problem: Column) -> Column:
    """Stops a query that reads a broken record; null otherwise."""
    return F.when(problem.isNotNull(), F.raise_error(problem))
