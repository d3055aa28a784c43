"""Byte-level format checks and decoding."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import (
    BINARY_PREFIXES_HEX,
    BYTE_ORDER_MARKS_HEX,
    CONTROL_RATIO_LIMIT,
    GENERIC_MEDIA_TYPES,
    OOXML_MEDIA_TYPES,
    PDF_MEDIA_TYPES,
    TEXT_MEDIA_TYPES,
)
from corpusloom.functions.text import strip

_WORD = re.compile(r"[^\W\d_]+")
_ASCII_LETTER = re.compile("[A-Za-z]")


def _starts(content: Column, prefixes_hex) -> Column:
    # The longest prefix is 8 bytes; comparing hex text keeps this a plain string test.
    head = F.hex(F.substring(content, 1, 8))
    return F.array_contains(F.array(*[F.startswith(head, F.lit(p)) for p in prefixes_hex]), True)


def _nul_pattern_is_wide(content: Column) -> Column:
    """NULs without a byte order mark: text only when they sit at one byte parity.

    Two-byte text of a Western script has its NULs at every odd (or every even) byte.
    """
    hexed = F.hex(content)
    return hexed.rlike(r"^(?:..00)++\z") | hexed.rlike(r"^(?:00..)++\z")


def sniff_family(content: Column, sniff_bytes: int = 8192) -> Column:
    """PDF, OOXML, TEXT or BINARY, from the leading bytes only."""
    head = F.substring(content, 1, sniff_bytes)
    latin = F.decode(head, "ISO-8859-1")
    controls = F.length(latin) - F.length(
        F.regexp_replace(latin, r"[\x00-\x07\x0b\x0e-\x1f]", "")
    )
    has_nul = F.instr(latin, "\x00") > 0
    return (
        F.when(_starts(head, ["255044462D"]), F.lit("PDF"))
        .when(_starts(head, ["504B0304", "504B0506", "504B0708"]), F.lit("OOXML"))
        .when(F.octet_length(head) == 0, F.lit("BINARY"))
        .when(_starts(head, [p for p, _ in BYTE_ORDER_MARKS_HEX]), F.lit("TEXT"))
        .when(has_nul, F.when(_nul_pattern_is_wide(head), F.lit("TEXT")).otherwise(F.lit("BINARY")))
        .when(controls <= F.octet_length(head) * F.lit(CONTROL_RATIO_LIMIT), F.lit("TEXT"))
        .otherwise(F.lit("BINARY"))
    )


def looks_binary(content: Column, text: Column, encoding: Column, has_bom: Column) -> Column:
    """True for decodable bytes that are still not text: signature, NUL or control share."""
    wide = F.regexp_replace(F.lower(encoding), "-", "_").rlike("^utf_(16|32)")
    has_nul = F.instr(F.decode(content, "ISO-8859-1"), "\x00") > 0
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x07\x0b\x0e-\x1f]", ""))
    return (
        _starts(content, BINARY_PREFIXES_HEX)
        | (~has_bom & has_nul & ~wide)
        | ((F.length(text) > 0) & (controls > F.length(text) * F.lit(CONTROL_RATIO_LIMIT)))
    )


def media_type(declared: Column) -> Column:
    """The media type without parameters; null when absent or blank."""
    t = F.lower(strip(F.substring_index(declared, ";", 1)))
    return F.when(t != "", t)


def media_type_problem(declared: Column, family: Column) -> Column:
    """Null when declared type and sniffed family agree, else the reason they do not."""
    t = media_type(declared)
    known = GENERIC_MEDIA_TYPES + PDF_MEDIA_TYPES + OOXML_MEDIA_TYPES + TEXT_MEDIA_TYPES
    return (
        F.when(t.isNotNull() & ~t.isin(*known), F.lit("unsupported_media_type"))
        .when(family == "BINARY", F.lit("invalid_file"))
        .when(t.isin(*PDF_MEDIA_TYPES) & (family != "PDF"), F.lit("invalid_file"))
        .when(t.isin(*OOXML_MEDIA_TYPES) & (family != "OOXML"), F.lit("invalid_file"))
        .when(t.isin(*TEXT_MEDIA_TYPES) & (family != "TEXT"), F.lit("unsupported_media_type"))
    )


def _is_hangul(ch: str) -> bool:
    return "가" <= ch <= "힣"


def _western_words(payload: bytes) -> bytearray:
    """Marks the bytes of words that read well as Windows Latin.

    Such a word is cased like a word and holds an ASCII letter, or begins with a capital and goes on in small letters.
    """
    marks = bytearray(len(payload))
    try:
        western = payload.decode("cp1252")
    except UnicodeDecodeError:
        return marks
    if not _ASCII_LETTER.search(western):
        return marks
    for word in _WORD.finditer(western):
        w = word.group()
        capital = w[0].isupper() and w[1:].islower()
        if capital or ((w.islower() or w.isupper()) and _ASCII_LETTER.search(w)):
            marks[word.start() : word.end()] = b"\x01" * len(w)
    return marks


def _reads_korean(payload: bytes) -> bool:
    """Whether the Korean code page yields a Hangul syllable that is not two letters of a Western word."""
    try:
        text = payload.decode("cp949")
    except UnicodeDecodeError:
        return False
    western, at = None, 0
    for ch in text:
        if ch < "\x80":
            at += 1
            continue
        if _is_hangul(ch):
            # Bytes below 0xC0 are no letters, so most syllables need no look at words.
            if payload[at + 1] < 0xC0 or payload[at] < 0xC0:
                return True
            western = _western_words(payload) if western is None else western
            if not (western[at] and western[at + 1]):
                return True
        at += 2
    return False


def _guess_encoding(payload: bytes) -> str:
    """Encoding of bytes that carry no byte order mark and are not UTF-8.

    The Western single-byte guess loses to the Korean code page when that decodes and
    yields Hangul syllables that are no accents of Western words.
    """
    if _reads_korean(payload):
        return "cp949"
    try:
        payload.decode("cp1252")
        return "cp1252"
    except UnicodeDecodeError:
        return "latin-1"


def _guess(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else _guess_encoding(bytes(b)))


def _decode(content: pd.Series, encoding: pd.Series) -> pd.Series:
    def one(b, name):
        if b is None or not isinstance(name, str):
            return None
        try:
            return codecs.decode(bytes(b), name).removeprefix("﻿")
        except (UnicodeDecodeError, LookupError):
            return None

    return pd.Series([one(b, n) for b, n in zip(content, encoding)], dtype=object)


def has_bom(content: Column) -> Column:
    return _starts(content, [p for p, _ in BYTE_ORDER_MARKS_HEX])


def detect_encoding(content: Column) -> Column:
    """Encoding name: byte order mark, then strict UTF-8, then the best guess.

    Only bytes that pass neither JVM-side test reach the Python guess.
    """
    head = F.hex(F.substring(content, 1, 4))
    marked = F.lit(None).cast("string")
    for prefix, name in reversed(BYTE_ORDER_MARKS_HEX):
        marked = F.when(F.startswith(head, F.lit(prefix)), F.lit(name)).otherwise(marked)
    utf8 = F.is_valid_utf8(content.cast("string"))
    rest = F.when(marked.isNull() & ~utf8, content)
    return F.coalesce(marked, F.when(utf8, F.lit("utf-8")), F.pandas_udf(_guess, "string")(rest))


def decode_bytes(content: Column, encoding: Column) -> Column:
    """Strictly decoded text; UTF-8 decodes in the JVM, other encodings in Arrow batches."""
    plain = encoding.isin("utf-8", "utf-8-sig")
    jvm = F.regexp_replace(content.cast("string"), "^\\x{FEFF}", "")
    return F.when(plain, jvm).otherwise(
        F.pandas_udf(_decode, "string")(F.when(~plain, content), F.when(~plain, encoding))
    )

