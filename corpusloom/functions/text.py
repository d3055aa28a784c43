"""Text normalisation, truncation and naming expressions.

Everything here is a Column expression that stays inside the JVM, apart from Unicode
compatibility folding, which has no built-in and runs as an Arrow-batched UDF on the
rows that hold non-ASCII text.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import (
    BYTES_BY_UNIT,
    ELLIPSIS,
    LINE_BREAKS,
    LOG_TRUNCATION_SUFFIX,
    SYNTHESIS_PATTERNS,
    WS_CHARS,
    WS_JAVA,
    WS_JAVA_INLINE,
)


def _sub(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, pattern, replacement)


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` removes only spaces)."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def unify_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_text(c: Column) -> Column:
    """LF line ends, no NUL, lines right-trimmed, at most one blank line, stripped."""
    t = F.replace(unify_newlines(F.coalesce(c, F.lit(""))), F.lit("\x00"), F.lit(""))
    t = F.array_join(F.transform(F.split(t, "\n"), rstrip), "\n")
    return strip(_sub(t, "\n{3,}", "\n\n"))


def normalize_inline_text(c: Column) -> Column:
    """The non-empty lines of a text, joined by single spaces."""
    return F.array_join(
        F.filter(
            F.transform(F.split(normalize_text(c), f"[{LINE_BREAKS}]"), strip),
            lambda line: line != "",
        ),
        " ",
    )


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility folding; ASCII text is its own folding and skips the UDF."""
    plain = ~c.rlike(r"[^\x00-\x7f]")
    return F.when(plain, c).otherwise(F.pandas_udf(_nfkc, "string")(F.when(~plain, c)))


def strip_control_chars(c: Column) -> Column:
    """Drop control, surrogate and unassigned characters; keep LF and TAB."""
    return _sub(c, r"[\p{Cc}\p{Cs}\p{Cn}&&[^\n\t]]")


def normalize_noisy_text(c: Column, max_chars: int) -> Column:
    """Repair recognised text. The order of the steps is part of the result."""
    if max_chars <= 0:
        raise ValueError("max_chars must be greater than zero")
    t = nfkc(F.replace(unify_newlines(c), F.lit(" "), F.lit(" ")))
    t = _sub(t, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]")
    t = _sub(strip_control_chars(t), r"\x{FFFD}+")
    t = _sub(t, r"(?<=[0-9A-Za-z가-힣])-\n(?=[0-9A-Za-z가-힣])")
    t = _sub(t, f"(?U)[{WS_JAVA_INLINE}]+", " ")
    t = _sub(t, "(?m)^ +| +$")
    t = _sub(t, r" +([,.;:!?%)\]}])", "$1")
    t = _sub(t, r"([(\[{]) +", "$1")
    t = strip(_sub(t, "\n{3,}", "\n\n"))
    # A short text is stripped already, so no condition is needed that would repeat all steps.
    return rstrip(F.left(t, F.lit(max_chars)))


def normalize_query(c: Column) -> Column:
    """Case-folded query with white-space runs as one space.

    Full case folding differs from lower-casing for a few letters; the sharp s and the
    final sigma are folded here, rarer ones are not.
    """
    folded = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return strip(_sub(folded, f"(?U)[{WS_JAVA}]+", " "))


def is_synthesis_query(c: Column) -> Column:
    """True when the normalised query asks to compare or combine several documents.

    The one-element array holds the normalised text: inside a condition each pattern would normalise it again.
    """
    korean = [p for p in SYNTHESIS_PATTERNS if any("가" <= ch <= "힣" for ch in p)]
    english = [p for p in SYNTHESIS_PATTERNS if p not in korean]
    # What a pattern cannot match without is looked for first; it spares the slow patterns most texts.
    summed = [p for p in english if "analy" in p]

    def asks(q: Column) -> Column:
        def matches(patterns: list[str]) -> Column:
            return reduce(or_, [q.rlike(p) for p in patterns])

        return (
            (q.rlike("[가-힣]") & matches(korean))
            | matches([p for p in english if p not in summed])
            | ((q.contains("summar") | q.contains("analy")) & matches(summed))
        )

    return F.exists(F.array(normalize_query(c)), asks)


def single_line(c: Column) -> Column:
    """Make line breaks, tabs and control characters visible, so a value stays on one line."""
    t = F.replace(F.replace(c, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    t = F.replace(t, F.lit("\t"), F.lit("\\t"))
    escaped = t
    for code in [*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), escaped).otherwise(t)


def truncate_log(c: Column, max_length: int) -> Column:
    keep = max(max_length - len(LOG_TRUNCATION_SUFFIX), 0)
    return F.when(F.length(c) <= max_length, c).otherwise(
        F.concat(F.left(c, F.lit(keep)), F.lit(LOG_TRUNCATION_SUFFIX))
    )


def truncate_ellipsis(c: Column, max_chars: int | Column) -> Column:
    """At most ``max_chars`` characters, the last one an ellipsis after a right trim."""
    n = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    return (
        F.when(F.length(c) <= n, c)
        .when(n <= 1, F.left(F.lit(ELLIPSIS), n))
        .otherwise(F.concat(rstrip(F.left(c, n - 1)), F.lit(ELLIPSIS)))
    )


def snippet(c: Column, max_chars: int = 300) -> Column:
    """First ``max_chars`` characters plus an ellipsis; no right trim."""
    return F.when(F.length(c) <= max_chars, c).otherwise(
        F.concat(F.left(c, F.lit(max_chars)), F.lit(ELLIPSIS))
    )


def escape_prompt_json(json: Column) -> Column:
    """Escape the characters that could close a prompt section."""
    for char in "&<>":
        json = F.replace(json, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return json


def query_from_content(c: Column, max_chars: int = 180) -> Column:
    """A query built from a content: its first sentence when long enough, else its start."""
    t = strip(_sub(_sub(c, r"[\x00-\x1f\x7f]+", " "), f"(?U)[{WS_JAVA}]+", " "))
    sentence = F.split(t, f"(?U)(?<=[.!?。！？])[{WS_JAVA}]+", 2)[0]
    picked = F.when(F.length(sentence) >= 8, sentence).otherwise(t)
    return rstrip(F.left(picked, F.lit(max_chars)))


def parse_human_size(c: Column) -> Column:
    """``'1.5GiB'`` to bytes; null when the text is not a size."""
    pattern = f"(?U)^[{WS_JAVA}]*([0-9]+(?:\\.[0-9]+)?)[{WS_JAVA}]*([A-Za-z]+)[{WS_JAVA}]*\\z"
    number = F.regexp_extract(c, pattern, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(c, pattern, 2))
    factor = F.lit(None).cast("long")
    for name, size in BYTES_BY_UNIT.items():
        factor = F.when(unit == name, F.lit(size).cast("long")).otherwise(factor)
    return F.floor(number * factor).cast("long")


def _float_text(c: Column) -> Column:
    """Numbers as a program reads them: no trailing type letters such as ``1d``."""
    number = c.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    return F.when(number, c).try_cast("double")


def parse_percent(c: Column) -> Column:
    return _float_text(_sub(strip(c), "%+\\z"))


def optional_float(c: Column) -> Column:
    t = strip(c)
    missing = (t == "") | F.upper(t).isin("N/A", "[NOT SUPPORTED]", "NOT SUPPORTED")
    return F.when(~missing, _float_text(t))


def format_bytes(b: Column) -> Column:
    """Base-1024 size text: whole bytes, one decimal above."""
    n = b.cast("double")
    out = F.format_string("%.0f B", n)
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        out = F.when(n >= 1024.0**power, F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return F.when(n.isNull() | (n <= 0), F.lit("0 KB")).otherwise(out)


def file_extension(name: Column) -> Column:
    """Lower-case extension after the last dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))


def _suffix(file_type: Column) -> Column:
    ext = F.lower(_sub(strip(file_type), r"^\."))
    return F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext))


def base_name(name: Column, file_type: Column) -> Column:
    """The name without the extension its file type gives it, compared without case."""
    suffix = _suffix(file_type)
    ends = (suffix != "") & F.endswith(F.lower(name), suffix)
    return F.when(ends, F.left(name, F.length(name) - F.length(suffix))).otherwise(name)


def build_file_name(new_name: Column, file_type: Column) -> Column:
    """A renamed file keeps the extension of its type, attached exactly once."""
    return F.concat(base_name(new_name, file_type), _suffix(file_type))


def escape_like(c: Column) -> Column:
    """Escape the LIKE wildcards and the escape character itself."""
    for char in "\\%_":
        c = F.replace(c, F.lit(char), F.lit("\\" + char))
    return c


def citation_context(before: Column, max_chars: int = 400) -> Column:
    """The statement a citation supports.

    ``before`` is the text up to the citation. Earlier markers are removed, the text is
    cut back to the last sentence end or line break, and its last characters are kept.
    """
    t = rstrip(_sub(before, r"\[SOURCE-[0-9]+\]"))
    return F.right(strip(_sub(t, f"(?sU)^.*(?:[.!?。](?=[{WS_JAVA}])|\n)")), F.lit(max_chars))
