"""Masking of secrets in log text and log records."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacement texts.
MASK = "[REDACTED]"
MASK_URL = "[REDACTED_PRESIGNED_URL]"
MASK_DSN = "[REDACTED_DATABASE_DSN]"

# What counts as a secret in free text.
ANSI = r"(?:\x1B\][^\x07]*(?:\x07|\x1B\\))|(?:\x1B\[[0-?]*[ -/]*[@-~])"
PRESIGNED_URL = (
    r"""(?iU)https?://[^\s"'<>]*[?&](?:x-amz-[a-z0-9-]+|awsaccesskeyid|signature)=[^\s"'<>]*"""
)
DATABASE_DSN = (
    r"(?iU)\b(?:mysql(?:\+[a-z0-9_]+)?|mariadb(?:\+[a-z0-9_]+)?|postgres(?:ql)?(?:\+[a-z0-9_]+)?"
    r"""|redis(?:\+ssl)?|mongodb(?:\+srv)?)://[^\s"'<>]+"""
)
SECRET_NAMES = (
    r"x-internal-token|internal[_-]token|rag[_-]ingest[_-]token|authorization|cookie|set[_-]cookie"
    r"|download[_-]url|presigned[_-]url|database[_-](?:host|port|name|user|password|url|dsn)"
    r"|db[_-](?:host|port|name|user|password|url|dsn)|qdrant[_-]api[_-]key|api[_-]key|password|secret"
)
SECRET_KEY = rf"""(?iU)(["']?(?:{SECRET_NAMES})["']?\s*[:=]\s*)"""
# A quoted value keeps its quotes: group 2 (or 3) holds the quote, and is empty for other forms.
SECRET_VALUE = r"""(?:(?:Bearer\s+[A-Za-z0-9._~+/=-]+)|(")[^"]*"|(')[^']*'|[^\s,;}]+)"""
BEARER = r"(?iU)\bBearer\s+[A-Za-z0-9._~+/=-]+"
SECRET_PARAMETER = (
    r"(?iU)([?&](?:x-amz-[a-z0-9-]+|awsaccesskeyid|signature|token|api_key|password)=)"
    r"""[^&#\s"'<>]+"""
)

# Record fields that are removed, and fields whose value is masked.
DROPPED_FIELDS = (
    "content",
    "chunk_content",
    "chunk_contents",
    "chunks",
    "question",
    "user_question",
    "prompt",
    "system_prompt",
    "ocr_text",
    "answer",
    "generation_response",
    "embedding",
    "embeddings",
    "embedding_vector",
    "embedding_vectors",
    "vector",
    "vectors",
    "payload",
    "request_body",
    "response_body",
    "request_payload",
    "response_payload",
    "color_message",
)
MASKED_FIELDS = (
    "authorization",
    "cookie",
    "set_cookie",
    "x_internal_token",
    "internal_token",
    "rag_ingest_token",
    "database_host",
    "database_port",
    "database_name",
    "database_user",
    "database_password",
    "database_url",
    "database_dsn",
    "db_host",
    "db_port",
    "db_name",
    "db_user",
    "db_password",
    "db_url",
    "db_dsn",
    "download_url",
    "presigned_url",
    "qdrant_api_key",
)
MASKED_SUFFIXES = ("_token", "_password", "_secret", "_credential", "_api_key")


def redact_text(c: Column) -> Column:
    """Mask, in this order: ANSI codes, signed URLs, DSNs, assignments, bearer tokens, parameters."""
    t = F.regexp_replace(c, ANSI, "")
    t = F.regexp_replace(t, PRESIGNED_URL, MASK_URL)
    t = F.regexp_replace(t, DATABASE_DSN, MASK_DSN)
    t = F.regexp_replace(t, SECRET_KEY + SECRET_VALUE, f"$1$2$3{MASK}$2$3")
    t = F.regexp_replace(t, BEARER, f"Bearer {MASK}")
    return F.regexp_replace(t, SECRET_PARAMETER, f"$1{MASK}")


def field_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


def is_dropped_field(c: Column) -> Column:
    return field_name(c).isin(*DROPPED_FIELDS)


def is_masked_field(c: Column) -> Column:
    name = field_name(c)
    return name.isin(*MASKED_FIELDS) | name.rlike("(" + "|".join(MASKED_SUFFIXES) + r")\z")


def _redact_json(text: str | None) -> str | None:
    """`redact_record` for the value of a JSON text, whose type is only known in the row."""
    if text is None:
        return None

    def clean(t: str) -> str:
        """`redact_text`, with the same patterns; flags have other names here."""
        for pattern, mask in (
            (ANSI, ""),
            (PRESIGNED_URL, MASK_URL),
            (DATABASE_DSN, MASK_DSN),
            (SECRET_KEY + SECRET_VALUE, rf"\g<1>\g<2>\g<3>{MASK}\g<2>\g<3>"),
            (BEARER, f"Bearer {MASK}"),
            (SECRET_PARAMETER, rf"\g<1>{MASK}"),
        ):
            t = re.sub(pattern.replace("(?iU)", "(?i)"), mask, t)
        return t

    def walk(value):
        if isinstance(value, str):
            return clean(value)
        if isinstance(value, list):
            return [walk(v) for v in value]
        if not isinstance(value, dict):
            return value
        out = {}
        for key, inner in value.items():
            name = key.strip(" ").lower().replace("-", "_").replace(" ", "_")
            if name not in DROPPED_FIELDS:
                out[key] = MASK if name in MASKED_FIELDS or name.endswith(MASKED_SUFFIXES) else walk(inner)
        return out

    return json.dumps(walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))


def redact_record(c: Column, data_type) -> Column:
    """Redact a nested value by its Spark type: structs, arrays, maps and variants are walked.

    Map values become text (JSON if nested), as a masked value of any type is the mask.
    """
    from pyspark.sql import types as T

    if isinstance(data_type, T.StringType):
        return redact_text(c)
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: redact_record(x, data_type.elementType))
    if isinstance(data_type, T.VariantType):
        return F.parse_json(F.udf(_redact_json, "string", useArrow=True)(F.to_json(c)))
    if isinstance(data_type, T.MapType):
        kept = F.map_filter(c, lambda k, _: ~is_dropped_field(k.cast("string")))
        nested = isinstance(data_type.valueType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))

        def value(k, v):
            clean = redact_record(v, data_type.valueType)
            # A mask is text, so the values of a map become text with it.
            clean = F.to_json(clean) if nested else clean.cast("string")
            return F.when(is_masked_field(k.cast("string")), F.lit(MASK)).otherwise(clean)

        return F.transform_values(kept, value)
    if isinstance(data_type, T.StructType):
        fields = []
        for f in data_type.fields:
            name = f.name.strip().lower().replace("-", "_").replace(" ", "_")
            if name in DROPPED_FIELDS:
                continue
            if name in MASKED_FIELDS or name.endswith(MASKED_SUFFIXES):
                fields.append(F.lit(MASK).alias(f.name))
            else:
                fields.append(redact_record(c.getField(f.name), f.dataType).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def redact_columns(df):
    """Redact every column of a log table, dropping and masking columns by name."""
    from pyspark.sql import types as T

    out = redact_record(F.struct(*[F.col(f"`{n}`") for n in df.columns]), T.StructType(df.schema.fields))
    return df.select(out.alias("r")).select("r.*")
