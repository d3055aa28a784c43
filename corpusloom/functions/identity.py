"""Content hashes and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace of our chunk ids. Changing it changes every id.
CHUNK_NAMESPACE = "5f0c2f0e-6c5b-5a5e-9d3a-4b1f1f6f8a21"
FIELD_SEPARATOR = "\x1f"


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) as text, from the built-in SHA-1."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8),
        F.lit("-"),
        F.substring(h, 9, 4),
        F.lit("-5"),
        F.substring(h, 14, 3),
        F.lit("-"),
        variant,
        F.substring(h, 18, 3),
        F.lit("-"),
        F.substring(h, 21, 12),
    )


def chunk_id(
    owner: Column,
    file: Column,
    file_hash: Column,
    file_type: Column,
    parser_version: Column,
    embedding_model: Column,
    index_version: Column,
    chunk_index: Column,
    chunk_hash: Column,
) -> Column:
    """The id of a chunk. File and folder names are no part of it, so moves keep ids."""
    parts = (owner, file, file_hash, file_type, parser_version, embedding_model)
    parts += (index_version, chunk_index, chunk_hash)
    return uuid5(CHUNK_NAMESPACE, F.concat_ws(FIELD_SEPARATOR, *[p.cast("string") for p in parts]))
