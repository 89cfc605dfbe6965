"""Content-addressed identifiers as column expressions: the same fields give the same id on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the record format: fields are joined by the unit separator, ids keep 16 hex digits.
SEPARATOR = "\x1f"
DIGITS = 16


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in lowercase hex; null stays null."""
    return F.sha2(text, 256)


def short_hash(*fields: Column) -> Column:
    """The first 16 hex digits of the hash over the joined fields. A null field counts as empty."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), 1, DIGITS)


def chunk_id(system: Column, stable_key: Column, unit_key: Column, text: Column) -> Column:
    """``chunk:<system>:`` and the hash of system, stable key, unit key and text."""
    return F.concat(F.lit("chunk:"), system, F.lit(":"), short_hash(system, stable_key, unit_key, text))


def relation_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.lit("rel:"), short_hash(source, kind, target))


def tombstone_id(entity_type: Column, entity_id: Column, reason: Column, version: Column) -> Column:
    return F.concat(F.lit("tomb:"), short_hash(entity_type, entity_id, reason, version))


def acl_id(document_id: Column) -> Column:
    return F.concat(F.lit("acl:"), document_id)


def page_document_id(page_id: Column) -> Column:
    return F.concat_ws(":", F.lit("confluence"), F.lit("page"), page_id.cast("string"))


def file_document_id(repo: Column, path: Column) -> Column:
    return F.concat_ws(":", F.lit("git"), repo, path)


def symbol_id(repo: Column, branch: Column, path: Column, qualified_name: Column, signature: Column, overloaded: Column) -> Column:
    """repo:branch:path:name, and ``~`` with 8 hex digits of the signature's hash where the name is overloaded."""
    plain = F.concat_ws(":", repo, branch, path, qualified_name)
    return F.when(overloaded, F.concat(plain, F.lit("~"), F.substring(F.sha2(signature, 256), 1, 8))).otherwise(plain)


def dataset_version(instant: Column) -> Column:
    """vYYYYMMDD-HHMMSS-ffffffZ of a timestamp, in the session's time zone (set it to UTC)."""
    return F.date_format(instant, "'v'yyyyMMdd-HHmmss-SSSSSS'Z'")


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name; ``namespace`` is a UUID in its usual form."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)
    low = F.lower(F.hex(variant))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(low, F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )


def page_id_from_url(url: Column) -> Column:
    """The numeric id of a page address: the ``pageId`` parameter, else the number after ``/pages/``; null if neither."""
    query = F.regexp_extract(url, r"[?&]pageId=(\d+)(?:[&#]|$)", 1)
    path = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/pages/(\d+)(?:/|$)", 1)
    return F.coalesce(F.nullif(query, F.lit("")), F.nullif(path, F.lit("")))
