"""Canonical JSON and the digests over it, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """A JSON object with its keys in order, without spaces; nulls are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def selection_identity(page_ids: Column) -> Column:
    """The digest of a selection of pages, in the order of the array: ``[{"page_id":...},...]``."""
    return digest(F.to_json(F.transform(page_ids, lambda x: F.struct(x.cast("string").alias("page_id")))))


def scope_identity(roots: Column, pages: Column, ancestors: Column) -> Column:
    """The digest of a crawl's scope: its roots, and the pages and trees that are left out."""
    return digest(canonical_json({"include_root_page_ids": roots, "excluded_page_ids": pages, "excluded_ancestor_page_ids": ancestors}))


def endpoint_identity(url: Column) -> Column:
    """The digest of an https address: host in lower case without a last dot, port 443 by default, path without last slashes.

    Null for anything else: another scheme, a user, a query, a fragment, white space, or a port that is no number. Hosts
    are taken to be ASCII.
    """
    shape = r"^[hH][tT][tT][pP][sS]://([^/:@?#\s]+)(?::([0-9]{1,5}))?(/[^?#\s]*)?$"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, shape, 1)), r"\.$", "")
    port = F.coalesce(F.nullif(F.regexp_extract(url, shape, 2), F.lit("")), F.lit("443")).cast("int").cast("string")
    path = F.regexp_replace(F.regexp_extract(url, shape, 3), r"/+$", "")
    whole = F.concat_ws("\x1f", F.lit("https"), host, port, F.when(path == "", "/").otherwise(path))
    return F.when(url.rlike(shape) & (host != ""), digest(whole))


def rows_digest(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (rows, digest) of a table: the same for the same rows in any order, repeats counted.

    Each row's canonical JSON is hashed; the hashes are added up in four words, so that no table is put in order for it.
    """
    names = sorted(columns or rows.columns)
    h = rows.select(digest(canonical_json({c: F.col(c) for c in names})).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(4)]
    total = h.agg(F.count("*").alias("rows"), *words)
    return total.select("rows", digest(F.concat_ws(":", F.lit(",".join(names)), F.col("rows").cast("string"), *[F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(4)])).alias("digest"))


def crawl_fingerprint(endpoint: Column, scope: Column, profile: Mapping[str, Column]) -> Column:
    """What a crawl may be resumed under: the digest of its endpoint's and scope's identities and of its limits."""
    return digest(canonical_json({"endpoint": endpoint, "scope": scope, "profile": digest(canonical_json(profile))}))


def streams_digest(streams: Mapping[str, DataFrame]) -> DataFrame:
    """One row (digest) over all streams of a version: the names in order, each with the digest of its rows."""
    parts = [rows_digest(streams[name]).select(F.lit(name).alias("name"), "digest") for name in sorted(streams)]
    listed = reduce(DataFrame.unionByName, parts).agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", "digest"))).alias("all"))  # a row per stream
    return listed.select(digest(F.array_join("all", "\x00")).alias("digest"))
