"""Relations between documents: issue keys, links, media, and their targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.checkpoints import cut
from tessera.functions.ids import relation_id, short_hash
from tessera.functions.joins import dealt_join

#: Fixed by the record format: an issue key, not inside a longer word.
ISSUE_KEY = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9_]+-[0-9]+(?![A-Za-z0-9_])"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'>]+)["']"""


def issue_keys(text: Column) -> Column:
    """Issue keys in order, each once; an empty array for null."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(ISSUE_KEY), 0), F.array().cast("array<string>")))


def issue_relations(docs: DataFrame, created_at: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """(document_id, text) -> a relation per document and key. With ``allowed``, keys of other projects are left out."""
    pairs = docs.select("document_id", F.explode(issue_keys(F.col("text"))).alias("evidence"))
    if allowed is not None:
        pairs = pairs.where(F.regexp_extract("evidence", r"^(.*)-[0-9]+$", 1).isin(list(allowed)))
    return _relation(pairs, "mentions_jira_key", F.concat(F.lit("jira:"), F.col("evidence")), F.lit("unresolved_without_jira_api"), 0.95, created_at)


def issue_metrics(docs: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """One row: occurrences, distinct keys, and those inside and outside the allowed projects."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(ISSUE_KEY), 0)).alias("k"))
    inside = F.regexp_extract("k", r"^(.*)-[0-9]+$", 1).isin(list(allowed))
    return found.agg(F.count("*").alias("occurrences"), F.count_distinct("k").alias("unique_keys"), F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def _relation(pairs: DataFrame, kind: str, target: Column, status: Column, confidence: float | None, created_at: str) -> DataFrame:
    rows = pairs.withColumn("target_id", target)
    return rows.select(
        relation_id(F.col("document_id").cast("string"), F.lit(kind), F.col("target_id")).alias("relation_id"),
        F.col("document_id").alias("source_id"), "target_id", F.lit(kind).alias("relation_type"), "evidence",
        F.lit(confidence).cast("double").alias("confidence"), status.alias("resolution_status"), F.lit(created_at).alias("created_at"),
    )


def links(pages: DataFrame) -> DataFrame:
    """(document_id, html) -> (document_id, evidence): addresses that a page links to, each once."""
    return pages.select("document_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("evidence"))


def resolve(references: DataFrame, targets: DataFrame, created_at: str, kind: str = "links_to_page") -> DataFrame:
    """(document_id, evidence) and targets (title, target_id) -> relations, resolved by title, else by id.

    What names no target, or a title that several share, is unresolved: its target id is a hash of source and evidence.
    """
    titles = targets.groupBy(F.col("title").alias("evidence")).agg(F.min("target_id").alias("__by_title"), F.count_distinct("target_id").alias("__n")).where("__n = 1").drop("__n")
    ids = targets.select(F.col("target_id").alias("evidence"), F.col("target_id").alias("__by_id")).distinct()
    found = references.join(titles, "evidence", "left").join(ids, "evidence", "left").withColumn("__target", F.coalesce("__by_title", "__by_id"))
    lost = F.concat(F.lit("unresolved:"), short_hash(F.col("document_id"), F.col("evidence")))
    status = F.when(F.col("__target").isNotNull(), "resolved").otherwise("unresolved_target")
    return _relation(found, kind, F.coalesce("__target", lost), status, None, created_at)


def attach(intents: DataFrame, attachments: DataFrame) -> DataFrame:
    """(document_id, filename) -> with media_id and status; a name that a page holds twice is ambiguous, so unresolved."""
    unique = attachments.groupBy("document_id", "filename").agg(F.min("media_id").alias("media_id"), F.count("*").alias("__n")).where("__n = 1").drop("__n")
    joined = intents.join(unique, ["document_id", "filename"], "left")
    return joined.withColumn("resolution_status", F.when(F.col("media_id").isNotNull(), "resolved").otherwise("unresolved_target"))


#: Fixed by the record format: the relation that a reference of a page stands for.
REFERENCE_RELATIONS = {"image_attachment": "embeds_media", "drawio": "embeds_media", "include_page": "includes_page", "page_link": "links_to_page"}


def reference_relations(pages: DataFrame, attachments: DataFrame, targets: DataFrame, created_at: str) -> DataFrame:
    """References of pages (document_id, references) -> one relation per page, kind and target.

    Media are found among ``attachments`` (document_id, filename, media_id) of the same page, if a name stands there once;
    pages among ``targets`` (title, target_id), by a title that only one has, else as their id. What is not found has a
    target named after a hash of page and evidence. The evidence is the first reference of its kind to the target. A page
    that very many others name is found by many tasks.
    """
    r = pages.select("document_id", F.explode("references").alias("r")).select("document_id", "r.ordinal", "r.kind", F.col("r.identity").alias("evidence"))
    kinds = F.create_map(*[F.lit(x) for pair in REFERENCE_RELATIONS.items() for x in pair])
    r = cut(r.withColumn("relation_type", F.try_element_at(kinds, F.col("kind"))).where(F.col("relation_type").isNotNull()).drop("kind"))  # pages are read once
    files = attach(r.where("relation_type = 'embeds_media'").withColumnRenamed("evidence", "filename"), attachments).withColumnsRenamed({"filename": "evidence", "media_id": "found"}).drop("resolution_status")
    titles = targets.groupBy(F.col("title").alias("evidence")).agg(F.min("target_id").alias("found"), F.count_distinct("target_id").alias("n")).where("n = 1").drop("n")
    own = targets.select(F.col("target_id").alias("evidence"), F.col("target_id").alias("found")).distinct()
    # a title goes before an id that reads the same
    named = titles.withColumn("first", F.lit(0)).unionByName(own.withColumn("first", F.lit(1))).groupBy("evidence").agg(F.min_by("found", "first").alias("found"))
    places = dealt_join(r.where("relation_type <> 'embeds_media'"), named, "evidence", "document_id")
    both = files.unionByName(places)
    lost = F.concat(F.lit("confluence:"), F.when(F.col("relation_type") == "embeds_media", "attachment").otherwise("page"), F.lit(":unresolved-"), short_hash(F.col("document_id"), F.col("evidence")))
    target = both.withColumn("target_id", F.coalesce("found", lost)).withColumn("resolution_status", F.when(F.col("found").isNotNull(), "resolved").otherwise("unresolved_target"))
    one = target.groupBy("document_id", "relation_type", "target_id").agg(F.min_by("evidence", "ordinal").alias("evidence"), F.min("resolution_status").alias("resolution_status"))
    return one.select(
        relation_id(F.col("document_id"), F.col("relation_type"), F.col("target_id")).alias("relation_id"), F.col("document_id").alias("source_id"), "target_id", "relation_type", "evidence",
        F.lit(None).cast("double").alias("confidence"), "resolution_status", F.lit(created_at).alias("created_at"),
    )


def merge_relation_ids(old: Column, new: Column) -> Column:
    """Sorted union of two lists of ids."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(old, none), F.coalesce(new, none)))


def keys_on_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with the issue keys of their whole document."""
    keys = docs.select("document_id", issue_keys(F.col("text")).alias("jira_keys"))
    return chunks.drop("jira_keys").join(keys, "document_id", "left").withColumn("jira_keys", F.coalesce("jira_keys", F.array().cast("array<string>")))


#: How a media file is processed, by MIME type or by the end of its name.
DIAGRAM, PDF, IMAGE = r"(?i)\.(drawio|drawio\.xml)$", r"(?i)\.pdf$", r"(?i)\.(png|jpe?g|gif|bmp|tiff?|webp)$"


def route(mime: Column, filename: Column) -> Column:
    """drawio, pdf, image or unsupported."""
    m, name = F.lower(F.coalesce(mime, F.lit(""))), F.coalesce(filename, F.lit(""))
    return (
        F.when(m.contains("drawio") | name.rlike(DIAGRAM), "drawio")
        .when((m == "application/pdf") | name.rlike(PDF), "pdf")
        .when(m.startswith("image/") | name.rlike(IMAGE), "image")
        .otherwise("unsupported")
    )


def media_assets(attachments: DataFrame, policy: Column, crawled_at: str) -> DataFrame:
    """Attachments (document_id, media_id, filename, mime_type, size_bytes) -> media rows under one of three policies."""
    rows = attachments.withColumn("__policy", policy)
    return rows.select(
        "media_id", F.col("document_id").alias("parent_document_id"), "filename", "mime_type", "size_bytes",
        F.when(F.col("__policy") == "skip", "skipped").otherwise("not_attempted").alias("download_status"),
        F.lit("not_processed").alias("processing_status"),
        F.when(F.col("__policy") == "skip", "low").when(F.col("__policy") == "download_and_process", "high").otherwise("unknown").alias("relevance"),
        route(F.col("mime_type"), F.col("filename")).alias("route"), F.lit(crawled_at).alias("crawled_at"),
    )
