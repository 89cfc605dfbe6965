"""A set of raw pages through the whole chain, from the stored answer to chunks. A page that fails is set aside with its stage and
category, and stops no other; nothing of its content is told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import content_hash, page_document_id
from tessera.functions.storage import storage_pages
from tessera.operators import records
from tessera.operators.chunking import Budget, Spans, word_spans
from tessera.operators.wiki import chunk_pages, chunk_rows

#: Faults of a page's structure; other faults of ``chunk_pages`` are those of its chunks.
STRUCTURE = ("invalid_page_title", "unclosed_code_fence", "empty_structural_heading")


def process(pages: DataFrame, budget: Budget = Budget(), spans: Spans = word_spans) -> DataFrame:
    """(page_id, http_status, source_version, expected_source_version, body) -> a row per page: (page_id, document_id, title,
    space_key, source_version, updated_at, text, references, warnings, chunks, counters, stage, category, detail).

    Of a page that failed, ``stage`` and ``category`` tell where and how, and all that it would have given is null. Stages
    come in this order: ``raw_page`` (no body; a status other than 200; another version than expected), ``document`` (the
    body is of another page; of another version), ``normalization``, ``structure``, ``chunking``; ``detail`` is the field
    or the rule that was broken. A page_id that stands there twice is refused at both places, as the set is invalid then.
    One pass over the pages: the stages are a chain of columns and Arrow steps, without a shuffle but for repeated ids.
    """
    known = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("http_status").cast("int").alias("http_status"), F.col("source_version").cast("string").alias("raw_version"), F.col("expected_source_version").cast("string").alias("expected"), F.col("body").cast("string").alias("body"))
    twice = known.groupBy("page_id").count().where("count > 1").select("page_id", F.lit(True).alias("twice"))
    raw = known.join(twice, "page_id", "left")
    fields = records.page_fields(raw, keep=("http_status", "raw_version", "expected", "twice", "body"))
    first = (
        F.when(F.col("page_id").isNull() | F.col("twice"), _fault("raw_page", "invalid_request"))
        .when(F.col("body").isNull(), _fault("raw_page", "raw_page_read_failed"))
        .when(~F.col("http_status").eqNullSafe(F.lit(200)), _fault("raw_page", "raw_page_status_failed"))
        .when(F.col("expected").isNotNull() & ~F.col("raw_version").eqNullSafe(F.col("expected")), _fault("raw_page", "source_version_mismatch"))
        .when(F.col("fault") == "id", _fault("document", "document_identity_mismatch"))
        .when(F.col("fault").isNotNull(), _fault("normalization", "normalization_failed", F.col("fault")))
        .when(~F.col("raw_version").eqNullSafe(F.col("source_version")), _fault("document", "source_version_mismatch"))
    )
    rows = fields.withColumn("failed", first).drop("fault", "body", "http_status", "raw_version", "expected", "twice")
    rows = rows.withColumn("storage", F.when(F.col("failed").isNull(), F.col("storage")))
    rows = storage_pages(rows).withColumn("failed", F.coalesce("failed", F.when(F.col("fault").isNotNull(), _fault("normalization", "normalization_failed", F.col("fault"))))).drop("fault", "counters")
    rows = rows.withColumn("document_id", page_document_id(F.col("page_id")))
    made = chunk_pages(rows, budget=budget, spans=spans, keep=("page_id", "space_key", "source_version", "updated_at", "text", "references", "warnings", "failed"))
    structure = F.col("fault").isin(*STRUCTURE)
    failed = F.coalesce("failed", F.when(structure, _fault("structure", "structure_failed", F.col("fault"))), F.when(F.col("fault").isNotNull(), _fault("chunking", "chunking_failed", F.col("fault"))))
    out = made.withColumn("failed", failed)
    whole = F.col("failed").isNull()
    good = [F.when(whole, F.col(c)).alias(c) for c in ("document_id", "title", "space_key", "source_version", "updated_at", "text", "references", "warnings", "chunks", "counters")]
    return out.select("page_id", *good, "failed.stage", "failed.category", "failed.detail")


def _fault(stage: str, category: str, detail=None):
    return F.struct(F.lit(stage).alias("stage"), F.lit(category).alias("category"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def documents(done: DataFrame) -> DataFrame:
    """Documents of the pages that went through."""
    return done.where("stage IS NULL").select("document_id", "page_id", "title", "space_key", "source_version", "updated_at", "text", content_hash(F.col("text")).alias("content_hash"), "references")


def chunks(done: DataFrame) -> DataFrame:
    """Chunks of the pages that went through."""
    return chunk_rows(done.where("stage IS NULL"))


def faults(done: DataFrame) -> DataFrame:
    """(page_id, stage, category, detail) of the pages that were set aside."""
    return done.where("stage IS NOT NULL").select("page_id", "stage", "category", "detail")


def _is(kind: str):
    return lambda x: x == kind


def metrics(done: DataFrame) -> DataFrame:
    """One row: pages asked for, gone through and set aside, chunks, warnings and references, and chunks by kind."""
    kinds = [F.coalesce(F.sum(F.size(F.filter(F.transform("chunks", lambda c: c.content_kind), _is(kind)))), F.lit(0)).alias(f"{kind}_chunks") for kind in ("prose", "code_block", "table")]
    total = lambda c: F.coalesce(F.sum(F.when(F.col("stage").isNull(), F.size(c))), F.lit(0)).cast("bigint")
    return done.agg(F.count("*").alias("requested"), F.count_if(F.col("stage").isNull()).alias("succeeded"), F.count("stage").alias("failed"), total("chunks").alias("chunks"), total("warnings").alias("warnings"), total("references").alias("references"), *kinds)
