"""Versions of a dataset: what changed between two, tombstones for what went, and the overlay of a delta on its base."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.checkpoints import spread
from tessera.functions.ids import tombstone_id

#: Order of entity types in a tombstone stream.
ENTITY_ORDER = ("document", "chunk", "relation", "acl", "media", "symbol")
REASONS = ("source_deleted", "access_revoked", "moved_out_of_scope", "content_updated", "config_invalidated")


def classify(previous: DataFrame, current: DataFrame, key: str = "document_id", hashes: tuple[str, ...] = ("content_hash",), config_changed: bool = False) -> DataFrame:
    """(key, hashes...) of two versions -> (key, outcome): new, removed, changed, unchanged or config_invalidated.

    Hashes are compared null-safely (content, access, dependents: whichever columns are named). A changed configuration
    invalidates every document that both versions hold, whatever its hashes. A key must be unique in each version.
    """
    p = previous.select(key, F.lit(True).alias("__in_p"), *[F.col(h).alias(f"__p_{h}") for h in hashes])
    c = current.select(key, F.lit(True).alias("__in_c"), *[F.col(h).alias(f"__c_{h}") for h in hashes])
    same = F.lit(True)
    for h in hashes:
        same = same & F.col(f"__p_{h}").eqNullSafe(F.col(f"__c_{h}"))
    outcome = (
        F.when(F.col("__in_p").isNull(), "new")
        .when(F.col("__in_c").isNull(), "removed")
        .when(F.lit(config_changed), "config_invalidated")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return p.join(c, key, "full").select(key, outcome.alias("outcome"))


def stale_parts(previous: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("chunk_id", "content_hash")) -> DataFrame:
    """Rows of the previous version whose keys are gone or differ now."""
    return previous.join(current.select(*keys).distinct(), list(keys), "left_anti")


def tombstones(targets: DataFrame, version: str, detected_at: str) -> DataFrame:
    """(entity_type, entity_id, reason, detail) -> tombstone rows with their ids, each id once.

    Targets that agree in type, id and reason but not in detail contradict each other and fail the job; ``conflicts`` lists
    them.
    """
    blank = F.coalesce("detail", F.lit(""))
    once = targets.groupBy("entity_type", "entity_id", "reason").agg(F.min("detail").alias("detail"), F.min(blank).alias("__a"), F.max(blank).alias("__b"))
    clash = F.raise_error(F.concat(F.lit("targets contradict each other: "), F.col("entity_type"), F.lit(" "), F.col("entity_id").cast("string")))
    once = once.withColumn("detail", F.when(F.col("__a") == F.col("__b"), F.col("detail")).otherwise(clash.cast("string")))
    return once.select(
        tombstone_id(F.col("entity_type"), F.col("entity_id").cast("string"), F.col("reason"), F.lit(version)).alias("tombstone_id"),
        "entity_type", "entity_id", "reason", "detail", F.lit(detected_at).alias("detected_at"), F.lit(version).alias("dataset_version"),
    )


def conflicts(targets: DataFrame) -> DataFrame:
    """Targets with one type, id and reason but several details: a publication must have none."""
    kinds = targets.groupBy("entity_type", "entity_id", "reason").agg(F.count_distinct(F.coalesce("detail", F.lit(""))).alias("details"))
    return kinds.where("details > 1")


def entity_rank(entity_type: Column) -> Column:
    """Place of the type in a tombstone stream."""
    return F.array_position(F.lit(list(ENTITY_ORDER)), entity_type)


def in_order(tombs: DataFrame) -> DataFrame:
    """Tombstones by type, entity and id, as they are published."""
    return tombs.orderBy(entity_rank(F.col("entity_type")), "entity_id", "tombstone_id")


def cascade(documents: DataFrame, dependents: DataFrame) -> DataFrame:
    """Targets (document_id, reason, detail) and dependents (document_id, entity_type, entity_id) -> all targets.

    Each removed document takes its chunks, relations, access records, media and symbols with it, for its own reason.
    """
    roots = documents.select(F.lit("document").alias("entity_type"), F.col("document_id").alias("entity_id"), "reason", "detail")
    children = dependents.join(documents, "document_id").select("entity_type", "entity_id", "reason", "detail")
    return roots.unionByName(children)


#: Columns of the streams that tell what hangs on which document; symbols may name a document too.
_PLACE = ("repo", "branch", "commit_hash", "file_path")
_OWNERS = {
    "documents": ("document_id", "source_system", "repo", "branch", "source_version", "file_path"), "chunks": ("chunk_id", "document_id"), "acl": ("acl_id", "document_id"), "media_assets": ("media_id", "parent_document_id"),
    "symbols": ("symbol_id", "chunk_id", *_PLACE, "document_id"), "relations": ("relation_id", "source_id", "target_id", "resolution_status"),
}


def _owned(streams: Mapping[str, DataFrame], *by: str) -> DataFrame:
    """(by..., document_id, entity_type, entity_id) of what hangs on documents, some more than once, whether these are there
    or not. Chunks and files are looked up among the rows that agree in the columns ``by``. Symbols and relations look for
    their chunk in one join."""
    none = F.lit(None).cast("string")
    files = streams["documents"].where("source_system = 'git'").select(*by, "repo", "branch", F.col("source_version").alias("commit_hash"), "file_path", F.col("document_id").alias("__file")).dropDuplicates([*by, *_PLACE])
    symbols = streams["symbols"]
    given = F.col("document_id") if "document_id" in symbols.columns else none
    asked = symbols.select(*by, *_PLACE, "chunk_id", given.alias("__given"), "symbol_id").join(files, [*by, *_PLACE], "left")
    asked = asked.select(*by, F.col("chunk_id").alias("__ref"), "__given", F.col("__file").alias("__else"), none.alias("__target"), F.lit("symbol").alias("entity_type"), F.col("symbol_id").alias("entity_id"))
    target = F.when(F.col("resolution_status") == "resolved", F.col("target_id"))
    relations = streams["relations"].select(*by, F.col("source_id").alias("__ref"), none.alias("__given"), F.col("source_id").alias("__else"), target.alias("__target"), F.lit("relation").alias("entity_type"), F.col("relation_id").alias("entity_id"))
    # symbols without a chunk find nothing, but must not meet in one task
    asks = asked.unionByName(relations).withColumn("__none", F.when(F.col("__ref").isNull(), F.xxhash64("entity_id")).otherwise(0))
    chunks = streams["chunks"].select(*by, F.col("chunk_id").alias("__ref"), F.col("document_id").alias("__of"), F.lit(0).cast("bigint").alias("__none"))
    owners = F.array_compact(F.array(F.coalesce("__given", "__of", "__else"), "__target"))
    found = asks.join(chunks, [*by, "__ref", "__none"], "left").select(*by, F.explode(owners).alias("document_id"), "entity_type", "entity_id")
    own = lambda rows, owner, kind, entity: rows.select(*by, F.col(owner).alias("document_id"), F.lit(kind).alias("entity_type"), F.col(entity).alias("entity_id"))
    parts = [own(streams["acl"], "document_id", "acl", "acl_id"), own(streams["media_assets"], "parent_document_id", "media", "media_id"), found]
    return reduce(DataFrame.unionByName, parts).where("entity_id IS NOT NULL AND document_id IS NOT NULL")


def dependents(streams: Mapping[str, DataFrame]) -> DataFrame:
    """What hangs on each document of a version: (document_id, entity_type, entity_id), each once.

    Access records and media by their document; symbols by their document, else their chunk's, else the Git file of their
    repository, branch, commit and path; relations by their source (a chunk stands for its document), and resolved ones by
    their target too.
    """
    return _owned(streams).distinct().join(streams["documents"].select("document_id").distinct(), "document_id", "left_semi")


def dependents_changes(previous: Mapping[str, DataFrame], current: Mapping[str, DataFrame], whole: bool = False) -> DataFrame:
    """``dependents`` of two versions against each other: (document_id, entity_type, entity_id, before, after), the rows that
    only one of them has, or all of them if ``whole``. Both are found in the same joins, and dealt out once, by document."""

    def both(s: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [v[s].select(*[c for c in _OWNERS[s] if c in v[s].columns], F.lit(new).alias("__new")) for v, new in ((previous, False), (current, True))])

    tagged = {s: both(s) for s in _OWNERS}
    sides = [F.bool_or(~F.col("__new")), F.bool_or("__new")]
    docs = tagged["documents"].where("document_id IS NOT NULL").groupBy("document_id").agg(sides[0].alias("__p"), sides[1].alias("__c"))
    rows = spread(_owned(tagged, "__new"), "document_id").groupBy("document_id", "entity_type", "entity_id").agg(sides[0].alias("before"), sides[1].alias("after"))
    told = rows.join(docs, "document_id").select("document_id", "entity_type", "entity_id", (F.col("before") & F.col("__p")).alias("before"), (F.col("after") & F.col("__c")).alias("after"))
    return told.where("before OR after" if whole else "before <> after")


def dependents_hash(rows: DataFrame) -> DataFrame:
    """(document_id, entity_type, entity_id) -> (document_id, dependents_hash): equal for equal sets, whatever their order.

    Hashes of the entities are added up, so that a document with very many is never gathered. Beside content and access
    this is the third thing that ``classify`` compares.
    """
    h = F.sha2(F.concat_ws("\x1f", "entity_type", "entity_id"), 256)
    words = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"__{i}") for i in range(2)]
    return rows.groupBy("document_id").agg(F.count("*").alias("__n"), *words).select("document_id", F.concat_ws(":", "__n", "__0", "__1").alias("dependents_hash"))


#: States of a media file that count as processed.
PROCESSED = ("parsed", "ocr", "summarized")


def version_metrics(streams: Mapping[str, DataFrame]) -> DataFrame:
    """(metric, n) of a version or of the sparse streams of a delta: rows of each stream, and the counters of a report."""
    rules = {
        "documents": {"confluence_documents": F.col("source_system") == "confluence", "git_documents": F.col("source_system") == "git"},
        "relations": {"unresolved_relations": F.col("resolution_status") != "resolved"},
        "media_assets": {"media_processed": F.col("processing_status").isin(*PROCESSED), "media_failed": F.col("processing_status") == "failed"},
        "symbols": {"symbols_resolved": F.col("chunk_id").isNotNull()},
        "chunks": {"default_deny_chunks": F.col("acl_tags") == F.array(F.lit("restricted:unresolved"))},
    }
    parts = []
    for name, rows in streams.items():
        wanted = rules.get(name, {})
        counts = rows.agg(F.count("*").alias(name), *[F.count_if(F.coalesce(c, F.lit(False))).alias(m) for m, c in wanted.items()])
        parts.append(counts.select(F.explode(F.map_from_arrays(F.lit([name, *wanted]), F.array(name, *wanted))).alias("metric", "n")))
    return reduce(DataFrame.unionByName, parts)


def tombstone_counts(tombs: DataFrame) -> DataFrame:
    """One row: how many tombstones of each type."""
    return tombs.agg(*[F.count_if(F.col("entity_type") == t).alias(t) for t in ENTITY_ORDER])


def overlay(base: DataFrame, delta: DataFrame, tombs: DataFrame, key: str, entity_type: str) -> DataFrame:
    """``base`` without tombstoned rows, and each row of ``delta`` in place of the base's row of that key, or added."""
    gone = tombs.where(F.col("entity_type") == entity_type).select(F.col("entity_id").cast(base.schema[key].dataType).alias(key)).distinct()
    kept = base.join(gone.unionByName(delta.select(key)).distinct(), key, "left_anti")
    return kept.select(*base.columns).unionByName(delta.select(*base.columns))


def sparse_rows(previous: DataFrame, current: DataFrame, key: str, affected: DataFrame, owner: str = "document_id") -> DataFrame:
    """Rows of ``current`` that a delta must hold: those whose owner is affected, and those that differ from before."""
    columns = current.columns
    before = previous.select(key, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256).alias("__before"))
    hurt = affected.select(owner).distinct().withColumn("__hurt", F.lit(True))
    now = current.withColumn("__now", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256))
    joined = now.join(before, key, "left").join(hurt, owner, "left")
    return joined.where(F.col("__hurt") | ~F.col("__now").eqNullSafe(F.col("__before"))).select(*columns)


def disposition(status: Column, in_scope: Column) -> Column:
    """What a page that an inventory misses was found to be, by the answer to a probe.

    404: deleted. 403: access revoked. 200 outside the scope: moved. 200 inside it, 401 and the other 4xx contradict the
    inventory (``failed``); anything else says nothing (``incomplete``).
    """
    return (
        F.when(status == 404, "source_deleted")
        .when(status == 403, "access_revoked")
        .when((status == 200) & ~in_scope, "moved_out_of_scope")
        .when((status == 200) | status.between(400, 499), "failed")
        .otherwise("incomplete")
    )


def missing(prior: DataFrame, selection: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages of the prior version that the new selection does not hold."""
    return prior.join(selection.select(key).distinct(), key, "left_anti")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one version that the other lacks, with their number and ``side``: empty if both hold the same rows."""
    names = sorted(a.columns)
    if names != sorted(b.columns):
        raise ValueError("the two streams have different columns")
    counted = a.select(*names, F.lit(1).alias("__n")).unionByName(b.select(*names, F.lit(-1).alias("__n")))
    net = counted.groupBy(*names).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return net.select(*names, F.abs("__n").alias("copies"), F.when(F.col("__n") > 0, "first").otherwise("second").alias("side"))
