"""Checks that a snapshot is closed and well formed. Each gives a row per violation, so that one count decides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def duplicates(rows: DataFrame, key: str, check: str) -> DataFrame:
    """Ids that occur more than once, or are null."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).select(F.lit(check).alias("check"), F.col(key).cast("string").alias("id"))


def orphans(rows: DataFrame, owners: DataFrame, keys: Mapping[str, str], check: str, label: str) -> DataFrame:
    """Rows without an owner; ``keys`` maps their columns to the owner's. A null key has no owner."""
    wanted = owners.select(*[F.col(o).alias(k) for k, o in keys.items()]).distinct()
    return rows.join(wanted, list(keys), "left_anti").select(F.lit(check).alias("check"), F.col(label).cast("string").alias("id"))


def unpaired(a: DataFrame, b: DataFrame, key: str, check: str) -> DataFrame:
    """Keys that only one of two sides holds, where both must hold the same."""
    left, right = a.select(key, F.lit(True).alias("__a")).distinct(), b.select(key, F.lit(True).alias("__b")).distinct()
    return left.join(right, key, "full").where("__a IS NULL OR __b IS NULL").select(F.lit(check).alias("check"), F.col(key).cast("string").alias("id"))


def unequal(a: DataFrame, b: DataFrame, key: str, column: str, check: str) -> DataFrame:
    """Keys of both sides where a column differs, such as the tags of a chunk and of its document."""
    both = a.select(key, F.col(column).alias("__a")).join(b.select(key, F.col(column).alias("__b")), key)
    return both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select(F.lit(check).alias("check"), F.col(key).cast("string").alias("id")).distinct()


def dangling(rows: DataFrame, column: str, targets: DataFrame, target: str, check: str) -> DataFrame:
    """Elements of an array column that name no target."""
    named = rows.select(F.explode(column).alias(target))
    return named.join(targets.select(target).distinct(), target, "left_anti").select(F.lit(check).alias("check"), F.col(target).cast("string").alias("id")).distinct()


def _told(rows: DataFrame, check: str, label: Column | str) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), (F.col(label) if isinstance(label, str) else label).cast("string").alias("id"))


def sync_violations(documents: DataFrame, media: DataFrame, sync: DataFrame) -> DataFrame:
    """Sync rows must stand for exactly the documents, media and Git repositories of a version, once each, active, of the
    right type and format."""
    kind = F.when(F.col("document_id").startswith("confluence:page:"), "page").otherwise("file")
    repos = documents.where("source_system = 'git' AND repo IS NOT NULL").select(F.col("repo").alias("entity_id"), F.lit("repo").alias("__kind"))
    named = sync.where("entity_type = 'repo'").select("entity_id", F.lit("repo").alias("__kind"))
    entities = documents.select(F.col("document_id").alias("entity_id"), kind.alias("__kind")).unionByName(media.select(F.col("media_id").alias("entity_id"), F.lit("attachment").alias("__kind")))
    expected = entities.unionByName(repos.unionByName(named).join(entities, "entity_id", "left_anti")).distinct()
    both = expected.join(sync.withColumn("__in", F.lit(True)), "entity_id", "full")
    wrong = ~((F.col("entity_type") == F.col("__kind")) & (F.col("status") == "active") & (F.col("schema_version") == "1.0"))
    return (
        _told(both.where("__in IS NULL"), "sync_missing", "entity_id")
        .unionByName(_told(both.where("__kind IS NULL"), "sync_unexpected", "entity_id"))
        .unionByName(_told(both.where("__in AND __kind IS NOT NULL").where(F.coalesce(wrong, F.lit(True))), "sync_wrong", "entity_id"))
        .unionByName(duplicates(sync, "entity_id", "sync_twice"))
    )


def tombstone_violations(tombs: DataFrame, prior: Mapping[str, DataFrame]) -> DataFrame:
    """Tombstones must have ids of their own and name entities of the prior version. ``prior`` maps entity types to (id)."""
    known = reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("entity_type"), F.col(rows.columns[0]).cast("string").alias("entity_id")) for kind, rows in prior.items()]).distinct()
    lost = tombs.withColumn("entity_id", F.col("entity_id").cast("string")).join(known, ["entity_type", "entity_id"], "left_anti")
    return _told(lost, "tombstone_target", F.concat_ws(":", "entity_type", "entity_id")).unionByName(duplicates(tombs, "tombstone_id", "tombstone_id_unique"))


STATUSES = ("resolved", "unresolved_without_jira_api", "deferred_mvp", "unresolved_target")


def relation_violations(documents: DataFrame, chunks: DataFrame, media: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations have a known status; resolved ones lead to an entity of the version, others to none; media belong to the page
    that embeds them; page relations join two wiki pages; and each owner lists its relations."""
    owners = documents.select(F.col("document_id").alias("source_id"), "relation_ids", F.col("source_system").alias("__source")).unionByName(chunks.select(F.col("chunk_id").alias("source_id"), "relation_ids", F.lit(None).cast("string").alias("__source")))
    entities = documents.select(F.col("document_id").alias("target_id"), F.col("source_system").alias("__target"), F.lit(None).cast("string").alias("__parent"))
    entities = entities.unionByName(chunks.select(F.col("chunk_id").alias("target_id"), F.lit(None).cast("string").alias("__target"), F.lit(None).cast("string").alias("__parent")))
    entities = entities.unionByName(media.select(F.col("media_id").alias("target_id"), F.lit(None).cast("string").alias("__target"), F.col("parent_document_id").alias("__parent"))).withColumn("__there", F.lit(True))
    rows = relations.join(owners, "source_id", "left").join(entities, "target_id", "left")
    found, resolved = F.coalesce("__there", F.lit(False)), F.col("resolution_status") == "resolved"
    rules = {
        "relation_status": F.col("resolution_status").isin(*STATUSES) & (F.col("target_id") != ""),
        "resolved_target_missing": ~resolved | found,
        "unresolved_target_emitted": resolved | ~found,
        "media_of_its_page": ~(resolved & (F.col("relation_type") == "embeds_media")) | (F.col("__parent") == F.col("source_id")),
        "page_relation_of_pages": ~(resolved & F.col("relation_type").isin("includes_page", "links_to_page")) | ((F.col("__source") == "confluence") & (F.col("__target") == "confluence")),
        "owner_lists_relation": F.array_contains("relation_ids", F.col("relation_id")),
    }
    return rule_violations(rows, rules, "relation_id")


def part_violations(chunks: DataFrame) -> DataFrame:
    """Chunks of a document that were cut from one block must follow each other: parts 0 to total - 1 of one kind.

    Rows are (document_id, chunk_id, chunk_index, part_index, part_total, content_kind); both part columns null: a block of
    its own.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    part = F.struct("part_index", "part_total", "content_kind")
    rows = chunks.withColumn("__before", F.lag(part).over(order)).withColumn("__next", F.lead(part).over(order))

    def follows(a: str, b: str, step: int) -> Column:
        return (F.col(f"{b}.part_index") == F.col(f"{a}.part_index") + step) & (F.col(f"{b}.part_total") == F.col(f"{a}.part_total")) & (F.col(f"{b}.content_kind") == F.col(f"{a}.content_kind"))

    rows = rows.withColumn("__own", part)
    whole = F.col("part_index").isNull() & F.col("part_total").isNull()
    inside = (F.col("part_index") >= 0) & (F.col("part_index") < F.col("part_total"))
    fine = inside & ((F.col("part_index") == 0) | follows("__own", "__before", -1)) & ((F.col("part_index") == F.col("part_total") - 1) | follows("__own", "__next", 1))
    return _told(rows.where(~(whole | F.coalesce(fine, F.lit(False)))), "part_order", "chunk_id")


def order_violations(rows: DataFrame, group: Sequence[str], place: Sequence[str], value: str, check: str) -> DataFrame:
    """Rows of a group, in the order of ``place``, whose value does not grow."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*place))
    return _told(rows.withColumn("__before", before).where(F.col("__before") >= F.col(value)), check, F.concat_ws(":", *group, value))


def gap_violations(rows: DataFrame, group: Sequence[str], ordinal: str, check: str, first: int = 1) -> DataFrame:
    """Groups whose ordinals are not first, first + 1, ... without gap and repeat."""
    n = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(ordinal).alias("kinds"), F.min(ordinal).alias("low"), F.max(ordinal).alias("high"))
    fine = (F.col("n") == F.col("kinds")) & (F.col("low") == first) & (F.col("high") == F.col("n") + first - 1)
    return _told(n.where(~F.coalesce(fine, F.lit(False))), check, F.concat_ws(":", *group))


def snapshot_violations(s: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of a snapshot of streams documents, chunks, relations, acl, media_assets, symbols; and of sync_state,
    tombstones and the relations' own rules, where the streams have what these need."""
    git = s["documents"]
    if "source_version" in git.columns and "commit_hash" not in git.columns:
        git = git.withColumn("commit_hash", F.col("source_version"))
    place = {k: k for k in ("repo", "branch", "commit_hash", "file_path") if k in git.columns}
    parts = [
        duplicates(s["documents"], "document_id", "document_id_unique"),
        duplicates(s["chunks"], "chunk_id", "chunk_id_unique"),
        duplicates(s["relations"], "relation_id", "relation_id_unique"),
        unpaired(s["documents"], s["acl"], "document_id", "acl_per_document"),
        orphans(s["chunks"], s["documents"], {"document_id": "document_id"}, "chunk_has_document", "chunk_id"),
        unequal(s["chunks"], s["acl"], "document_id", "acl_tags", "chunk_tags_of_document"),
        orphans(s["media_assets"], s["documents"], {"parent_document_id": "document_id"}, "media_has_document", "media_id"),
        orphans(
            s["relations"], s["documents"].select("document_id").unionByName(s["chunks"].select(F.col("chunk_id").alias("document_id"))),
            {"source_id": "document_id"}, "relation_has_source", "relation_id",
        ),
        dangling(s["documents"], "relation_ids", s["relations"], "relation_id", "relation_ids_exist"),
        orphans(s["symbols"], git, place, "symbol_has_file", "symbol_id"),
    ]
    if "sync_state" in s:
        parts.append(sync_violations(s["documents"], s["media_assets"], s["sync_state"]))
    return reduce(DataFrame.unionByName, parts)


def require_none(violations: DataFrame, most: int = 5) -> None:
    """Raise if there is a violation; only names of checks and counts are told, never contents."""
    found = violations.groupBy("check").count().orderBy("check").limit(most).collect()
    if found:
        raise ValueError("; ".join(f"{r['check']}: {r['count']}" for r in found))


def rule_violations(rows: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """(check, id) of each row and rule that does not hold; a rule that gives null does not hold."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(failed).alias("check"), F.col(key).cast("string").alias("id"))


def gate(metrics: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Metrics -> passed and reasons: the names of the rules that fail, joined by semicolons."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return metrics.select("*", (F.size(reasons) == 0).alias("passed"), F.concat_ws(";", reasons).alias("reasons"))
