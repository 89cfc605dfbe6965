"""Access control: principals, restrictions of a page and of the pages above it, and the tags that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import acl_id

#: The tag that nobody holds, and what a space key looks like.
UNRESOLVED = "restricted:unresolved"
SPACE_KEY = r"\A[A-Z0-9]+\z"


def enforceable(names: Column) -> Column:
    """Names that can be compared at all: not null, not empty, without white space."""
    return F.filter(names, lambda x: x.isNotNull() & (F.length(x) > 0) & ~x.rlike(r"\s"))


def distinct_principals(names: Column) -> Column:
    """Enforceable names in order, each once whatever its case; the first spelling stays."""
    return F.transform(F.array_sort(F.transform(first_spellings(names), lambda x: F.struct(x.i.alias("i"), x.v.alias("v")))), lambda x: x.v)


def first_spellings(names: Column) -> Column:
    """Of the enforceable names the first of each lower-case form, as (k, i, v): form, place, spelling; sorted by form.

    Sorted names are laid beside themselves, one place on, so the work does not grow with the square of their number.
    """
    own = F.array_sort(F.transform(enforceable(names), lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("v"))))
    before = F.concat(F.array(F.lit(None).cast("struct<k:string,i:int,v:string>")), own)
    return F.array_compact(F.zip_with(own, before, lambda a, b: F.when(a.isNotNull() & (b.isNull() | (a.k != b.k)), a)))


def tags(users: Column, groups: Column) -> Column:
    """Sorted tags ``user:<name>`` and ``group:<name>``, lower case; the unresolved tag where nobody is left."""
    both = F.array_sort(F.array_union(
        F.transform(enforceable(users), lambda x: F.concat(F.lit("user:"), F.lower(x))),
        F.transform(enforceable(groups), lambda x: F.concat(F.lit("group:"), F.lower(x))),
    ))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit(UNRESOLVED)))


def classify_observation(status: Column, users: Column, groups: Column) -> Column:
    """What an answer about restrictions says: an answer other than 200, or one without lists, is ``unavailable``."""
    well_formed = (status == 200) & users.isNotNull() & groups.isNotNull()
    return F.when(~F.coalesce(well_formed, F.lit(False)), "unavailable").when(F.size(users) + F.size(groups) == 0, "unrestricted").otherwise("restricted")


def materialize(observations: DataFrame, pages: DataFrame, crawler: str, extracted_at: str) -> DataFrame:
    """Restriction levels of pages, and the pages' spaces -> one access record per document.

    Rows are (document_id, level, source_page_id, classification, users, groups), level 0 the topmost page; ``pages`` is
    (document_id, space_key). A document is seen by those whom every restricted level names: the intersection over its
    levels. The lists of allowed names are evidence, so they hold the union, each name as first written. If a level is
    unavailable, or nobody is left, the document is seen by nobody. A document whose levels are all unrestricted is seen by
    its space; without a well-formed space key by nobody, although it is not restricted. Whatever was left out or lost on
    the way makes the record partial, and ``reason_codes`` tells why. Level lists are as long as a page's path of ancestors.
    """
    none = F.array().cast("array<string>")
    level = F.struct("level", "source_page_id", "classification", "users", "groups")
    chains = observations.groupBy("document_id").agg(F.array_sort(F.collect_list(level)).alias("levels")).join(pages.select("document_id", "space_key"), "document_id", "left")
    held = F.filter("levels", lambda x: x["classification"] == "restricted")
    rows = chains.select("document_id", "space_key", "levels", held.alias("held"), F.exists("levels", lambda x: x["classification"] == "unavailable").alias("lost"))

    def common(part: str) -> Column:
        lists = F.transform("held", lambda x: F.array_distinct(F.transform(enforceable(x[part]), F.lower)))
        return F.aggregate(F.slice(lists, 2, 1 << 30), F.coalesce(F.try_element_at(lists, F.lit(1)), none), lambda a, b: F.array_intersect(a, b))

    def every(part: str) -> Column:
        """All enforceable names as first written, by their lower-case form."""
        return F.transform(first_spellings(F.flatten(F.transform("held", lambda x: x[part]))), lambda x: x.v)

    def unusable(part: str) -> Column:
        return F.exists("levels", lambda x: F.size(x[part]) > F.size(enforceable(x[part])))

    rows = rows.select("*", *[f(p).alias(f"{n}_{p}") for p in ("users", "groups") for n, f in (("common", common), ("all", every), ("bad", unusable))])
    bound, spaced = F.size("held") > 0, F.coalesce(F.col("space_key").rlike(SPACE_KEY), F.lit(False))
    left = tags(F.col("common_users"), F.col("common_groups"))
    code = lambda condition, name: F.when(condition, F.lit(name))
    bad = [code(F.col("bad_users"), "non_enforceable_user_principal"), code(F.col("bad_groups"), "non_enforceable_group_principal")]
    reasons = (
        F.when(F.col("lost"), F.array_compact(F.array(F.lit("restriction_observations_unavailable"), *bad)))
        .when(~bound, F.array_compact(F.array(code(~spaced, "space_tag_unrepresentable"))))
        .otherwise(F.array_compact(F.array(
            *bad,
            code(F.size("all_users") > F.size("common_users"), "user_principal_dropped_by_intersection"),
            code(F.size("all_groups") > F.size("common_groups"), "group_principal_dropped_by_intersection"),
            code(F.size("common_users") + F.size("common_groups") == 0, "empty_effective_intersection"),
        )))
    )
    last = F.array_max(F.transform("levels", lambda x: x["level"]))
    known = lambda x: F.when(~F.col("lost"), x)
    return rows.select(
        acl_id(F.col("document_id").cast("string")).alias("acl_id"),
        "document_id",
        F.lit(crawler).alias("crawler_identity"),
        (F.col("lost") | bound).alias("is_restricted"),
        known(F.exists("held", lambda x: x["level"] < last)).alias("restriction_inherited"),
        known(F.transform("held", lambda x: x["source_page_id"].cast("string"))).alias("restriction_source_page_ids"),
        known(F.col("all_users")).alias("allowed_users"),
        known(F.col("all_groups")).alias("allowed_groups"),
        F.when(F.col("lost"), F.array(F.lit(UNRESOLVED))).when(bound, left).when(spaced, F.array(F.concat(F.lit("space:"), "space_key"))).otherwise(F.array(F.lit(UNRESOLVED))).alias("acl_tags"),
        F.when(F.col("lost"), "unavailable").when(F.size(reasons) > 0, "partial").otherwise("ok").alias("acl_extraction_status"),
        F.when(F.col("lost") | (F.size(reasons) > 0), "approximate").otherwise("exact").alias("acl_confidence"),
        reasons.alias("reason_codes"),
        F.lit(extracted_at).alias("extracted_at"),
    )


def fingerprint(acl: DataFrame) -> DataFrame:
    """document_id and the hash of what decides who may see it: its canonical JSON, keys in order, without spaces."""
    fields = F.struct("acl_id", "acl_tags", "document_id", "is_restricted", "source_system")
    return acl.select("document_id", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def tag_chunks(chunks: DataFrame, acl: DataFrame) -> DataFrame:
    """Chunks with the tags of their document; a document without a record is unresolved."""
    known = acl.select("document_id", F.col("acl_tags").alias("__tags"))
    joined = chunks.drop("acl_tags").join(known, "document_id", "left")
    return joined.withColumn("acl_tags", F.coalesce("__tags", F.array(F.lit(UNRESOLVED)))).drop("__tags")


def quality(acl: DataFrame) -> DataFrame:
    """One row of counts: records, restricted, inherited, unresolved, and by extraction status."""
    return acl.agg(
        F.count("*").alias("records"),
        F.count_if("is_restricted").alias("restricted"),
        F.count_if("restriction_inherited").alias("inherited"),
        F.count_if(F.array_contains("acl_tags", UNRESOLVED)).alias("unresolved"),
        *[F.count_if(F.col("acl_extraction_status") == s).alias(s) for s in ("ok", "partial", "unavailable")],
    )
