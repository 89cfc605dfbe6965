"""Records of pages, attachments and stores: parsed from what a source sends, put in order, and summed up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.canonical import digest

PAGE = "id string, type string, title string, space struct<key:string>, version struct<number:bigint,when:string>, ancestors array<struct<id:string>>, body struct<storage:struct<value:string,representation:string>>"
ATTACHMENTS = "results array<struct<id:string,type:string,title:string,metadata:struct<mediaType:string>,version:struct<number:bigint>,extensions:struct<fileSize:bigint>>>"


# ---- what a source sends


def page_fields(pages: DataFrame, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """(page_id, body as JSON) -> (page_id, title, space_key, source_version, updated_at, storage, fault), and columns to keep.

    A page is taken only as it must be: an object of that id, of type page (or none named), with a title, a space, a positive
    version with its time, and a body in storage form. ``fault`` names the first field that is not so; then the others are
    null.
    """
    p = F.from_json(F.col(body), PAGE)
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), p.alias("p"), F.json_object_keys(body).isNull().alias("broken"), *keep)
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = {
        "payload": F.col("broken"),
        "id": ~F.col("p.id").eqNullSafe(F.col("page_id")),
        "type": F.coalesce(F.col("p.type") != "page", F.lit(False)),
        "title": blank(F.col("p.title")),
        "space.key": blank(F.col("p.space.key")),
        "version.number": F.coalesce(F.col("p.version.number") <= 0, F.lit(True)),
        "version.when": blank(F.col("p.version.when")),
        "body.storage.value": F.col("p.body.storage.value").isNull(),
        "body.storage.representation": ~F.col("p.body.storage.representation").eqNullSafe(F.lit("storage")),
    }
    fault = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    good = rows.withColumn("fault", fault)
    fields = {"title": "p.title", "space_key": "p.space.key", "source_version": "p.version.number", "updated_at": "p.version.when", "storage": "p.body.storage.value"}
    return good.select("page_id", *[F.when(F.col("fault").isNull(), F.col(c).cast("string")).alias(n) for n, c in fields.items()], "fault", *keep)


def restriction_targets(pages: DataFrame, body: str = "body") -> DataFrame:
    """(page_id, body as JSON) -> (page_id, targets, fault): the pages above, top first, then the page itself.

    Their restrictions are what decides who sees the page. A page among its own ancestors, an ancestor twice, one without
    a numeric id, or a missing list is a fault.
    """
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.from_json(F.col(body), PAGE)["ancestors"].alias("a"))
    ids = rows.select("page_id", F.transform("a", lambda x: x["id"]).alias("a"))
    fault = (
        F.when(F.col("a").isNull(), "missing")
        .when(F.exists("a", lambda x: ~F.coalesce(x.rlike(r"^[0-9]+$"), F.lit(False))), "invalid")
        .when(F.array_contains("a", F.col("page_id")), "self")
        .when(F.size(F.array_distinct("a")) < F.size("a"), "duplicate")
    )
    return ids.withColumn("fault", fault).select("page_id", F.when(F.col("fault").isNull(), F.array_append("a", F.col("page_id"))).alias("targets"), "fault")


def attachments(windows: DataFrame, body: str = "body") -> DataFrame:
    """(page_id, body as JSON) -> one row per attachment of a page's windows: (page_id, attachment_id, filename, mime_type,
    source_version, size_bytes). An attachment that two windows name is one row."""
    found = windows.select("page_id", F.explode(F.from_json(F.col(body), ATTACHMENTS)["results"]).alias("r")).where("r.id IS NOT NULL AND r.title IS NOT NULL AND coalesce(r.type, 'attachment') = 'attachment'")
    return found.select(
        "page_id", F.col("r.id").alias("attachment_id"), F.col("r.title").alias("filename"), F.coalesce("r.metadata.mediaType", F.lit("application/octet-stream")).alias("mime_type"),
        F.col("r.version.number").cast("string").alias("source_version"), F.col("r.extensions.fileSize").alias("size_bytes"),
    ).dropDuplicates(["page_id", "attachment_id"])


def page_address(url: Column) -> Column:
    """A page's https address -> struct (base_url, space_key, page_id); null for other shapes.

    Known are ``.../spaces/KEY/pages/ID[/title]``, ``.../pages/viewpage.action?pageId=ID`` with an optional space key and title,
    and short links ``.../x/TOKEN``, whose token is the page's number, least byte first, in base 64 without padding. The space
    key is null where the address does not tell it.
    """
    head = r"^https://([^/:@?#\s]+)(?::([0-9]+))?((?:/[^/?#\s]+)*?)"
    long, view, short = head + r"/spaces/([A-Z0-9]+)/pages/([0-9]+)(?:/[^?#\s]*)?$", head + r"/(?i:pages/viewpage\.action)\?([^#\s]+)$", head + r"/x/([A-Za-z0-9_-]{1,11})$"

    def base(shape: str) -> Column:
        port = F.regexp_extract(url, shape, 2)
        return F.concat(F.lit("https://"), F.lower(F.regexp_extract(url, shape, 1)), F.when(port.isin("", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.regexp_extract(url, shape, 3))

    def made(base_url: Column, space: Column, page: Column) -> Column:
        return F.struct(base_url.alias("base_url"), space.cast("string").alias("space_key"), page.cast("string").alias("page_id"))

    query = F.str_to_map(F.regexp_extract(url, view, 4), F.lit("&"), F.lit("="))
    known = F.lit(["pageId", "spaceKey", "title"])
    # a map keeps the last of two equal keys or fails, so keys are counted before one is made
    names = F.transform(F.split(F.regexp_extract(url, view, 4), "&"), lambda x: F.substring_index(x, "=", 1))
    once = (F.size(F.array_distinct(names)) == F.size(names)) & (F.size(F.array_except(names, known)) == 0) & F.array_contains(names, "pageId")
    page = F.try_element_at(F.when(url.rlike(view) & once, query), F.lit("pageId"))
    viewed = page.rlike(r"^[0-9]+$") & F.coalesce(F.try_element_at(F.when(once, query), F.lit("title")) != "", F.lit(True))
    token = F.regexp_extract(url, short, 4)
    # eight bytes of zeros behind the token's; written out as pairs of digits, the last byte first
    padded = F.rpad(F.translate(token, "-_", "+/"), 12, "A")
    number = F.conv(F.array_join(F.reverse(F.slice(F.split(F.regexp_replace(F.hex(F.unbase64(padded)), "(..)(?!$)", "$1,"), ","), 1, 8)), ""), 16, 10)
    return (
        F.when(url.rlike(long), made(base(long), F.regexp_extract(url, long, 4), F.regexp_extract(url, long, 5)))
        .when(url.rlike(view) & F.coalesce(viewed, F.lit(False)), made(base(view), F.try_element_at(F.when(once, query), F.lit("spaceKey")), page))
        .when(url.rlike(short) & (number != "0"), made(base(short), F.lit(None), number))
    )


def diagram_name(filename: Column) -> Column:
    """Whether a file can be the source of a draw.io diagram: by its ending, or because its name has none."""
    name = F.lower(filename)
    return F.coalesce((filename != "") & (name.endswith(".drawio") | name.endswith(".drawio.xml") | name.endswith(".xml") | ~filename.contains(".")), F.lit(False))


def match_diagrams(references: DataFrame, files: DataFrame) -> DataFrame:
    """(page_id, filename) and attachments -> references with attachment_id; two matches fail the job, none gives null."""
    usable = files.where(diagram_name(F.col("filename"))).groupBy("page_id", "filename").agg(F.min("attachment_id").alias("attachment_id"), F.count("*").alias("__n"))
    clash = F.raise_error(F.concat(F.lit("ambiguous diagram attachment on page "), F.col("page_id").cast("string")))
    joined = references.join(usable, ["page_id", "filename"], "left")
    return joined.withColumn("attachment_id", F.when(F.col("__n") > 1, clash.cast("string")).otherwise(F.col("attachment_id"))).drop("__n")


# ---- records of a version


def sync_state(documents: DataFrame, media: DataFrame, source_id: str, synced_at: str) -> DataFrame:
    """One row per page, file, attachment and repository of a version: what was seen of it last.

    Repositories come from the Git documents' ``repo``; their version is the documents' (the greatest, were they to differ).
    """
    kind = F.when(F.col("source_system") == "confluence", "page").when(F.col("source_system") == "git", "file")
    pages = documents.select(F.col("document_id").alias("entity_id"), kind.alias("entity_type"), F.col("source_version").alias("last_seen_version"), F.col("content_hash").alias("last_content_hash"))
    files = media.select(F.col("media_id").alias("entity_id"), F.lit("attachment").alias("entity_type"), F.col("source_version").alias("last_seen_version"), F.col("content_hash").alias("last_content_hash"))
    repos = documents.where("source_system = 'git' AND repo IS NOT NULL").groupBy(F.col("repo").alias("entity_id")).agg(F.max("source_version").alias("last_seen_version"))
    repos = repos.select("entity_id", F.lit("repo").alias("entity_type"), "last_seen_version", F.lit(None).cast("string").alias("last_content_hash"))
    rows = pages.unionByName(files).unionByName(repos)
    return rows.select("*", F.lit("1.0").alias("schema_version"), F.lit("active").alias("status"), F.lit(source_id).alias("source_id"), F.lit(synced_at).alias("last_synced_at"))


def slim_payload(chunks: DataFrame) -> DataFrame:
    """What a vector store keeps beside a vector: the chunk's ids and when it was indexed, no content."""
    return chunks.select("chunk_id", F.col("document_id").cast("string").alias("document_id"), "source_type", "source_id", "chunk_index", F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("indexed_at"))


def union_sources(streams: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of several sources as one stream; an id that occurs twice fails the job."""
    rows = reduce(DataFrame.unionByName, streams)
    many = F.count("*").over(Window.partitionBy(key))
    clash = F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.withColumn("__n", many).withColumn(key, F.when((F.col("__n") > 1) | F.col(key).isNull(), clash.cast(rows.schema[key].dataType)).otherwise(F.col(key))).drop("__n")


def page_metrics(relations: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counters of media and page relations: all, resolved, unresolved, documents and chunks that gained some."""
    owners = relations.select(F.col("source_id").alias("document_id")).distinct()
    counts = relations.agg(F.count("*").alias("relations_total"), F.count_if(F.col("resolution_status") == "resolved").alias("resolved"), F.count_if(F.col("resolution_status") != "resolved").alias("unresolved_target"))
    of = lambda rows, name: rows.join(owners, "document_id", "left_semi").agg(F.count("*").alias(name))
    return counts.join(F.broadcast(of(documents, "documents_enriched"))).join(F.broadcast(of(chunks, "chunks_enriched")))  # one row each


# ---- orders


def chunks_of(chunks: DataFrame, document_id: object) -> DataFrame:
    """The chunks of one document in their order."""
    return chunks.where(F.col("document_id") == F.lit(document_id)).orderBy("chunk_index")


def inventory_order(pages: DataFrame) -> DataFrame:
    """Pages by space, path of ancestors and id."""
    return pages.orderBy("space_key", "ancestor_ids", "page_id")


def symbol_order(symbols: DataFrame) -> DataFrame:
    """Symbols by file, line and id."""
    return symbols.orderBy("file_path", "line_start", "symbol_id")


def occurrence_order(sightings: DataFrame) -> DataFrame:
    """Sightings of a crawl by root, window and place in the window."""
    return sightings.orderBy("root_id", "window", "ordinal")


# ---- sums


def chunk_summaries(chunks: DataFrame, documents: DataFrame, profile: str, chunker: str) -> DataFrame:
    """(document_id, chunk_count, kinds, digest) of each document's chunks in their order.

    The digest is over canonical JSON: the entries with id, hash, kind, tokens and part, and the versions they were made
    with. It tells whether a second run gives the same chunks. A document's chunks are as many as its text gives.
    """
    entry = F.struct("chunk_id", "content_hash", "content_kind", "part_index", "part_total", "token_count")
    per = chunks.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    rows = documents.select("document_id", "content_hash").join(per, "document_id", "left").withColumn("entries", F.coalesce("entries", F.array().cast(per.schema["entries"].dataType)))
    kinds = F.array_sort(F.array_distinct(F.transform("entries", lambda x: x["content_kind"])))
    counts = F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.size(F.filter("entries", lambda x: x["content_kind"] == k)).alias("n")))
    rows = rows.select("document_id", "content_hash", "entries", F.size("entries").alias("chunk_count"), counts.alias("kinds"))
    payload = F.struct(
        F.col("chunk_count"), F.lit(chunker).alias("chunker_version"), F.map_from_entries("kinds").alias("content_kind_counts"), F.col("content_hash").alias("document_content_hash"),
        F.col("document_id"), F.col("entries"), F.lit("1").alias("format_version"), F.lit(profile).alias("profile_identity"),
    )
    return rows.select("document_id", "chunk_count", "kinds", digest(F.to_json(payload, {"ignoreNullFields": "false"})).alias("digest"))


def batch_totals(batches: DataFrame) -> DataFrame:
    """(state, requests, pages, bytes, retries) of batches -> one row of totals, and the digest that vouches for them."""
    t = batches.agg(
        F.count_if(F.col("state") == "committed").alias("committed"), F.count_if(F.col("state") != "committed").alias("failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("requests", "pages", "bytes", "retries")], (F.count("*") > 0).cast("int").alias("queue_high_watermark"),
    )
    return t.withColumn("digest", digest(F.concat_ws(":", "committed", "failed", "requests", "pages", "bytes", "retries", "queue_high_watermark")))


# ---- stores that are added to


def publish_raw(stored: DataFrame, new: DataFrame, keys: Sequence[str] = ("run_id", "page_id")) -> DataFrame:
    """What becomes of new bodies (keys, body): PUBLISHED, REPLAYED where the same bytes are there already, CONFLICT where others
    are. Only PUBLISHED rows are to be added; nothing stored is ever written over. Equal new rows count once."""
    once = new.groupBy(*keys).agg(F.min("body").alias("body"), (F.min("body") != F.max("body")).alias("__two"))
    held = stored.select(*keys, F.col("body").alias("__stored"))
    status = F.when(F.col("__two"), "CONFLICT").when(F.col("__stored").isNull(), "PUBLISHED").when(F.col("__stored") == F.col("body"), "REPLAYED").otherwise("CONFLICT")
    return once.join(held, list(keys), "left").select(*keys, "body", status.alias("status"))


def read_raw(stored: DataFrame, run_id: object, page_id: object) -> DataFrame:
    """One stored page, its body checked against the hash it was stored under."""
    row = stored.where((F.col("run_id") == F.lit(run_id)) & (F.col("page_id") == F.lit(page_id)))
    wrong = F.raise_error(F.lit("stored body does not have its hash"))
    return row.withColumn("body", F.when(F.sha2("body", 256) == F.col("sha256"), F.col("body")).otherwise(wrong.cast(stored.schema["body"].dataType)))
