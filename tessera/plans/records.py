"""Queries of the operators on records, versions and sources, with SQL that gives the same rows. Tables stand for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical, diagrams, ids, text
from tessera.functions.checkpoints import cut, spread, stored
from tessera.operators import code, crawl, delta, evaluation, integrity, records, relations, retrieval, store
from tessera.plans.registry import DAY, VERSION, query, table

_LINES_SQL = "lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders, one for each number; those of an order are dealt out once, to as many tasks as there are partitions."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))


# ---- what a source sends: customers as wiki pages in nations, parts as their files


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a wiki sends them; some miss what they must have."""
    k = F.col("c_custkey")
    above = F.when(k % 11 == 0, F.lit(None)).otherwise(F.array(*[F.struct(x.cast("string").alias("id")) for x in (F.col("c_nationkey") + 1_000_000, F.when(k % 13 == 0, k).otherwise(F.when(k % 17 == 0, F.col("c_nationkey") + 1_000_000).otherwise(k + 2_000_000)))]))
    body = F.to_json(F.struct(
        F.when(k % 7 == 0, k + 1).otherwise(k).cast("string").alias("id"), F.when(k % 5 == 0, "blogpost").otherwise("page").alias("type"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("title"),
        F.struct(F.col("c_mktsegment").alias("key")).alias("space"), F.struct((k % 4).alias("number"), F.lit(DAY).alias("when")).alias("version"), above.alias("ancestors"),
        F.struct(F.struct(F.concat(F.lit("<p>"), "c_name", F.lit("</p>")).alias("value"), F.lit("storage").alias("representation")).alias("storage")).alias("body"),
    ))
    return table(spark, sf_dir, "customer").select(k.alias("page_id"), F.when(k % 19 == 0, "no json").otherwise(body).alias("body"))


@query(f"""WITH f AS (SELECT *, CASE WHEN c_custkey % 19 = 0 THEN 'payload' WHEN c_custkey % 7 = 0 THEN 'id' WHEN c_custkey % 5 = 0 THEN 'type' WHEN c_custkey % 3 = 0 THEN 'title' WHEN c_custkey % 4 = 0 THEN 'version.number' END AS fault FROM customer)
SELECT c_custkey::VARCHAR AS page_id, CASE WHEN fault IS NULL THEN c_name END AS title, CASE WHEN fault IS NULL THEN c_mktsegment END AS space_key, CASE WHEN fault IS NULL THEN (c_custkey % 4)::VARCHAR END AS source_version,
CASE WHEN fault IS NULL THEN '{DAY}' END AS updated_at, CASE WHEN fault IS NULL THEN '<p>' || c_name || '</p>' END AS storage, fault FROM f""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page_fields(_bodies(spark, sf_dir))


@query("""WITH f AS (SELECT c_custkey AS k, c_nationkey + 1000000 AS n, CASE WHEN c_custkey % 19 = 0 OR c_custkey % 11 = 0 THEN 'missing' WHEN c_custkey % 13 = 0 THEN 'self' WHEN c_custkey % 17 = 0 THEN 'duplicate' END AS fault FROM customer)
SELECT k::VARCHAR AS page_id, CASE WHEN fault IS NULL THEN concat_ws('/', n, k + 2000000, k) END AS targets, fault FROM f""")
def restriction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.restriction_targets(_bodies(spark, sf_dir))
    return out.select("page_id", F.when(F.col("targets").isNotNull(), F.array_join("targets", "/")).alias("targets"), "fault")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as attachments of their orders' pages, two windows each that overlap."""
    k = F.col("l_linenumber")
    kind = F.when(k == 7, "comment").otherwise("attachment")
    one = F.struct(F.concat(F.lit("att"), "l_orderkey", F.lit("-"), k).alias("id"), kind.alias("type"), F.concat(F.lit("file"), F.col("l_partkey") % 40, F.when(k % 3 == 0, ".drawio").when(k % 3 == 1, ".png").otherwise("")).alias("title"), F.struct(F.lit("image/png").alias("mediaType")).alias("metadata"), F.struct(k.cast("bigint").alias("number")).alias("version"), F.struct(F.col("l_quantity").cast("bigint").alias("fileSize")).alias("extensions"))
    lines = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("page_id"), k.alias("k"), one.alias("r"))
    both = lines.where("k <= 4").withColumn("w", F.lit(0)).unionByName(lines.where("k >= 4").withColumn("w", F.lit(1)))
    return both.groupBy("page_id", "w").agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("body"))


_FILES_SQL = f"""{_LINES_SQL}, files AS (SELECT l_orderkey AS page_id, 'att' || l_orderkey || '-' || l_linenumber AS attachment_id,
 'file' || (l_partkey % 40) || CASE l_linenumber % 3 WHEN 0 THEN '.drawio' WHEN 1 THEN '.png' ELSE '' END AS filename, l_linenumber AS k, l_quantity::BIGINT AS size_bytes FROM lines WHERE l_linenumber <> 7)"""


@query(f"WITH {_FILES_SQL} SELECT page_id, attachment_id, filename, 'image/png' AS mime_type, k::VARCHAR AS source_version, size_bytes FROM files")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.attachments(_windows(spark, sf_dir))


@query(f"""WITH {_FILES_SQL}, d AS (SELECT page_id, filename, min(attachment_id) AS attachment_id, count(*) AS n FROM files WHERE NOT ends_with(filename, '.png') GROUP BY ALL), one AS (SELECT page_id FROM d GROUP BY page_id HAVING max(n) = 1),
r AS (SELECT page_id, 'file' || n || e AS filename FROM one, (SELECT unnest([3, 11, 27, 35]) AS n), (SELECT unnest(['.drawio', '', '.png']) AS e)) SELECT page_id, filename, attachment_id FROM r LEFT JOIN d USING (page_id, filename)""")
def diagram_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to diagrams by name, on pages whose names are clear."""
    files = records.attachments(_windows(spark, sf_dir))
    usable = files.where(records.diagram_name(F.col("filename"))).groupBy("page_id", "filename").count()
    clear = usable.groupBy("page_id").agg(F.max("count").alias("most")).where("most = 1").select("page_id")
    names = F.transform(F.lit([3, 11, 27, 35]), lambda n: F.transform(F.lit([".drawio", "", ".png"]), lambda e: F.concat(F.lit("file"), n, e)))
    asked = clear.select("page_id", F.explode(F.flatten(names)).alias("filename"))
    return records.match_diagrams(asked, files.join(clear, "page_id", "left_semi"))


@query("""WITH u AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer)
SELECT k AS page_key, CASE k % 6 WHEN 0 THEN 'https://wiki.example.org:8443/ctx' WHEN 1 THEN 'https://wiki.example.org' WHEN 2 THEN 'https://wiki.example.org' END AS base_url,
CASE k % 6 WHEN 0 THEN s WHEN 1 THEN NULL WHEN 2 THEN s END AS space_key, CASE WHEN k % 6 < 3 THEN k::VARCHAR END AS page_id FROM u""")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    shapes = [
        F.concat(F.lit("https://Wiki.Example.org:8443/ctx/spaces/"), s, F.lit("/pages/"), k, F.lit("/Some+title")),
        F.concat(F.lit("https://wiki.example.org:443/pages/viewpage.action?pageId="), k),
        F.concat(F.lit("https://wiki.example.org/pages/viewPage.action?spaceKey="), s, F.lit("&pageId="), k),
        F.concat(F.lit("http://wiki.example.org/spaces/"), s, F.lit("/pages/"), k),
        F.concat(F.lit("https://wiki.example.org/pages/viewpage.action?pageId="), k, F.lit("&pageId="), k),
        F.concat(F.lit("https://user@wiki.example.org/spaces/"), s, F.lit("/pages/"), k),
    ]
    url = F.element_at(F.array(*shapes), (k % 6 + 1).cast("int"))
    a = records.page_address(url)
    return table(spark, sf_dir, "customer").select(k.alias("page_key"), a["base_url"].alias("base_url"), a["space_key"].alias("space_key"), a["page_id"].alias("page_id"))


# ---- sources


def _paths() -> Column:
    k = F.col("p_partkey")
    return F.concat(
        F.element_at(F.lit(["src", "Build", "vendor", "lib", "a//b", "x/con", "pods", "gen"]), (k % 8 + 1).cast("int")), F.lit("/f"), k,
        F.element_at(F.lit([".py", ".inl", ".PNG", ".tar.gz", "", ".h", ".woff2", ".svg", ".java", ".txt", ".xsl"]), (k % 11 + 1).cast("int")),
    )


@query("""WITH p AS (SELECT p_partkey AS k, ['src', 'Build', 'vendor', 'lib', 'a//b', 'x/con', 'pods', 'gen'][p_partkey % 8 + 1] AS d, ['.py', '.inl', '.PNG', '.tar.gz', '', '.h', '.woff2', '.svg', '.java', '.txt', '.xsl'][p_partkey % 11 + 1] AS e FROM part)
SELECT k AS file_key, CASE WHEN d IN ('Build', 'gen') THEN 'generated' WHEN d IN ('vendor', 'pods') THEN 'vendor' WHEN e IN ('.PNG', '.tar.gz', '.woff2') OR k % 9 = 0 THEN 'binary' END AS excluded,
CASE e WHEN '.py' THEN 'python' WHEN '.inl' THEN 'cpp' WHEN '.h' THEN 'cpp' WHEN '.svg' THEN 'xml' WHEN '.java' THEN 'java' WHEN '.xsl' THEN 'xml' ELSE 'unknown' END AS language, d NOT IN ('a//b', 'x/con') AS valid, e IN ('.inl', '.java') AS symbols,
CASE WHEN k % 10 = 0 THEN 'invalid_utf8' WHEN k % 9 = 0 OR k % 14 = 0 THEN 'unsupported_control' END AS fault FROM p""")
def file_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    late = F.concat(F.rpad(F.lit("x"), 9000, "y").cast("binary"), F.lit(b"\x00z"))
    content = F.when(k % 10 == 0, F.when(k % 9 == 0, F.lit(b"a\x00\xff")).otherwise(F.lit(b"a\xff"))).when(k % 9 == 0, late).when(k % 14 == 0, F.lit(b"bell\x07")).otherwise(F.lit("text\t é\n".encode()))
    rows = table(spark, sf_dir, "part").select(k.alias("file_key"), _paths().alias("path"), content.alias("content"))
    path, body = F.col("path"), F.col("content")
    return rows.select("file_key", crawl.exclusion(path, body).alias("excluded"), text.language_of(path).alias("language"), crawl.valid_path(path).alias("valid"), crawl.symbol_authority(path).alias("symbols"), crawl.text_fault(body).alias("fault"))


@query("""WITH p AS (SELECT p_size AS n, ['src', 'Build', 'vendor', 'lib', 'a//b', 'x/con', 'pods', 'gen'][p_partkey % 8 + 1] AS d, ['.py', '.inl', '.PNG', '.tar.gz', '', '.h', '.woff2', '.svg', '.java', '.txt', '.xsl'][p_partkey % 11 + 1] AS e FROM part)
SELECT CASE WHEN d IN ('Build', 'gen') THEN 'generated' WHEN d IN ('vendor', 'pods') THEN 'vendor' WHEN e IN ('.PNG', '.tar.gz', '.woff2') THEN 'binary' ELSE 'included' END AS reason, count(*) AS files, sum(n)::BIGINT AS bytes FROM p GROUP BY ALL""")
def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.scan_metrics(table(spark, sf_dir, "part").select(crawl.exclusion(_paths()).alias("excluded"), F.col("p_size").alias("size")))


@query("""SELECT p_partkey AS file_key, 'git:repo:' || p_name AS document_id, 'repo:main:' || p_name || ':' || p_brand || CASE WHEN p_size % 2 = 0 THEN '~' || substr(sha256(p_type), 1, 8) ELSE '' END AS symbol_id,
'v' || strftime(make_timestamp(2026, 1, 1 + p_size % 28, 0, 0, 0), '%Y%m%d-%H%M%S-') || '000000Z' AS version FROM part""")
def file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo, name = F.lit("repo"), F.col("p_name")
    when = F.make_timestamp_ntz(F.lit(2026), F.lit(1), 1 + F.col("p_size") % 28, F.lit(0), F.lit(0), F.lit(0))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("file_key"), ids.file_document_id(repo, name).alias("document_id"),
        ids.symbol_id(repo, F.lit("main"), name, F.col("p_brand"), F.col("p_type"), F.col("p_size") % 2 == 0).alias("symbol_id"), ids.dataset_version(when).alias("version"),
    )


@query("""WITH e AS (SELECT s_suppkey AS k, ['wiki.Example.org', 'wiki.example.org.:443', 'other.example.org:8443'][s_suppkey % 3 + 1] AS h, ['', '/', '/ctx/', '/ctx//', '/ctx?x=1'][s_suppkey % 5 + 1] AS p FROM supplier)
SELECT k AS endpoint_key, CASE WHEN p <> '/ctx?x=1' THEN sha256(concat_ws(chr(31), 'https', CASE k % 3 WHEN 2 THEN 'other.example.org' ELSE 'wiki.example.org' END, CASE k % 3 WHEN 2 THEN '8443' ELSE '443' END, CASE WHEN p IN ('', '/') THEN '/' ELSE '/ctx' END)) END AS endpoint,
sha256('{"excluded_ancestor_page_ids":["' || k % 7 || '"],"excluded_page_ids":[],"include_root_page_ids":["1","' || k || '"]}') AS scope, sha256('[{"page_id":"' || k || '"},{"page_id":"' || (k + 1) || '"}]') AS selection FROM e""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    hosts, ends = F.lit(["wiki.Example.org", "wiki.example.org.:443", "other.example.org:8443"]), F.lit(["", "/", "/ctx/", "/ctx//", "/ctx?x=1"])
    url = F.concat(F.lit("https://"), F.element_at(hosts, (k % 3 + 1).cast("int")), F.element_at(ends, (k % 5 + 1).cast("int")))
    name = lambda *x: F.array(*[c.cast("string") for c in x])
    scope = canonical.scope_identity(name(F.lit(1), k), F.array().cast("array<string>"), name(k % 7))
    return table(spark, sf_dir, "supplier").select(k.alias("endpoint_key"), canonical.endpoint_identity(url).alias("endpoint"), scope.alias("scope"), canonical.selection_identity(F.array(k, k + 1)).alias("selection"))


# ---- versions: orders as documents of two sources, their lines as chunks


def _streams(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {s: rows if s == "documents" else rows.drop("k") for s, rows in _numbered(spark, sf_dir).items()}


def _numbered(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The streams, with the number of each row's order as ``k``."""
    o, l = table(spark, sf_dir, "orders"), _lines(spark, sf_dir)  # noqa: E741
    k, line = F.col("o_orderkey"), F.col("l_linenumber")
    git = F.col("o_orderstatus") == "F"
    doc = lambda x: F.concat(F.lit("confluence:page:"), x)
    document = F.when(git, F.concat(F.lit("git:repo:"), k)).otherwise(doc(k))
    docs = o.select(
        document.alias("document_id"), F.when(git, "git").otherwise("confluence").alias("source_system"), F.when(git, "repo").alias("repo"), F.when(git, "main").alias("branch"), F.when(git, (k % 2).cast("string")).otherwise(F.lit("7")).alias("source_version"),
        F.when(git, F.concat(F.lit("f"), k)).alias("file_path"), F.sha2(k.cast("string"), 256).alias("content_hash"), k.alias("k"),
    )
    chunk = F.concat(F.lit("c"), F.col("l_orderkey"), F.lit("-"), line)
    of = o.select(k.alias("l_orderkey"), git.alias("git"))
    tag = F.when(F.col("l_quantity") > 40, F.array(F.lit("restricted:unresolved"))).otherwise(F.array(F.lit("space:A")))
    lines = stored(l.join(of, "l_orderkey"))  # four streams come from it; what is written are numbers, ids are made of them when read
    owner = F.when(F.col("git"), F.concat(F.lit("git:repo:"), "l_orderkey")).otherwise(doc(F.col("l_orderkey")))
    chunks = lines.select(chunk.alias("chunk_id"), owner.alias("document_id"), tag.alias("acl_tags"), line.alias("chunk_index"), "l_orderkey", F.when(F.col("git"), "git").otherwise("confluence").alias("source_system"), "l_quantity", "l_partkey", F.col("l_orderkey").alias("k"))
    media = chunks.where("chunk_index = 1 AND source_system = 'confluence'").select(F.concat(F.lit("m"), "l_orderkey").alias("media_id"), F.col("document_id").alias("parent_document_id"), F.when(F.col("l_quantity") > 30, "parsed").when(F.col("l_quantity") > 20, "failed").otherwise("not_processed").alias("processing_status"), F.lit("1").alias("source_version"), F.lit(None).cast("string").alias("content_hash"), "k")
    acl = docs.select(F.concat(F.lit("acl:"), "document_id").alias("acl_id"), "document_id", "k")
    symbols = chunks.where("source_system = 'git' AND chunk_index <= 2").select(F.concat(F.lit("s"), "chunk_id").alias("symbol_id"), F.when(F.col("chunk_index") == 1, F.col("chunk_id")).alias("chunk_id"), F.lit("repo").alias("repo"), F.lit("main").alias("branch"), F.lit("0").alias("commit_hash"), F.concat(F.lit("f"), "l_orderkey").alias("file_path"), "k")
    found = F.col("l_partkey") % 2 == 0
    relations_ = chunks.where("chunk_index <= 3").select(
        F.concat(F.lit("r"), "chunk_id").alias("relation_id"), F.when(F.col("chunk_index") == 1, F.col("chunk_id")).otherwise(F.col("document_id")).alias("source_id"),
        F.when(found & (F.col("source_system") == "confluence"), F.col("document_id")).otherwise(F.concat(F.lit("unresolved:"), "l_partkey")).alias("target_id"), F.lit("links_to_page").alias("relation_type"),
        F.when(found, "resolved").otherwise("unresolved_target").alias("resolution_status"), "k",
    )
    return {"documents": docs, "chunks": chunks, "media_assets": media, "acl": acl, "symbols": symbols, "relations": relations_}


_STREAMS_SQL = f"""{_LINES_SQL},
docs AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS git, CASE WHEN git THEN 'git:repo:' ELSE 'confluence:page:' END || o_orderkey AS document_id, CASE WHEN git THEN (o_orderkey % 2)::VARCHAR ELSE '7' END AS source_version FROM orders),
chunks AS (SELECT 'c' || l_orderkey || '-' || l_linenumber AS chunk_id, l_linenumber AS i, l_quantity AS q, l_partkey AS p, docs.* FROM lines JOIN docs ON k = l_orderkey),
media AS (SELECT 'm' || k AS media_id, document_id, CASE WHEN q > 30 THEN 'parsed' WHEN q > 20 THEN 'failed' ELSE 'not_processed' END AS status FROM chunks WHERE i = 1 AND NOT git),
symbols AS (SELECT 's' || chunk_id AS symbol_id, CASE WHEN i = 1 THEN chunk_id END AS of, k, document_id, source_version FROM chunks WHERE git AND i <= 2),
relations AS (SELECT 'r' || chunk_id AS relation_id, CASE WHEN i = 1 THEN chunk_id ELSE document_id END AS source_id, document_id, CASE WHEN p % 2 = 0 AND NOT git THEN document_id ELSE 'unresolved:' || p END AS target_id, p % 2 = 0 AS resolved, git FROM chunks WHERE i <= 3)
"""


@query(f"""WITH {_STREAMS_SQL} SELECT document_id, 'acl' AS entity_type, 'acl:' || document_id AS entity_id FROM docs UNION SELECT document_id, 'media', media_id FROM media
UNION SELECT document_id, 'symbol', symbol_id FROM symbols WHERE of IS NOT NULL OR source_version = '0' UNION SELECT document_id, 'relation', relation_id FROM relations UNION SELECT target_id, 'relation', relation_id FROM relations WHERE resolved AND target_id IN (SELECT document_id FROM docs)""")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.dependents(_streams(spark, sf_dir))


@query(f"""WITH {_STREAMS_SQL} SELECT 'documents' AS metric, count(*) AS n FROM docs UNION ALL SELECT 'confluence_documents', count(*) FILTER (WHERE NOT git) FROM docs UNION ALL SELECT 'git_documents', count(*) FILTER (WHERE git) FROM docs
UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'default_deny_chunks', count(*) FILTER (WHERE q > 40) FROM chunks UNION ALL SELECT 'acl', count(*) FROM docs
UNION ALL SELECT 'media_assets', count(*) FROM media UNION ALL SELECT 'media_processed', count(*) FILTER (WHERE status = 'parsed') FROM media UNION ALL SELECT 'media_failed', count(*) FILTER (WHERE status = 'failed') FROM media
UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'symbols_resolved', count(of) FROM symbols UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'unresolved_relations', count(*) FILTER (WHERE NOT resolved) FROM relations""")
def version_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.version_metrics(_streams(spark, sf_dir))


@query(f"""WITH {_STREAMS_SQL} SELECT document_id AS entity_id, CASE WHEN git THEN 'file' ELSE 'page' END AS entity_type, source_version AS last_seen_version, sha256(k::VARCHAR) AS last_content_hash FROM docs
UNION ALL SELECT media_id, 'attachment', '1', NULL FROM media UNION ALL SELECT 'repo', 'repo', max(source_version), NULL FROM docs WHERE git HAVING count(*) > 0""")
def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _streams(spark, sf_dir)
    return records.sync_state(s["documents"], s["media_assets"], "source", DAY).select("entity_id", "entity_type", "last_seen_version", "last_content_hash")


@query(f"""WITH {_STREAMS_SQL}, e AS (SELECT document_id AS id, k, CASE WHEN git THEN 'file' ELSE 'page' END AS t FROM docs UNION ALL SELECT media_id, k, 'attachment' FROM media JOIN docs USING (document_id) UNION ALL SELECT 'repo', 1, 'repo')
SELECT 'sync_missing' AS "check", id FROM e WHERE k % 10 = 0 UNION ALL SELECT 'sync_wrong', id FROM e WHERE k % 10 <> 0 AND k % 7 = 0
UNION ALL SELECT 'sync_twice', id FROM e WHERE k % 10 <> 0 AND k % 9 = 0 UNION ALL SELECT 'sync_wrong', id FROM e WHERE k % 10 <> 0 AND k % 7 = 0 AND k % 9 = 0 UNION ALL SELECT 'sync_unexpected', 'gone'""")
def sync_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync rows of which some are left out, of another state, or there twice, and one stands for nothing."""
    s = _streams(spark, sf_dir)
    rows = records.sync_state(s["documents"], s["media_assets"], "source", DAY)
    k = F.coalesce(F.regexp_extract("entity_id", r"([0-9]+)$", 1).try_cast("bigint"), F.lit(1))
    bad = rows.withColumn("k", k).where("k % 10 <> 0").withColumn("status", F.when(F.col("k") % 7 == 0, "gone").otherwise(F.col("status")))
    both = bad.unionByName(bad.where("k % 9 = 0")).drop("k")
    extra = both.sparkSession.createDataFrame([("gone",)], "entity_id string")
    return integrity.sync_violations(s["documents"], s["media_assets"], both.unionByName(extra, allowMissingColumns=True))


@query("""WITH t AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_custkey % 5 = 0)
SELECT 'tombstone_target' AS "check", CASE WHEN k % 2 = 0 THEN 'document' ELSE 'media' END || ':' || k AS id FROM t WHERE (k % 2 = 0 AND k NOT IN (SELECT o_custkey FROM orders)) OR (k % 2 = 1 AND k NOT IN (SELECT s_suppkey FROM supplier))
UNION ALL SELECT 'tombstone_id_unique', n::VARCHAR FROM t GROUP BY n HAVING count(*) > 1""")
def tombstone_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tombs = table(spark, sf_dir, "customer").where(k % 5 == 0).select(F.when(k % 2 == 0, "document").otherwise("media").alias("entity_type"), k.alias("entity_id"), F.col("c_nationkey").alias("tombstone_id"))
    return integrity.tombstone_violations(tombs, {"document": table(spark, sf_dir, "orders").select("o_custkey"), "media": table(spark, sf_dir, "supplier").select("s_suppkey")})


@query(f"""WITH {_STREAMS_SQL} SELECT 'resolved_target_missing' AS "check", relation_id AS id FROM relations WHERE resolved AND git
UNION ALL SELECT 'page_relation_of_pages', relation_id FROM relations WHERE resolved AND (git OR starts_with(source_id, 'c') AND NOT starts_with(source_id, 'confluence'))
UNION ALL SELECT 'owner_lists_relation', relation_id FROM relations WHERE relation_id LIKE '%-2'""")
def relation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _streams(spark, sf_dir)
    named = s["relations"].groupBy("source_id").agg(F.collect_list("relation_id").alias("relation_ids")).withColumn("relation_ids", F.filter("relation_ids", lambda x: ~x.endswith("-2")))
    with_ids = lambda rows, key: rows.join(named.withColumnRenamed("source_id", key), key, "left").withColumn("relation_ids", F.coalesce("relation_ids", F.array().cast("array<string>")))
    return integrity.relation_violations(with_ids(s["documents"], "document_id"), with_ids(s["chunks"], "chunk_id"), s["media_assets"], s["relations"])


@query(f"""WITH {_LINES_SQL}, l AS (SELECT l_orderkey AS d, l_linenumber AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN l_quantity > 45 THEN 'code' ELSE 'prose' END AS kind FROM lines),
b AS (SELECT *, lag(kind) OVER w AS bk, lag(i) OVER w AS bi, lead(kind) OVER w AS nk, lead(i) OVER w AS ni FROM l WINDOW w AS (PARTITION BY d ORDER BY i))
SELECT 'part_order' AS "check", 'c' || d || '-' || i AS id FROM b WHERE d % 3 <> 0 AND NOT coalesce(i <= n AND (i = 1 OR (bi = i - 1 AND bk = kind)) AND (i = n OR (ni = i + 1 AND nk = kind)), FALSE)""")
def part_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the parts of one block; a line of another kind breaks it."""
    l = _lines(spark, sf_dir)  # noqa: E741
    n = l.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    cut = F.col("l_orderkey") % 3 != 0
    chunks = l.join(n, "l_orderkey").select(
        F.col("l_orderkey").alias("document_id"), F.concat(F.lit("c"), "l_orderkey", F.lit("-"), "l_linenumber").alias("chunk_id"), F.col("l_linenumber").alias("chunk_index"),
        F.when(cut, F.col("l_linenumber") - 1).alias("part_index"), F.when(cut, F.col("n")).alias("part_total"), F.when(F.col("l_quantity") > 45, "code").otherwise("prose").alias("content_kind"),
    )
    return integrity.part_violations(chunks)


@query(f"""WITH {_LINES_SQL}, o AS (SELECT o_custkey AS c, o_orderkey AS v, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT 'grows' AS "check", c || ':' || v AS id FROM o WHERE b >= v UNION ALL SELECT 'no_gap', l_orderkey::VARCHAR FROM lines WHERE l_quantity > 3 GROUP BY l_orderkey HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(*))""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    grows = integrity.order_violations(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "grows")
    return grows.unionByName(integrity.gap_violations(_lines(spark, sf_dir).where("l_quantity > 3"), ["l_orderkey"], "l_linenumber", "no_gap"))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.col("o_totalprice").cast("string").alias("content_hash"))
    k = F.col("chunk_id")
    return o.where(k % 5 != 0), o.where(k % 7 != 0).withColumn("content_hash", F.when(k % 11 == 0, F.concat("content_hash", F.lit("!"))).otherwise(F.col("content_hash")))


@query("SELECT o_orderkey AS chunk_id, o_custkey AS document_id FROM orders WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0)")
def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.stale_parts(*_changes(spark, sf_dir)).select("chunk_id", "document_id")


@query("SELECT o_orderkey AS chunk_id, o_custkey AS document_id FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 OR o_custkey % 4 = 0)")
def sparse_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _changes(spark, sf_dir)
    hurt = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("document_id"))
    return delta.sparse_rows(old, new, "chunk_id", hurt).select("chunk_id", "document_id")


@query("SELECT o_orderkey AS chunk_id, o_custkey AS document_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0")
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.missing(*_changes(spark, sf_dir), "chunk_id").select("chunk_id", "document_id")


_CASCADE_SQL = f"""{_STREAMS_SQL}, hit AS (SELECT document_id, CASE WHEN k % 2 = 0 THEN 'source_deleted' ELSE 'access_revoked' END AS reason FROM docs WHERE k % 25 = 0),
deps AS (SELECT document_id, 'acl' AS t, 'acl:' || document_id AS e FROM docs UNION SELECT document_id, 'media', media_id FROM media UNION SELECT document_id, 'symbol', symbol_id FROM symbols WHERE of IS NOT NULL OR source_version = '0' UNION SELECT document_id, 'relation', relation_id FROM relations),
tombs AS (SELECT DISTINCT 'document' AS entity_type, document_id AS entity_id, reason FROM hit UNION SELECT t, e, reason FROM deps JOIN hit USING (document_id))"""


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _streams(spark, sf_dir)
    hit = s["documents"].where("k % 25 = 0").select("document_id", F.when(F.col("k") % 2 == 0, "source_deleted").otherwise("access_revoked").alias("reason"), F.lit(None).cast("string").alias("detail"))
    return delta.tombstones(delta.cascade(hit, delta.dependents(s)), VERSION, DAY)


@query(f"""WITH {_CASCADE_SQL} SELECT row_number() OVER (ORDER BY list_position(['document', 'chunk', 'relation', 'acl', 'media', 'symbol'], entity_type), entity_id, substr(sha256(concat_ws(chr(31), entity_type, entity_id, reason, '{VERSION}')), 1, 16))::INT AS place,
entity_type, entity_id, reason FROM tombs ORDER BY place LIMIT 200""")
def cascade_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the stream of tombstones, in its order."""
    head = delta.in_order(_cascade(spark, sf_dir)).limit(200)
    return retrieval.ranked(head.withColumn("score", -delta.entity_rank(F.col("entity_type"))).withColumn("all", F.lit(1)), ["all"], "entity_id").select(F.col("rank").alias("place"), "entity_type", "entity_id", "reason")


@query(f"WITH {_CASCADE_SQL} SELECT " + ", ".join(f"count(*) FILTER (WHERE entity_type = '{t}') AS {t}" for t in delta.ENTITY_ORDER) + " FROM tombs")
def tombstone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.tombstone_counts(_cascade(spark, sf_dir))


# ---- media, evaluation, retrieval, stores


@query("""WITH p AS (SELECT p_partkey AS k, ['a.drawio', 'b.PDF', 'c.jpeg', 'd.bin', 'e'][p_partkey % 5 + 1] AS f, ['application/pdf', 'image/svg+xml', NULL, 'application/vnd.jgraph.drawio'][p_partkey % 4 + 1] AS m FROM part)
SELECT k AS media_id, CASE WHEN contains(coalesce(m, ''), 'drawio') OR f = 'a.drawio' THEN 'drawio' WHEN m = 'application/pdf' OR f = 'b.PDF' THEN 'pdf' WHEN starts_with(coalesce(m, ''), 'image/') OR f = 'c.jpeg' THEN 'image' ELSE 'unsupported' END AS route,
CASE k % 3 WHEN 0 THEN 'skipped' ELSE 'not_attempted' END AS download_status, CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'unknown' END AS relevance FROM p""")
def media_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(
        k.alias("media_id"), k.alias("document_id"), F.element_at(F.lit(["a.drawio", "b.PDF", "c.jpeg", "d.bin", "e"]), (k % 5 + 1).cast("int")).alias("filename"),
        F.element_at(F.array(F.lit("application/pdf"), F.lit("image/svg+xml"), F.lit(None), F.lit("application/vnd.jgraph.drawio")), (k % 4 + 1).cast("int")).alias("mime_type"), F.col("p_size").alias("size_bytes"),
    )
    policy = F.when(F.col("media_id") % 3 == 0, "skip").when(F.col("media_id") % 3 == 1, "download_and_process").otherwise("download")
    return relations.media_assets(files, policy, DAY).select("media_id", "route", "download_status", "relevance")


@query("""WITH f AS (SELECT l_orderkey AS d, 'f' || l_partkey % 20 AS n, 'm' || l_orderkey || '-' || l_linenumber AS m FROM lineitem), u AS (SELECT d, n, min(m) AS m FROM f GROUP BY ALL HAVING count(*) = 1),
i AS (SELECT o_orderkey AS d, 'f' || unnest(range(0, 20)) AS n FROM orders WHERE o_orderkey % 8 = 0) SELECT d AS document_id, n AS filename, m AS media_id, CASE WHEN m IS NULL THEN 'unresolved_target' ELSE 'resolved' END AS resolution_status FROM i LEFT JOIN u USING (d, n)""")
def embedded_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("f"), F.col("l_partkey") % 20).alias("filename"), F.concat(F.lit("m"), "l_orderkey", F.lit("-"), "l_linenumber").alias("media_id"))
    intents = table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0").select(F.col("o_orderkey").alias("document_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("document_id", F.concat(F.lit("f"), "i").alias("filename"))
    return relations.attach(intents, files)


@query(f"""WITH {_STREAMS_SQL}, o AS (SELECT DISTINCT source_id FROM relations) SELECT count(*) AS relations_total, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE NOT resolved) AS unresolved_target,
(SELECT count(*) FROM docs WHERE document_id IN (SELECT source_id FROM o)) AS documents_enriched, (SELECT count(*) FROM chunks WHERE document_id IN (SELECT source_id FROM o)) AS chunks_enriched FROM relations""")
def relation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _streams(spark, sf_dir)
    return records.page_metrics(s["relations"], s["documents"], s["chunks"])


@query(f"""WITH {_STREAMS_SQL}, e AS (SELECT document_id, count(i) AS n, string_agg('{{"chunk_id":"' || chunk_id || '","content_hash":"' || p || '","content_kind":"' || CASE WHEN q > 25 THEN 'prose' ELSE 'code' END || '","part_index":null,"part_total":null,"token_count":' || q::INT || '}}', ',' ORDER BY i) AS es,
 count(*) FILTER (WHERE q <= 25) AS code, count(*) FILTER (WHERE q > 25) AS prose FROM chunks GROUP BY document_id)
SELECT document_id, coalesce(n, 0)::INT AS chunk_count, sha256('{{"chunk_count":' || coalesce(n, 0) || ',"chunker_version":"v1","content_kind_counts":{{' || concat_ws(',', CASE WHEN code > 0 THEN '"code":' || code END, CASE WHEN prose > 0 THEN '"prose":' || prose END) ||
'}},"document_content_hash":"' || sha256(k::VARCHAR) || '","document_id":"' || document_id || '","entries":[' || coalesce(es, '') || '],"format_version":"1","profile_identity":"medium"}}') AS digest FROM docs LEFT JOIN e USING (document_id)""")
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _streams(spark, sf_dir)
    none = F.lit(None).cast("int")
    chunks = s["chunks"].select("document_id", "chunk_id", "chunk_index", F.col("l_partkey").cast("string").alias("content_hash"), F.when(F.col("l_quantity") > 25, "prose").otherwise("code").alias("content_kind"), none.alias("part_index"), none.alias("part_total"), F.col("l_quantity").cast("int").alias("token_count"))
    return records.chunk_summaries(chunks, s["documents"], "medium", "v1").drop("kinds")


@query("""WITH b AS (SELECT o_custkey AS b, bool_and(o_orderstatus <> 'F') AS ok, count(*) AS n, sum(o_orderkey)::BIGINT AS y, count(*) FILTER (WHERE o_orderstatus = 'P') AS r FROM orders GROUP BY ALL),
t AS (SELECT count(*) FILTER (WHERE ok) AS committed, count(*) FILTER (WHERE NOT ok) AS failed, sum(n)::BIGINT AS requests, sum(n)::BIGINT AS pages, sum(y)::BIGINT AS bytes, sum(r)::BIGINT AS retries, 1 AS queue_high_watermark FROM b)
SELECT *, sha256(concat_ws(':', committed, failed, requests, pages, bytes, retries, queue_high_watermark)) AS digest FROM t""")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(F.bool_and(F.col("o_orderstatus") != "F"), "committed").otherwise("failed").alias("state"), F.count("*").alias("requests"), F.count("*").alias("pages"), F.sum("o_orderkey").alias("bytes"), F.count_if(F.col("o_orderstatus") == "P").alias("retries"))
    return records.batch_totals(b)


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 0 THEN 'CONFLICT' WHEN p_partkey % 3 <> 0 THEN 'PUBLISHED' WHEN p_partkey % 2 = 0 THEN 'REPLAYED' ELSE 'CONFLICT' END AS status FROM part""")
def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New bodies against a store that holds some of them; some come twice, with other bytes."""
    k = F.col("p_partkey")
    new = table(spark, sf_dir, "part").select(F.lit("r").alias("run_id"), k.alias("page_id"), F.encode("p_name", "UTF-8").alias("body"))
    stored = new.where("page_id % 3 = 0").withColumn("body", F.when(F.col("page_id") % 2 == 0, F.col("body")).otherwise(F.lit(b"other")))
    twice = new.where("page_id % 5 = 0").withColumn("body", F.lit(b"twice"))
    return records.publish_raw(stored, new.unionByName(twice).unionByName(new)).select("page_id", "status")


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 0 THEN 'MISSING' WHEN p_partkey % 5 = 0 THEN 'INVALID' WHEN p_partkey % 7 = 0 THEN 'IDENTITY_CONFLICT' ELSE 'REPLAYABLE' END AS status FROM part""")
def store_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    rows = table(spark, sf_dir, "part").select(F.lit("r").alias("run_id"), F.col("p_partkey").alias("page_id"), F.encode("p_name", "UTF-8").alias("body"))
    expected = rows.select("run_id", "page_id", F.sha2("body", 256).alias("sha256"))
    other = rows.withColumn("body", F.when((k % 7 == 0) & (k % 5 != 0), F.lit(b"other")).otherwise(F.col("body")))
    stored = other.withColumn("sha256", F.sha2(F.when(k % 5 == 0, F.lit(b"was")).otherwise(F.col("body")), 256)).where("page_id % 4 <> 0")
    return crawl.inspect_store(expected, stored).select("page_id", "status")


@query("""WITH r AS (SELECT n_nationkey AS run_id, n_name AS label, '2026-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS created_at, n_nationkey / 25.0 AS a, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey / 25.0 END AS b FROM nation)
SELECT run_id, label, round(a, 6) AS l1_hit10, round(b, 6) AS l2_hit10, round(a - b, 6) AS gap10, round(a - lag(a) OVER (ORDER BY created_at), 6) AS hit10_change, CASE WHEN b - a >= 0.02 THEN 'B' WHEN a - b >= 0.02 THEN 'A' ELSE 'tie' END AS decision FROM r""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as evaluation runs, with two layers of metrics, the gap between them, and the change from run to run."""
    layer = lambda x: F.when(x.isNotNull(), F.struct(x.cast("double").alias("hit_at_10"), x.cast("double").alias("mrr"), F.lit(10).alias("n_cases")))
    a, b = F.col("n_nationkey") / 25, F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey") / 25)
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_id"), F.col("n_name").alias("label"), F.concat(F.lit("2026-01-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")).alias("created_at"), layer(a).alias("layer1"), layer(b).alias("layer2"))
    told = evaluation.report(runs)
    board = evaluation.leaderboard(told.select("run_id", "label", "created_at", F.col("l1_hit10").alias("hit5"), F.col("l1_hit10").alias("hit10"), F.col("l1_mrr").alias("mrr")))
    joined = told.join(board.select("run_id", "hit10_change"), "run_id")
    return joined.select("run_id", "label", *[F.round(c, 6).alias(c) for c in ("l1_hit10", "l2_hit10", "gap10", "hit10_change")], evaluation.decision(F.col("l1_hit10"), F.col("l2_hit10")).alias("decision"))


@query("""WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), h AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings e, q QUALIFY rank <= 50),
s AS (SELECT doc_id, rank, lang, text, 1.0::DOUBLE / (1 + length(text) / 2000.0::DOUBLE) AS score FROM h JOIN documents USING (doc_id) WHERE lang IN ('en', 'de')),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, rank, doc_id)::INT AS place FROM s QUALIFY place <= 10)
SELECT doc_id, place AS rank, round(score, 6) AS score, '[' || place || '] ' || lang || printf(' (score: %.4f)', score) || chr(10) || substr(text, 1, 20) AS shown FROM t WHERE score >= 0.3""")
def retrieve_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole request: a pool of candidates, content, access by language, a reranker (short texts first), the cut, the threshold."""
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.orderBy("vec_id").first()
    k = 10
    near = retrieval.dense_top_k(vectors, first.embedding if first else [], retrieval.candidates(k, True)).withColumn("all", F.lit(1)).withColumnRenamed("vec_id", "doc_id")
    hits = retrieval.ranked(near, ["all"], "doc_id").drop("all")
    content = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", "text", F.array(F.concat(F.lit("group:"), "lang")).alias("acl_tags"))
    out = retrieval.retrieve("a question", hits, content, "doc_id", k, 0.3, ["group:EN", "group:de"], 1 / (1 + F.char_length("text") / 2000))
    shown = retrieval.format_hit(F.col("rank"), F.col("score"), F.col("lang"), F.substring("text", 1, 20))
    return out.select("doc_id", "rank", F.round("score", 6).alias("score"), shown.alias("shown"))


@query("SELECT (conv_id || '-' || turn) AS chunk_id, conv_id::VARCHAR AS document_id, 'chat' AS source_type, role AS source_id, turn AS chunk_index, '2026-01-01T00:00:00' AS indexed_at FROM conversations")
def vector_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.concat("conv_id", F.lit("-"), "turn").alias("chunk_id"), F.col("conv_id").alias("document_id"), F.lit("chat").alias("source_type"), F.col("role").alias("source_id"), F.col("turn").alias("chunk_index"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("indexed_at"))
    return records.slim_payload(rows)


@query("SELECT turn, role, sha256(text) AS content_hash FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.withColumnsRenamed({"conv_id": "document_id", "turn": "chunk_index"})
    return records.chunks_of(rows, c.agg(F.min("conv_id")).first()[0]).select(F.col("chunk_index").alias("turn"), "role", ids.content_hash(F.col("text")).alias("content_hash"))


@query("""WITH p AS (SELECT s_suppkey AS page_id, 'S' || s_nationkey % 3 AS space_key, ['r' || n_regionkey, 'n' || n_nationkey] AS a FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT row_number() OVER (ORDER BY space_key, a, page_id)::INT AS place, page_id FROM p ORDER BY place LIMIT 100""")
def inventory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of an inventory in its order."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    pages = rows.select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("S"), F.col("s_nationkey") % 3).alias("space_key"), F.array(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")).alias("ancestor_ids"))
    head = records.inventory_order(pages).limit(100).select(F.collect_list("page_id").alias("ids"))  # a hundred ids in order
    return head.select(F.posexplode("ids").alias("p", "page_id")).select((F.col("p") + 1).alias("place"), "page_id")


@query("""SELECT s_suppkey AS entity_id, s_name AS name, 'wiki' AS source FROM supplier UNION ALL SELECT -1 - c_custkey, c_name, 'git' FROM customer""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    wiki = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.lit("wiki").alias("source"))
    git = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("entity_id"), F.col("c_name").alias("name"), F.lit("git").alias("source"))
    return records.union_sources([wiki, git], "entity_id")


@query("""WITH h AS (SELECT sha256('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}') AS h FROM orders)
SELECT count(*) AS rows, sha256('k,s:' || count(*) || ':' || coalesce(sum(('0x' || substr(h, 1, 15))::HUGEINT), 0) || ':' || coalesce(sum(('0x' || substr(h, 16, 15))::HUGEINT), 0) || ':' || coalesce(sum(('0x' || substr(h, 31, 15))::HUGEINT), 0) || ':' || coalesce(sum(('0x' || substr(h, 46, 15))::HUGEINT), 0)) AS digest FROM h""")
def stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.rows_digest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))


@query("SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 0) USING (doc_id)")
def delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 0"), ["doc_id"])


# ---- source files: parts as files of repositories, their lines from their fields

_CODE_SQL = """
f AS (SELECT p_partkey AS k, p_brand AS repo, 'src/f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '' END AS path, p_size AS n, p_type AS t FROM part),
g AS (SELECT *, [t || ' ' || i FOR i IN range(0, n)] AS l FROM f),
d AS (SELECT *, array_to_string(l, chr(10)) AS text FROM g)
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ending = F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".java").otherwise("")
    lines = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.concat_ws(" ", "p_type", i.cast("string")))
    parts = cut(spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey"))  # a filter on the texts would be moved before a mere shuffle
    return parts.select(k.alias("k"), F.col("p_brand").alias("repo"), F.concat(F.lit("src/f"), k, ending).alias("path"), F.array_join(lines, "\n").alias("text"))


@query(f"""WITH {_CODE_SQL} SELECT 'git:' || repo || ':' || path AS document_id, sha256(text) AS content_hash, CASE k % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'unknown' END AS language, 'repo:' || repo AS tag, 'abc' AS source_version FROM d""")
def git_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.git_documents(_files(spark, sf_dir), "main", "abc").select("document_id", "content_hash", "language", F.col("acl_tags")[0].alias("tag"), "source_version")


@query(f"""WITH RECURSIVE {_CODE_SQL},
c AS (SELECT *, len(regexp_extract_all(path, '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]')) AS head, [len(regexp_extract_all(x, '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]')) FOR x IN l] AS s FROM d WHERE n > 0),
w AS (SELECT k, 0 AS i, 0 AS a, least(40, n, greatest(1, (450 - head) // s[1])) AS e FROM c
 UNION ALL SELECT w.k, i + 1, e - least(4, e), least(n, e - least(4, e) + least(40, (450 - head) // s[1])) FROM w JOIN c USING (k) WHERE e < n)
SELECT 'git:' || repo || ':' || path AS document_id, i AS part_index, (count(*) OVER (PARTITION BY k))::INT AS part_total, (a + 1)::INT AS line_start, e::INT AS line_end, (head + (e - a) * s[1])::INT AS token_count,
'chunk:git:' || substr(sha256(concat_ws(chr(31), 'git', 'git:' || repo || ':' || path, path || '#w' || i, path || chr(10) || chr(10) || array_to_string(l[a + 1 : e], chr(10)))), 1, 16) AS chunk_id FROM w JOIN c USING (k)""")
def git_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a file have as many tokens, so SQL can tell where windows end."""
    return code.git_chunks(code.git_documents(_files(spark, sf_dir), "main", "abc")).select("document_id", "part_index", "part_total", "line_start", "line_end", "token_count", "chunk_id")


@query(f"""WITH {_CODE_SQL}, s AS (SELECT k, repo, path, n, x FROM d, (SELECT unnest([1, 30, 37, 45]) AS x) WHERE k % 4 = 0)
SELECT k || '@' || x AS symbol_id, CASE WHEN x <= n THEN CASE WHEN x <= 40 THEN 0 ELSE 1 END END AS part FROM s""")
def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols at some lines of files, and the number of the window that holds each first."""
    files = _files(spark, sf_dir)
    chunks = cut(code.git_chunks(code.git_documents(files, "main", "abc")).select("repo", "file_path", "chunk_id", "part_index", "line_start", "line_end"))  # used twice
    symbols = files.where("k % 4 = 0").select("repo", F.col("path").alias("file_path"), "k", F.explode(F.lit([1, 30, 37, 45])).alias("line_start")).select("repo", "file_path", F.concat_ws("@", "k", "line_start").alias("symbol_id"), "line_start")
    tied = code.tie_symbols(symbols, chunks)
    return tied.join(chunks.select("chunk_id", F.col("part_index").alias("part")), "chunk_id", "left").select("symbol_id", "part")


@query("""WITH o AS (SELECT o_custkey AS d, o_orderkey AS k FROM orders), a AS (SELECT d, list(DISTINCT k ORDER BY k) AS ks FROM o WHERE k % 5 <> 0 GROUP BY d), b AS (SELECT d, list(DISTINCT k ORDER BY k) AS ks FROM o WHERE k % 7 <> 0 OR k % 35 = 0 GROUP BY d),
c AS (SELECT c_custkey AS d, a.ks AS x, b.ks AS y FROM customer LEFT JOIN a ON a.d = c_custkey LEFT JOIN b ON b.d = c_custkey)
SELECT d AS document_id, CASE WHEN x IS NOT DISTINCT FROM y THEN 'unchanged' ELSE 'changed' END AS outcome FROM c""")
def dependent_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose own content stays, compared by what hangs on them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.lit("chunk").alias("entity_type"), F.col("o_orderkey").alias("entity_id"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    old, new = (docs.join(delta.dependents_hash(o.where(part)), "document_id", "left") for part in ("entity_id % 5 <> 0", "entity_id % 7 <> 0 OR entity_id % 35 = 0"))
    return delta.classify(old, new, hashes=("dependents_hash",))


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT k AS crawl_key, sha256('{"endpoint":"e' || k || '","profile":"' || sha256('{"pages":' || k || ',"pause":3.0}') || '","scope":"s"}') AS fingerprint FROM n""")
def crawl_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    made = canonical.crawl_fingerprint(F.concat(F.lit("e"), k), F.lit("s"), {"pages": k, "pause": F.lit(3.0)})
    return table(spark, sf_dir, "nation").select(k.alias("crawl_key"), made.alias("fingerprint"))


@query("""SELECT n_nationkey AS media_id, 'chunk:confluence:' || substr(sha256(concat_ws(chr(31), 'confluence', n_regionkey::VARCHAR, 'drawio:' || n_nationkey, n_name || chr(10) || chr(10) || '```mermaid' || chr(10) || 'flowchart TD' || chr(10) || '    b' || n_nationkey || '["' || n_name || '"]' || chr(10) || '```')), 1, 16) AS chunk_id FROM nation""")
def diagram_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagram with one box for each nation, read, drawn and cut."""
    n = table(spark, sf_dir, "nation")
    body = F.concat(F.lit('<mxGraphModel><root><mxCell id="0"/><mxCell id="b'), "n_nationkey", F.lit('" vertex="1" parent="0" value="'), "n_name", F.lit('"/></root></mxGraphModel>')).cast("binary")
    drawn = diagrams.read_diagrams(n.select(F.col("n_nationkey").alias("media_id"), body.alias("body")))
    named = drawn.join(n.select(F.col("n_nationkey").alias("media_id"), F.col("n_regionkey").alias("document_id"), F.col("n_name").alias("title")), "media_id")
    return code.diagram_chunks(named).select("media_id", "chunk_id")
