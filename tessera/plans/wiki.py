"""Queries of the wiki operators: pages in storage format, their references, sections and chunks. Documents stand for pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uuid import uuid4

from tessera.functions import ids, storage, text
from tessera.functions.checkpoints import ensure_checkpoint_dir, spread
from tessera.operators import inverted, relations, retrieval, vector_store
from tessera.operators import page_set as pages_ops
from tessera.operators.chunking import Budget
from tessera.plans.registry import DAY, query, table
from tessera.sources import cells, windows
from tessera.streaming import capture

_SPACE = r"[\t\x0B\x0C\x0D\x1C-\x1F\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BLANK = _SPACE[:-1] + r"\n]"
#: Rows of the table that is one too long.
LONG = 257


def _escaped(body: Column) -> Column:
    return F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _macro(name: str, *content: Column | str) -> Column:
    parts = [F.lit(c) if isinstance(c, str) else c for c in content]
    return F.concat(F.lit(f'<ac:structured-macro ac:name="{name}">'), *parts, F.lit("</ac:structured-macro>"))


def storage_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page: its text in a paragraph, and one of four further blocks; some break a rule."""
    d, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    cut = F.replace(body, F.lit("]]>"), F.lit("]] >"))
    joined = F.when(d % 3 == 0, '<td rowspan="2">').otherwise("<td>")
    block = (
        F.when(d % 4 == 0, _macro("info", "<ac:rich-text-body><p>in <b>", F.col("lang"), "</b></p></ac:rich-text-body>"))
        .when(d % 4 == 1, _macro("code", '<ac:parameter ac:name="language">text</ac:parameter><ac:plain-text-body><![CDATA[', cut, "]]></ac:plain-text-body>"))
        .when(d % 4 == 2, F.concat(F.lit("<table><tbody><tr><th>lang</th><th>n</th></tr><tr>"), joined, F.col("lang"), F.lit("</td><td>a|b"), F.col("n_chars"), F.lit("</td></tr>"), F.when(d % 3 == 0, "<tr><td>x<br/>y</td></tr>").otherwise(""), F.lit("</tbody></table>")))
        .otherwise(F.concat(F.lit("<ul><li>"), F.col("lang"), F.lit("<ol><li>"), F.col("n_chars"), F.lit('</li></ol></li><li><ac:image><ri:attachment ri:filename="f'), d % 5, F.lit('.png"/></ac:image></li></ul>')))
    )
    include = F.when(d % 5 == 0, _macro("include", '<ri:page ri:content-title="Title ', (d % 60).cast("string"), '"/>')).otherwise("")
    fault = F.when(d % 11 == 3, "<!DOCTYPE page>").when(d % 11 == 4, "&nope;").when(d % 11 == 5, "<p>").when(d % 11 == 6, f"<table>{'<tr><td>1</td></tr>' * LONG}</table>").otherwise("")
    page = F.concat(
        F.lit("<h2>"), F.col("source"), F.lit("</h2><p>"), _escaped(body), F.lit("</p>"), block, include, F.lit('<p><a href="/pages/'), d + 1, F.lit('/x">next &rarr;</a></p>'), F.when(d % 7 == 1, _macro("widget")).otherwise(""), fault,
    )
    return table(spark, sf_dir, "documents").select("doc_id", page.alias("storage"))


_PAGES_SQL = rf"""
s AS (SELECT doc_id AS d, lang, n_chars AS n, source, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents),
m AS (SELECT *, replace(t, ']]>', ']] >') AS c FROM s),
b AS (SELECT *, repeat('`', greatest(3, coalesce(list_max([length(x) for x in regexp_extract_all(c, '`+')]), 0) + 1)::INT) AS fence, 'confluence:page:' || (d + 1) AS next FROM m),
w AS (SELECT *, '## ' || source || chr(10) || chr(10) || regexp_replace(regexp_replace(replace(t, '\', '\\'), '([*_])', '\\\1', 'g'), '\A{_BLANK}+|{_BLANK}+\z', '', 'g') || chr(10) || chr(10) ||
 CASE d % 4 WHEN 0 THEN '> **Info:**' || chr(10) || '> in **' || lang || '**' WHEN 1 THEN fence || 'text' || chr(10) || c || chr(10) || fence
  WHEN 2 THEN '| lang | n |' || chr(10) || '| --- | --- |' || chr(10) || CASE WHEN d % 3 = 0 THEN '| ' || lang || ' [rowspan:2] | a\|b' || n || ' |' || chr(10) || '|  | x<br>y |' ELSE '| ' || lang || ' | a\|b' || n || ' |' END
  ELSE '- ' || lang || chr(10) || '  1. ' || n || chr(10) || '- [media: f' || (d % 5) || '.png]' END || chr(10) || chr(10) ||
 CASE WHEN d % 5 = 0 THEN '[included from page: Title ' || (d % 60) || ']' ELSE '' END || chr(10) || chr(10) || '[next →](/pages/' || (d + 1) || '/x)' || CASE WHEN d % 7 = 1 THEN chr(10) || chr(10) || '[macro:widget omitted]' ELSE '' END AS md,
 CASE WHEN d % 11 = 3 THEN 'storage XHTML contains a forbidden declaration' WHEN d % 11 = 4 THEN 'storage XHTML contains an unknown entity'
  WHEN d % 11 = 5 OR regexp_matches(raw, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'storage XHTML is malformed' WHEN d % 11 = 6 THEN 'table exceeds safety limit' END AS fault FROM b),
p AS (SELECT d, n, fault, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(md), '{_SPACE}+(\n|\z)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A\n+|\n+\z', '', 'g') AS md,
 CASE WHEN d % 4 = 3 THEN [{{'k': 'image_attachment', 'e': 'f' || (d % 5) || '.png'}}] ELSE [] END || CASE WHEN d % 5 = 0 THEN [{{'k': 'include_page', 'e': 'Title ' || (d % 60)}}] ELSE [] END || [{{'k': 'page_link', 'e': next}}] AS refs FROM w)
"""


@query(f"""WITH {_PAGES_SQL} SELECT d AS doc_id, CASE WHEN fault IS NULL THEN sha256(md) END AS content_hash, fault, CASE WHEN fault IS NULL THEN array_to_string([x.k || '=' || x.e for x in refs], ',') END AS refs,
CASE WHEN fault IS NULL THEN (d % 12 = 6)::BIGINT END AS complex_tables, CASE WHEN fault IS NULL THEN concat_ws(',', CASE WHEN d % 12 = 6 THEN 'complex_table_grid' END, CASE WHEN d % 7 = 1 THEN 'unhandled_macro' END) END AS warnings FROM p""")
def storage_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in storage format as Markdown, what they refer to, and what is wrong with them."""
    pages = storage.storage_pages(storage_bodies(spark, sf_dir))
    refs = F.array_join(F.transform("references", lambda r: F.concat(r.kind, F.lit("="), r.identity)), ",")
    told = F.array_join(F.transform("warnings", lambda w: w.code), ",")
    return pages.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"), "fault", refs.alias("refs"), F.col("counters")["complex_tables"].alias("complex_tables"), told.alias("warnings"))


@query(f"""WITH {_PAGES_SQL}, r AS (SELECT 'confluence:page:' || d AS source_id, d, unnest(refs) AS r FROM p WHERE fault IS NULL),
k AS (SELECT source_id, d, r.e AS evidence, CASE r.k WHEN 'image_attachment' THEN 'embeds_media' WHEN 'include_page' THEN 'includes_page' ELSE 'links_to_page' END AS relation_type FROM r),
f AS (SELECT k.*, CASE relation_type WHEN 'embeds_media' THEN CASE WHEN evidence IN ('f0.png', 'f1.png', 'f2.png') THEN 'confluence:attachment:' || d || '-' || substr(evidence, 2, 1) END ELSE coalesce(t.id, o.id) END AS found
 FROM k LEFT JOIN (SELECT 'Title ' || doc_id AS title, 'confluence:page:' || doc_id AS id FROM documents WHERE doc_id < 50) t ON evidence = title AND relation_type <> 'embeds_media' LEFT JOIN (SELECT 'confluence:page:' || doc_id AS id FROM documents) o ON evidence = o.id),
g AS (SELECT *, coalesce(found, 'confluence:' || CASE relation_type WHEN 'embeds_media' THEN 'attachment' ELSE 'page' END || ':unresolved-' || substr(sha256(source_id || chr(31) || evidence), 1, 16)) AS target_id FROM f)
SELECT 'rel:' || substr(sha256(concat_ws(chr(31), source_id, relation_type, target_id)), 1, 16) AS relation_id, source_id, target_id, relation_type, evidence, CASE WHEN found IS NULL THEN 'unresolved_target' ELSE 'resolved' END AS resolution_status FROM g""")
def reference_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages embed, include and link to, found among files and pages. A file that a page has twice is not found."""
    pages = storage.storage_pages(storage_bodies(spark, sf_dir)).withColumn("document_id", ids.page_document_id(F.col("doc_id")))
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.page_document_id(F.col("doc_id")).alias("document_id"))
    files = docs.select("document_id", "doc_id", F.explode(F.lit([0, 1, 2, 3, 3])).alias("i"))
    files = files.select("document_id", F.concat(F.lit("f"), "i", F.lit(".png")).alias("filename"), F.concat(F.lit("confluence:attachment:"), "doc_id", F.lit("-"), "i").alias("media_id"))
    targets = docs.select(F.when(F.col("doc_id") < 50, F.concat(F.lit("Title "), "doc_id")).alias("title"), F.col("document_id").alias("target_id"))
    return relations.reference_relations(pages, files, targets, DAY).drop("confidence", "created_at")


# ---- a set of raw pages, with those that fail set aside


@query(f"""WITH {_PAGES_SQL}, r AS (SELECT d::VARCHAR AS page_id, t, md, fault, CASE WHEN d % 23 = 0 THEN ['raw_page', 'raw_page_read_failed', ''] WHEN d % 17 = 0 THEN ['raw_page', 'raw_page_status_failed', ''] WHEN d % 19 = 0 THEN ['raw_page', 'source_version_mismatch', '']
 WHEN d % 31 = 0 THEN ['normalization', 'normalization_failed', 'payload'] WHEN d % 29 = 0 THEN ['document', 'document_identity_mismatch', ''] WHEN d % 37 = 0 THEN ['normalization', 'normalization_failed', 'title'] WHEN d % 41 = 0 THEN ['document', 'source_version_mismatch', '']
 WHEN fault IS NOT NULL THEN ['normalization', 'normalization_failed', fault] WHEN regexp_matches(t, '(^|\n)#{{1,3}}{_SPACE}*(\n|$)') THEN ['structure', 'structure_failed', 'empty_structural_heading'] END AS f FROM p JOIN s USING (d)),
g AS (SELECT page_id, md, coalesce(f, ['', '', '']) AS f FROM r)
SELECT page_id, f[1] AS stage, f[2] AS category, f[3] AS detail, CASE WHEN f[1] = '' THEN sha256(md) END AS content_hash FROM g""")
def page_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw answers of a wiki, through the whole chain; each kind of fault is among them."""
    d = F.col("doc_id")
    body = F.to_json(F.struct(
        F.when(d % 29 == 0, d + 1).otherwise(d).cast("string").alias("id"), F.lit("page").alias("type"), F.when(d % 37 == 0, " ").otherwise("Title").alias("title"), F.struct(F.lit("S").alias("key")).alias("space"),
        F.struct(F.when(d % 41 == 0, 8).otherwise(7).alias("number"), F.lit(DAY).alias("when")).alias("version"), F.struct(F.struct(F.col("storage").alias("value"), F.lit("storage").alias("representation")).alias("storage")).alias("body"),
    ))
    body = F.when(d % 23 == 0, F.lit(None)).when(d % 31 == 0, "no json").otherwise(body)
    pages = storage_bodies(spark, sf_dir).select(d.alias("page_id"), F.when(d % 17 == 0, 404).otherwise(200).alias("http_status"), F.lit("7").alias("source_version"), F.when(d % 19 == 0, "6").when(d % 2 == 0, "7").alias("expected_source_version"), body.alias("body"))
    done = pages_ops.process(pages, UNBOUNDED)
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("stage", "category", "detail")]
    return done.select("page_id", *named, ids.content_hash(F.col("text")).alias("content_hash"))


#: A budget that nothing exceeds: what a chunk may hold has its own tests.
UNBOUNDED = Budget(target=1 << 40, hard=1 << 40)


# ---- sources that go on where they stopped, and what is kept between batches


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all tasks share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


#: Results of a window, windows of a batch.
LIMIT, PER_BATCH = 20, 200


@query(f"""WITH c AS (SELECT c_nationkey AS r, c_custkey AS k, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT r::VARCHAR AS root, place - place % {LIMIT} AS start, (place % {LIMIT})::INT AS ordinal, k::VARCHAR AS page_id, c_name AS title, c_mktsegment AS space_key, (k % 4)::VARCHAR AS source_version, r || '/' || (r + 100) AS above,
CASE WHEN place - place % {LIMIT} + {LIMIT} < n THEN place - place % {LIMIT} + {LIMIT} END AS next_start, place - place % {LIMIT} + {LIMIT} >= n AS terminal FROM c""")
def inventory_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of their nations, in windows; a stream reads them, is stopped after a batch, and goes on."""
    c = F.col
    pages = table(spark, sf_dir, "customer").select(
        c("c_nationkey").alias("root"), c("c_custkey").alias("page_id"), c("c_name").alias("title"), c("c_mktsegment").alias("space_key"), (c("c_custkey") % 4).alias("source_version"), F.array("c_nationkey", c("c_nationkey") + 100).alias("ancestor_ids"),
    )
    home = _folder(spark, "windows")
    windows.write_windows(pages, f"{home}/in", LIMIT)
    windows.follow_windows(spark, f"{home}/in", f"{home}/out", f"{home}/cursor", PER_BATCH, stop_after=1)
    windows.follow_windows(spark, f"{home}/in", f"{home}/out", f"{home}/cursor", PER_BATCH)
    return spark.read.schema(windows.SCHEMA).parquet(f"{home}/out").withColumn("above", F.array_join("ancestor_ids", "/")).drop("ancestor_ids")


_EVENTS_SQL = """
e AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderdate AS t, (CASE WHEN o_orderkey % 5 = 4 THEN o_custkey % 3 + 1 ELSE o_custkey % 3 END)::VARCHAR AS version, (o_custkey % 7 <> 0) AS known, o_custkey % 13 = 0 AS twice, o_orderstatus AS sha FROM orders),
v AS (SELECT *, CASE WHEN NOT known THEN 'unknown_inventory' WHEN twice OR version <> (k % 3)::VARCHAR THEN 'identity_conflict' END AS bad FROM e),
f AS (SELECT k, arg_min(sha, row(t, sha, o)) AS first_sha, min(row(t, sha, o)) AS first_one FROM v WHERE bad IS NULL GROUP BY k)
"""


@query(f"""WITH {_EVENTS_SQL} SELECT k::VARCHAR AS page_id, coalesce(bad, CASE WHEN row(t, sha, o) = first_one THEN 'committed' WHEN sha = first_sha THEN 'replayed' ELSE 'conflict' END) AS decision, count(*) AS n FROM v LEFT JOIN f USING (k) GROUP BY ALL""")
def page_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, their orders as answers that came for them, in two batches of a stream."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    seen = table(spark, sf_dir, "customer").where(k % 7 != 0)
    base = seen.select(k.alias("page_id"), F.explode(F.when(k % 13 == 0, F.array(k % 3, k % 3 + 7)).otherwise(F.array(k % 3))).alias("source_version"))
    known = base.select("page_id", F.lit("1980-01-01").cast("timestamp").alias("at"), F.lit("inventory").alias("kind"), "source_version", F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("sha256"))
    k = F.col("o_custkey")
    answers = table(spark, sf_dir, "orders").select(k.alias("page_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.lit("page").alias("kind"), F.when(o % 5 == 4, k % 3 + 1).otherwise(k % 3).alias("source_version"), F.lit(200).alias("http_status"), F.col("o_orderstatus").alias("sha256"))
    home = _folder(spark, "decisions")
    for part in (known, answers):
        run = part.select(F.lit("r").alias("run_id"), F.col("page_id").cast("string"), "at", "kind", F.col("source_version").cast("string"), "http_status", "sha256")
        run.write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(run.schema).parquet(f"{home}/in")
        made = capture.page_decisions(stream, patience="36500 days", late="36500 days")
        made.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start(path=f"{home}/out", format="parquet").awaitTermination()
    return spark.read.schema(capture.DECISIONS).parquet(f"{home}/out").groupBy("page_id", "decision").agg(F.count("*").alias("n"))


# ---- stores kept in cells

_STORE_SQL = """
s AS (SELECT vec_id, label, CASE WHEN vec_id % 10 = 0 THEN [-x for x in embedding::DOUBLE[]] ELSE embedding::DOUBLE[] END AS v, CASE WHEN vec_id % 10 = 0 THEN 'new' ELSE 'old' END AS text FROM embeddings WHERE vec_id % 7 <> 3 AND list_sum([abs(x) for x in embedding::DOUBLE[]]) > 0)
"""


def _vector_store(spark: SparkSession, sf_dir: str) -> tuple[str, str, object]:
    """Two thirds of the vectors, then the rest with every tenth turned round, and every seventh gone."""
    home = _folder(spark, "store")
    rows = table(spark, sf_dir, "embeddings").where(vector_store._usable("embedding")).select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    key = F.col("chunk_id")
    chunk = lambda df, x: df.select("chunk_id", F.lit(x).alias("text"))
    first = rows.where(key % 3 != 2)
    centre = vector_store.centres(first, 16)
    vector_store.save(spark, home, "v1", chunk(first, "old"), first, centre, chunk_cells=8)
    turned = rows.where((key % 3 == 2) | (key % 10 == 0)).withColumn("embedding", F.when(key % 10 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    fresh = chunk(turned, "old").withColumn("text", F.when(key % 10 == 0, "new").otherwise("old"))
    vector_store.save(spark, home, "v2", fresh, turned, centre, None, "v1", chunk_cells=8)
    vector_store.save(spark, home, "v3", chunk(rows.limit(0), ""), rows.limit(0), centre, rows.where(key % 7 == 3).select("chunk_id"), "v2", chunk_cells=8)
    return home, "chunk_id bigint, label int, embedding array<double>", centre


@query(f"""WITH {_STORE_SQL}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 25 = 1 AND list_sum([abs(x) for x in embedding::DOUBLE[]]) > 0),
h AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, v), 12) AS score FROM q, s WHERE label = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM h)
SELECT query_id, vec_id AS chunk_id, round(score, 6) AS score, rank, text FROM r JOIN s USING (vec_id) WHERE rank <= 5""")
def vector_store_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered search after upserts and deletes, and the chunks of the hits from the other store of the same version."""
    home, schema, centre = _vector_store(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 25 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = vector_store.search(spark, home, schema, centre, asked, 5, {"label": 1})
    chunks = cells.read_store(spark, home, "chunks", "chunk_id bigint, text string").drop("cell")
    return hits.join(chunks, "chunk_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "text")


# ---- an inverted index on disk

_INDEX_SQL = """
w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE doc_id % 9 <> 4),
dt AS (SELECT doc_id, term, count(*) AS weight FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 10 = 0 THEN w || ['the', 'new'] ELSE w END) AS term FROM w) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS weight FROM (SELECT item_id AS query_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) || ['new']) AS term FROM benchmark) GROUP BY ALL)
"""


@query(f"""WITH {_INDEX_SQL}, s AS (SELECT query_id, doc_id, sum(dt.weight * qt.weight)::DOUBLE AS score FROM dt JOIN qt USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def inverted_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as queries against an index of all documents' words, every tenth written again with more words, every ninth gone."""
    home = _folder(spark, "index")
    words = text.words(F.col("text"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", words.alias("w"))  # all that follows of a row lies there
    terms = lambda d: retrieval.postings(d, "doc_id", F.col("w"))
    inverted.add_segment(terms(docs), home, "doc_id")
    again = docs.where("doc_id % 10 = 0").withColumn("w", F.concat("w", F.array(F.lit("the"), F.lit("new"))))
    inverted.add_segment(terms(again), home, "doc_id", gone=docs.where("doc_id % 9 = 4").select("doc_id"))
    gone = docs.where("doc_id % 9 = 4 AND doc_id % 10 = 0").select("doc_id")  # put in and taken out at once: gone
    inverted.add_segment(terms(again.limit(0)), home, "doc_id", gone=gone)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(words, F.array(F.lit("new"))).alias("w"))
    return inverted.top_k(spark, home, retrieval.postings(items, "query_id", F.col("w")), 10, "doc_id")
