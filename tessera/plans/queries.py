"""The engine's operators as queries over whole tables, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, markup, text
from tessera.functions.checkpoints import cut
from tessera.functions.joins import few
from tessera.operators import access, chunking, crawl, delta, evaluation, integrity, relations, retrieval, store
from tessera.operators import wiki as wiki_ops
from tessera.plans import delta_plans, records, sources, wiki  # noqa: F401 - add their queries to those below
from tessera.plans.registry import DAY, NAMESPACE, ORACLE_SQL, QUERIES, TURN, VERSION, query, table  # noqa: F401

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("document_id", ids.page_document_id(F.col("doc_id")))


# ---- retrieval


def _first_vector(spark: SparkSession, sf_dir: str) -> Row:
    """The row of least id; of an empty table one that nothing is near to."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").first() or Row(vec_id=None, embedding=[], label=None)


def _top_sql(score: str, order: str, where: str = "TRUE") -> str:
    return f"""
WITH q AS (SELECT embedding, label FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, {score}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, q WHERE {where} ORDER BY score {order}, vec_id LIMIT 10)
"""


@query(_top_sql("list_cosine_similarity", "DESC", "e.label = q.label") + "SELECT vec_id, round(score, 6) AS score, lang, source FROM s JOIN documents d ON d.doc_id = s.vec_id")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _first_vector(spark, sf_dir)
    hits = retrieval.dense_top_k(table(spark, sf_dir, "embeddings"), q.embedding, 10, {"label": q.label})
    content = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return retrieval.hydrate(hits, content, "vec_id").select("vec_id", F.round("score", 6).alias("score"), "lang", "source")


@query(_top_sql("list_inner_product", "DESC") + "SELECT vec_id, round(score, 6) AS score FROM s")
def dense_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _first_vector(spark, sf_dir)
    return retrieval.dense_top_k(table(spark, sf_dir, "embeddings"), q.embedding, 10, measure="dot").select("vec_id", F.round("score", 6).alias("score"))


@query(_top_sql("list_distance", "ASC") + "SELECT vec_id, round(score, 6) AS score FROM s")
def dense_euclid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _first_vector(spark, sf_dir)
    return retrieval.dense_top_k(table(spark, sf_dir, "embeddings"), q.embedding, 10, measure="euclid").select("vec_id", F.round("score", 6).alias("score"))


def _pairs(words: Column) -> Column:
    """Each two neighbouring words. The last word has no right neighbour: its pair is null and goes."""
    return F.array_compact(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b)))


def _sparse(spark: SparkSession, sf_dir: str, k: int, binary: bool = False) -> DataFrame:
    """The items as queries, by the words that they share with documents."""
    asked = cut(retrieval.postings(table(spark, sf_dir, "benchmark"), "item_id", text.words(F.col("text"))).withColumnRenamed("item_id", "query_id"))
    docs = retrieval.asked_postings(table(spark, sf_dir, "documents"), "doc_id", text.words(F.col("text")), asked)
    if binary:
        docs = docs.withColumn("weight", F.lit(1.0))
    return retrieval.sparse_top_k(docs, asked, k)


_WORDS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: lower(x))"
_TERMS_SQL = f"""
dt AS (SELECT doc_id, term, count(*) AS weight FROM (SELECT doc_id, unnest({_WORDS.format("text")}) AS term FROM documents) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS weight FROM (SELECT item_id AS query_id, unnest({_WORDS.format("text")}) AS term FROM benchmark) GROUP BY ALL)
"""


def _sparse_sql(name: str, weight: str, k: int) -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
 FROM (SELECT query_id, doc_id, sum({weight} * qt.weight)::DOUBLE AS score FROM dt JOIN qt USING (term) GROUP BY ALL)) WHERE rank <= {k})
"""


@query(f"WITH {_TERMS_SQL}, {_sparse_sql('s', 'dt.weight', 10)} SELECT query_id, doc_id, rank, score FROM s")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir, 10).select("query_id", "doc_id", "rank", "score")


_DENSE_MANY_SQL = """
d AS (SELECT * FROM (SELECT b.item_id AS query_id, v.vec_id AS doc_id, row_number() OVER (PARTITION BY b.item_id
 ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank,
 list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
 FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v) WHERE rank <= 40)
"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(vectors, "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    return store.dense_top_k_many(vectors, asked, k).withColumnRenamed("vec_id", "doc_id")


@query(f"WITH {_DENSE_MANY_SQL} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM d")
def dense_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, retrieval.PREFETCH).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_TERMS_SQL}, {_sparse_sql("s", "dt.weight", 40)}, {_DENSE_MANY_SQL},
u AS (SELECT query_id, doc_id, rank, 0 AS list FROM d UNION ALL SELECT query_id, doc_id, rank, 1 FROM s),
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.fuse(_dense(spark, sf_dir, retrieval.PREFETCH), _sparse(spark, sf_dir, retrieval.PREFETCH), 10)
    return fused.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""
WITH t AS (SELECT doc_id, lang, source, CASE WHEN source IS NULL THEN ['restricted:unresolved'] ELSE ['group:' || source, 'group:' || lang] END AS tags FROM documents)
SELECT doc_id, lang, source FROM t WHERE list_has_any(tags, ['group:src1', 'group:de']) AND NOT list_contains(tags, 'restricted:unresolved')""")
def visible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("source").isNull(), F.array(F.lit(access.UNRESOLVED))).otherwise(F.array(F.concat(F.lit("group:"), "source"), F.concat(F.lit("group:"), "lang")))
    return retrieval.visible(table(spark, sf_dir, "documents").withColumn("acl_tags", tag), ["group:src1", "group:DE"]).select("doc_id", "lang", "source")


# ---- evaluation


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item word for word: both hold the pair of words in the item's middle.

    Items of four words or fewer may have no such pair, so they are sought in each text.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("item"), text.words(F.col("text")).alias("w"))
    short = items.where(F.size("w") <= 4).select("case_id", "item")
    cases = items.where(F.size("w") > 4)
    half = F.floor(F.size("w") / 2).cast("int")
    cases = cases.select("case_id", "item", F.concat(F.get("w", half - 1), F.lit(" "), F.get("w", half)).alias("term"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    if few(cases):  # a text stays beside its pairs of words until it is looked at: none is shuffled
        beside = texts.select("doc_id", "text", F.explode(_pairs(text.words(F.col("text")))).alias("term"))
        long = beside.join(F.broadcast(cases), "term").where(F.contains("text", "item")).select("case_id", "doc_id").distinct()
    else:  # pairs meet the cases without their texts, which only the documents found are asked for
        pairs = texts.select("doc_id", F.explode(F.array_distinct(_pairs(text.words(F.col("text"))))).alias("term"))
        found = pairs.join(cases, "term").select("doc_id", "case_id", "item").distinct()
        long = texts.join(found, "doc_id").where(F.contains("text", "item")).select("case_id", "doc_id")
    return long.unionByName(texts.join(short, F.contains("text", "item")).select("case_id", "doc_id"))


_EVAL_SQL = f"""
{_TERMS_SQL}, {_sparse_sql("a", "dt.weight", 10)}, {_sparse_sql("b", "1", 10)},
rel AS (SELECT item_id AS case_id, doc_id FROM benchmark q JOIN documents d ON contains(d.text, q.text)),
cases AS (SELECT DISTINCT case_id FROM rel),
fa AS (SELECT case_id, min(rank) AS first FROM rel JOIN a ON a.query_id = case_id AND a.doc_id = rel.doc_id GROUP BY ALL),
fb AS (SELECT case_id, min(rank) AS first FROM rel JOIN b ON b.query_id = case_id AND b.doc_id = rel.doc_id GROUP BY ALL),
sa AS (SELECT case_id, coalesce(first <= 5, FALSE) AS hit5, coalesce(first <= 10, FALSE) AS hit10, coalesce(1.0::DOUBLE / first, 0) AS rr FROM cases LEFT JOIN fa USING (case_id)),
sb AS (SELECT case_id, coalesce(1.0::DOUBLE / first, 0) AS rr FROM cases LEFT JOIN fb USING (case_id))
"""


def _scores(spark: SparkSession, sf_dir: str, relevant: DataFrame, binary: bool = False) -> DataFrame:
    return evaluation.case_scores(_sparse(spark, sf_dir, 10, binary).withColumnRenamed("query_id", "case_id"), relevant)


@query(f"""WITH {_EVAL_SQL} SELECT round(coalesce(avg(hit5::INT), 0), 6) AS hit5, round(coalesce(avg(hit10::INT), 0), 6) AS hit10, round(coalesce(avg(rr), 0), 6) AS mrr,
count(*) AS evaluated, (SELECT count(DISTINCT item_id) FROM benchmark) - count(*) AS skipped FROM sa""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"))
    out = evaluation.summary(_scores(spark, sf_dir, cut(_relevant(spark, sf_dir))), cases)
    return out.select(*[F.round(c, 6).alias(c) for c in ("hit5", "hit10", "mrr")], "evaluated", "skipped")


@query(f"""WITH {_EVAL_SQL} SELECT case_id, round(sa.rr, 6) AS a, round(sb.rr, 6) AS b, CASE WHEN sb.rr > sa.rr THEN 'improved' WHEN sb.rr < sa.rr THEN 'regressed' ELSE 'same' END AS outcome
FROM sa JOIN sb USING (case_id)""")
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = cut(_relevant(spark, sf_dir))
    pairs = evaluation.compare(_scores(spark, sf_dir, relevant), _scores(spark, sf_dir, relevant, True))
    return pairs.select("case_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "outcome")


@query("""SELECT lang, percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars) AS p95,
min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang""")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("lang")
    return docs.agg(evaluation.nearest_rank("n_chars", 0.5).alias("p50"), evaluation.nearest_rank("n_chars", 0.95).alias("p95"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def counts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


# ---- text and identifiers

_SPACE = r"[\t\x0B\x0C\x0D\x1C-\x1F\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"""SELECT doc_id, sha256(t) AS content_hash, length(t) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
nfc_normalize(text), '\r\n?', chr(10), 'g'), '{_SPACE}+(\n|\z)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A\n+|\n+\z', '', 'g') AS t FROM documents)""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.normalize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"), F.char_length("text").cast("bigint").alias("n"))


@query("""SELECT doc_id, 'chunk:confluence:' || substr(sha256(concat_ws(chr(31), 'confluence', doc_id::VARCHAR, '#w0', text)), 1, 16) AS chunk_id,
'acl:confluence:page:' || doc_id AS acl_id FROM documents""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", ids.chunk_id(F.lit("confluence"), F.col("doc_id"), F.lit("#w0"), F.col("text")).alias("chunk_id"), ids.acl_id(F.col("document_id")).alias("acl_id"))


@query(f"""WITH h AS (SELECT page_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || url::BLOB) AS h FROM pages)
SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def page_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ids.uuid5(NAMESPACE, F.col("url")).alias("uuid"))


_BLANK = _SPACE[:-1] + r"\n]"


@query(rf"""WITH RECURSIVE w AS (SELECT doc_id, text, length(text) AS n, 0 AS s, 0 AS k FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, text, n, e - 150, k + 1 FROM (SELECT *, CASE WHEN s + 1500 < n THEN s + CASE WHEN r > 0 AND 1500 - r > 750 THEN 1501 - r ELSE 1500 END ELSE n END AS e
  FROM (SELECT *, strpos(reverse(substr(text, s + 1, 1500)), chr(10)) AS r FROM w)) WHERE e < n),
t AS (SELECT doc_id, k, regexp_replace(substr(text, s + 1, CASE WHEN s + 1500 < n AND r > 0 AND 1500 - r > 750 THEN 1501 - r ELSE 1500 END), '\A{_BLANK}+|{_BLANK}+\z', '', 'g') AS t
 FROM (SELECT *, strpos(reverse(substr(text, s + 1, 1500)), chr(10)) AS r FROM w))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, sha256(t) AS content_hash FROM t WHERE t <> ''""")
def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.char_chunks(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "chunk_index", ids.content_hash(F.col("text")).alias("content_hash"))


@query()
def pages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.to_markdown(table(spark, sf_dir, "pages"))


@query()
def wiki_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(ids.page_document_id(F.col("page_id")).alias("document_id"), "html")
    return wiki_ops.chunk_rows(wiki_ops.chunk_pages(pages, "html", read=markup.render))


@query()
def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_report(wiki_chunks(spark, sf_dir))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 5, 0) + 1, 36)) AS s FROM l)
SELECT doc_id AS document_id, s + 1 AS line_start, least(s + 40, len(l)) AS line_end, sha256(array_to_string(l[s + 1 : s + 40], chr(10))) AS content_hash FROM s""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.line_windows(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id"))
    return rows.select("document_id", "line_start", "line_end", ids.content_hash(F.col("text")).alias("content_hash"))


# ---- relations and access


@query(f"""WITH o AS (SELECT DISTINCT o_custkey AS document_id, 'PR_' || substr(o_orderpriority, 1, 1) || '-' || (o_orderkey % 50) AS evidence FROM orders WHERE o_orderstatus <> 'P'),
t AS (SELECT document_id, evidence, 'jira:' || evidence AS target_id FROM o WHERE substr(evidence, 4, 1) IN ('1', '3'))
SELECT 'rel:' || substr(sha256(concat_ws(chr(31), document_id::VARCHAR, 'mentions_jira_key', target_id)), 1, 16) AS relation_id, document_id AS source_id, target_id, evidence, 0.95::DOUBLE AS confidence,
'unresolved_without_jira_api' AS resolution_status, '{DAY}' AS created_at FROM t""")
def issue_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for pages that name issues of projects by priority; those of two projects are allowed."""
    return relations.issue_relations(_issue_pages(spark, sf_dir), DAY, ["PR_1", "PR_3"]).drop("relation_type")


def _issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("PR_"), F.substring("o_orderpriority", 1, 1), F.lit("-"), F.col("o_orderkey") % 50)
    words = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("see ("), key, F.lit("), not x"), key, F.lit(" or "), key, F.lit("a;")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.concat_ws(" ", F.collect_list(words)).alias("text"))


@query("""WITH o AS (SELECT 'PR_' || substr(o_orderpriority, 1, 1) || '-' || (o_orderkey % 50) AS k FROM orders WHERE o_orderstatus <> 'P')
SELECT count(*) AS occurrences, count(DISTINCT k) AS unique_keys, count(*) FILTER (WHERE substr(k, 4, 1) IN ('1', '3')) AS inside, count(*) FILTER (WHERE substr(k, 4, 1) NOT IN ('1', '3')) AS outside FROM o""")
def issue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.issue_metrics(_issue_pages(spark, sf_dir), ["PR_1", "PR_3"])


@query(r"""
WITH l AS (SELECT DISTINCT 'confluence:page:' || page_id AS document_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''>]+)["'']', 1)) AS evidence FROM pages),
t AS (SELECT regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS title, 'confluence:page:' || page_id AS target_id FROM pages),
u AS (SELECT title, min(target_id) AS target_id FROM t GROUP BY title HAVING count(DISTINCT target_id) = 1),
j AS (SELECT document_id, evidence, u.target_id AS found, coalesce(u.target_id, 'unresolved:' || substr(sha256(document_id || chr(31) || evidence), 1, 16)) AS target_id FROM l LEFT JOIN u ON u.title = l.evidence)
SELECT 'rel:' || substr(sha256(concat_ws(chr(31), document_id, 'links_to_page', target_id)), 1, 16) AS relation_id, document_id AS source_id, target_id, evidence,
CASE WHEN found IS NULL THEN 'unresolved_target' ELSE 'resolved' END AS resolution_status FROM j""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("document_id", ids.page_document_id(F.col("page_id")))
    targets = pages.select(F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("title"), F.col("document_id").alias("target_id"))
    return relations.resolve(relations.links(pages), targets, DAY).select("relation_id", "source_id", "target_id", "evidence", "resolution_status")


_ACCESS_SQL = """
o AS (SELECT o_custkey AS d, o_orderkey AS k, substr(o_orderpriority, 1, 1) AS p, CASE WHEN o_totalprice > 490000 THEN 'unavailable' WHEN o_orderstatus = 'P' THEN 'unrestricted' ELSE 'restricted' END AS c, o_orderdate AS t,
 CASE WHEN o_orderstatus = 'P' THEN [] ELSE list_filter(['u1', 'U2', 'u3', 'u4', 'u5'], lambda x: substr(x, 2, 1) <> substr(o_orderpriority, 1, 1)) || CASE WHEN o_orderkey % 97 = 0 THEN ['no body'] ELSE [] END END AS us FROM orders),
a AS (SELECT d, bool_or(c = 'unavailable') AS lost, bool_or(c = 'restricted') AS held, bool_or(list_contains(us, 'no body')) AS bad, max(k) AS last,
 coalesce(list(DISTINCT p) FILTER (WHERE c = 'restricted'), []) AS ps, coalesce(list(k ORDER BY k) FILTER (WHERE c = 'restricted'), []) AS ks FROM o GROUP BY d),
u AS (SELECT a.*, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS space, list_filter(['u1', 'u2', 'u3', 'u4', 'u5'], lambda x: NOT list_contains(ps, substr(x, 2, 1))) AS common,
 list_filter(['u1', 'U2', 'u3', 'u4', 'u5'], lambda x: len(ps) > 1 OR NOT list_contains(ps, substr(x, 2, 1))) AS every FROM a LEFT JOIN customer ON c_custkey = d),
r AS (SELECT *, list_filter(CASE WHEN lost THEN ['restriction_observations_unavailable', CASE WHEN bad THEN 'non_enforceable_user_principal' END]
 WHEN NOT held THEN [CASE WHEN NOT coalesce(regexp_full_match(space, '[A-Z0-9]+'), FALSE) THEN 'space_tag_unrepresentable' END]
 ELSE [CASE WHEN bad THEN 'non_enforceable_user_principal' END, CASE WHEN len(every) > len(common) THEN 'user_principal_dropped_by_intersection' END, CASE WHEN len(common) = 0 THEN 'empty_effective_intersection' END] END, lambda x: x IS NOT NULL) AS why FROM u),
access AS (SELECT d AS document_id, 'acl:' || d AS acl_id, lost OR held AS is_restricted, CASE WHEN lost THEN ['restricted:unresolved'] WHEN held THEN CASE WHEN len(common) = 0 THEN ['restricted:unresolved'] ELSE list_transform(common, lambda x: 'user:' || x) END
 WHEN len(why) = 0 THEN ['space:' || space] ELSE ['restricted:unresolved'] END AS tags, CASE WHEN lost THEN 'unavailable' WHEN len(why) > 0 THEN 'partial' ELSE 'ok' END AS status,
 CASE WHEN len(why) > 0 THEN 'approximate' ELSE 'exact' END AS confidence, array_to_string(why, ',') AS reasons, CASE WHEN NOT lost THEN array_to_string(CASE WHEN held THEN every ELSE [] END, ',') END AS allowed,
 CASE WHEN NOT lost THEN array_to_string(ks, ',') END AS sources, CASE WHEN NOT lost THEN len(list_filter(ks, lambda x: x < last)) > 0 END AS inherited FROM r)
"""


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for levels of a page, each restricted one naming four of five users; customers for pages, with their spaces."""
    everyone = F.array(*[F.lit(x) for x in ("u1", "U2", "u3", "u4", "u5")])
    o, none = table(spark, sf_dir, "orders"), F.array().cast("array<string>")
    seen = F.when(F.col("o_totalprice") > 490000, 500).otherwise(200)
    named = F.filter(everyone, lambda u: F.substring(u, 2, 1) != F.substring("o_orderpriority", 1, 1))
    users = F.when(F.col("o_orderstatus") == "P", none).otherwise(F.concat(named, F.when(F.col("o_orderkey") % 97 == 0, F.array(F.lit("no body"))).otherwise(none)))
    levels = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("level"), F.col("o_orderkey").alias("source_page_id"), seen.alias("status"), users.alias("users"), none.alias("groups"))
    levels = levels.withColumn("classification", access.classify_observation(F.col("status"), F.col("users"), F.col("groups")))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("space_key"))
    return access.materialize(levels, pages, "crawler", DAY)


@query(f"WITH {_ACCESS_SQL} SELECT document_id, is_restricted, array_to_string(tags, ',') AS tags, status, confidence, reasons, allowed, sources, inherited FROM access")
def access_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c, n: F.when(F.col(c).isNotNull(), F.concat_ws(",", c)).alias(n)
    return _access(spark, sf_dir).select(
        "document_id", "is_restricted", joined("acl_tags", "tags"), F.col("acl_extraction_status").alias("status"), F.col("acl_confidence").alias("confidence"), joined("reason_codes", "reasons"),
        joined("allowed_users", "allowed"), joined("restriction_source_page_ids", "sources"), F.col("restriction_inherited").alias("inherited"),
    )


@query(f"""WITH {_ACCESS_SQL} SELECT document_id, sha256('{{"acl_id":"' || acl_id || '","acl_tags":["' || array_to_string(tags, '","') || '"],"document_id":"' || document_id || '","is_restricted":' || is_restricted || ',"source_system":"confluence"}}') AS fingerprint FROM access""")
def access_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    acl = _access(spark, sf_dir).withColumn("source_system", F.lit("confluence")).withColumn("document_id", F.col("document_id").cast("string"))
    return access.fingerprint(acl).select(F.col("document_id").cast("bigint").alias("document_id"), "fingerprint")


@query(f"""WITH {_ACCESS_SQL} SELECT count(*) AS records, count(*) FILTER (WHERE is_restricted) AS restricted, count(*) FILTER (WHERE inherited) AS inherited, count(*) FILTER (WHERE list_contains(tags, 'restricted:unresolved')) AS unresolved,
count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'unavailable') AS unavailable FROM access""")
def access_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.quality(_access(spark, sf_dir))


# ---- versions


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem")
    def one(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("l_partkey").alias("document_id")).agg(F.sum("l_quantity").cast("bigint").alias("quantity")).withColumn("content_hash", F.sha2(F.col("quantity").cast("string"), 256))

    return one(items.where(F.col("l_shipdate") < TURN)), one(items.where(F.col("l_shipdate") >= TURN))


_VERSIONS_SQL = f"""
p AS (SELECT l_partkey AS document_id, sum(l_quantity)::BIGINT AS quantity FROM lineitem WHERE l_shipdate < '{TURN}' GROUP BY ALL),
c AS (SELECT l_partkey AS document_id, sum(l_quantity)::BIGINT AS quantity FROM lineitem WHERE l_shipdate >= '{TURN}' GROUP BY ALL),
o AS (SELECT document_id, CASE WHEN p.quantity IS NULL THEN 'new' WHEN c.quantity IS NULL THEN 'removed' WHEN p.quantity = c.quantity THEN 'unchanged' ELSE 'changed' END AS outcome FROM p FULL JOIN c USING (document_id))
"""


@query(f"WITH {_VERSIONS_SQL} SELECT * FROM o")
def delta_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.classify(*_versions(spark, sf_dir))


def _tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = delta_outcomes(spark, sf_dir).where("outcome IN ('removed', 'changed')")
    reason = F.when(F.col("outcome") == "removed", "source_deleted").otherwise("content_updated")
    return delta.tombstones(gone.select(F.lit("document").alias("entity_type"), F.col("document_id").alias("entity_id"), reason.alias("reason"), F.lit(None).cast("string").alias("detail")), VERSION, DAY)


@query(f"""WITH {_VERSIONS_SQL}, t AS (SELECT document_id AS entity_id, CASE outcome WHEN 'removed' THEN 'source_deleted' ELSE 'content_updated' END AS reason FROM o WHERE outcome IN ('removed', 'changed'))
SELECT 'tomb:' || substr(sha256(concat_ws(chr(31), 'document', entity_id::VARCHAR, reason, '{VERSION}')), 1, 16) AS tombstone_id, entity_id, reason FROM t""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tombstones(spark, sf_dir).select("tombstone_id", "entity_id", "reason")


@query(f"WITH {_VERSIONS_SQL} SELECT document_id, quantity, sha256(quantity::VARCHAR) AS content_hash FROM c")
def overlay_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old version under the delta gives the new version."""
    old, new = _versions(spark, sf_dir)
    changed = new.join(delta.classify(old, new).where("outcome IN ('new', 'changed')"), "document_id", "left_semi")
    return delta.overlay(old, changed, _tombstones(spark, sf_dir), "document_id", "document").select("document_id", "quantity", "content_hash")


@query("""
WITH a AS (SELECT c_nationkey AS nationkey, count(*) AS n FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS nationkey, count(*) AS n FROM supplier GROUP BY ALL)
SELECT nationkey, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS copies, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'first' ELSE 'second' END AS side
FROM a FULL JOIN b USING (nationkey) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def version_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return delta.differences(a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")))


@query("""
SELECT 'order_has_customer' AS "check", o_orderkey::VARCHAR AS id FROM orders ANTI JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'item_has_part', l_orderkey || ':' || l_linenumber FROM lineitem ANTI JOIN part ON p_partkey = l_partkey
UNION ALL SELECT 'vector_per_document', coalesce(doc_id, vec_id)::VARCHAR FROM documents FULL JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL
UNION ALL SELECT 'order_id_unique', o_orderkey::VARCHAR FROM orders GROUP BY o_orderkey HAVING count(*) > 1""")
def closure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    items = t("lineitem").withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"))
    return (
        integrity.orphans(t("orders"), t("customer"), {"o_custkey": "c_custkey"}, "order_has_customer", "o_orderkey")
        .unionByName(integrity.orphans(items, t("part"), {"l_partkey": "p_partkey"}, "item_has_part", "id"))
        .unionByName(integrity.unpaired(t("documents"), vectors, "doc_id", "vector_per_document"))
        .unionByName(integrity.duplicates(t("orders"), "o_orderkey", "order_id_unique"))
    )


@query("""
SELECT 'n_chars_counts' AS "check", doc_id::VARCHAR AS id FROM documents WHERE NOT coalesce(n_chars = length(text), FALSE)
UNION ALL SELECT 'no_tabs', doc_id::VARCHAR FROM documents WHERE NOT coalesce(NOT contains(text, chr(9)), FALSE)
UNION ALL SELECT 'language_known', doc_id::VARCHAR FROM documents WHERE NOT coalesce(lang IN ('en', 'de'), FALSE)
UNION ALL SELECT 'not_long', doc_id::VARCHAR FROM documents WHERE NOT coalesce(length(text) < 3000, FALSE)""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"n_chars_counts": F.col("n_chars") == F.char_length("text"), "no_tabs": ~F.contains("text", F.lit("\t"))}
    rules |= {"language_known": F.col("lang").isin("en", "de"), "not_long": F.char_length("text") < 3000}
    return integrity.rule_violations(table(spark, sf_dir, "documents"), rules, "doc_id")


# ---- tables


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"WITH {_VERSIONS_SQL} SELECT document_id, c.quantity AS quantity, coalesce(p.quantity, c.quantity) AS first_quantity FROM c LEFT JOIN p USING (document_id) UNION ALL SELECT document_id, quantity, quantity FROM p ANTI JOIN c USING (document_id)")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (v.select("document_id", "quantity", F.col("quantity").alias("first_quantity")) for v in _versions(spark, sf_dir))
    return store.upsert(old, new, ["document_id"], keep=["first_quantity"])


@query("SELECT doc_id, lang, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 20, 20)


@query("""
WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'documents' AS store, doc_id FROM documents ANTI JOIN g USING (doc_id) UNION ALL SELECT 'vectors', vec_id FROM embeddings ANTI JOIN g ON g.doc_id = vec_id""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    left = store.cascade_delete(docs, docs, vectors, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return left[0].select(F.lit("documents").alias("store"), "doc_id").unionByName(left[2].select(F.lit("vectors").alias("store"), "doc_id"))


# ---- crawl


@query("""
WITH a AS (SELECT c_custkey, 'c' || c_custkey AS p, 'n' || n_nationkey AS n, 'r' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE WHEN p IN ('c7', 'c11') THEN 'page_excluded' WHEN n = 'n6' OR r = 'r3' THEN 'ancestor_excluded' WHEN n = 'n5' OR r IN ('r0', 'r1') THEN 'included_descendant' ELSE 'outside_roots' END AS reason,
CASE WHEN p IN ('c7', 'c11') THEN p WHEN n = 'n6' THEN n WHEN r = 'r3' THEN r WHEN n = 'n5' THEN n WHEN r IN ('r0', 'r1') THEN r END AS "by" FROM a""")
def scope_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    above = F.array(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"))
    names = lambda *x: F.lit(list(x))
    s = crawl.scope(F.concat(F.lit("c"), "c_custkey"), above, names("r0", "r1", "n5"), names("c7", "c11"), names("n6", "r3"))
    return rows.select("c_custkey", s["reason"].alias("reason"), s["by"].alias("by"))


_STATUS = {"error": 404, "view": 403, "click": 200, "purchase": 401, "signup": 503}
_STATUS_SQL = "CASE event_type WHEN 'error' THEN 404 WHEN 'view' THEN 403 WHEN 'click' THEN 200 WHEN 'purchase' THEN 401 ELSE 503 END"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    return table(spark, sf_dir, "events").withColumn("status", F.try_element_at(names, F.col("event_type")))


@query(f"""
WITH e AS (SELECT {_STATUS_SQL} AS s, value > 50 AS i FROM events)
SELECT CASE WHEN s = 404 THEN 'source_deleted' WHEN s = 403 THEN 'access_revoked' WHEN s = 200 AND NOT i THEN 'moved_out_of_scope' WHEN s < 500 THEN 'failed' ELSE 'incomplete' END AS state, count(*) AS n FROM e GROUP BY ALL""")
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).groupBy(delta.disposition(F.col("status"), F.col("value") > 50).alias("state")).agg(F.count("*").alias("n"))


@query(f"""
WITH e AS (SELECT user_id, {_STATUS_SQL} AS s, count(*) AS tries FROM events GROUP BY ALL)
SELECT user_id, s AS status, CASE s WHEN 404 THEN 'missing' WHEN 403 THEN 'permission' WHEN 200 THEN 'none' WHEN 401 THEN 'authentication' ELSE 'server' END AS kind, s = 503 AS retry,
greatest(least(60.0::DOUBLE, pow(2.0::DOUBLE, tries - 1)), 3.0::DOUBLE) AS delay FROM e""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = _statuses(spark, sf_dir).groupBy("user_id", "status").agg(F.count("*").alias("tries"))
    f = crawl.failure(F.col("status"))
    return tries.select("user_id", "status", f["kind"].alias("kind"), f["retry"].alias("retry"), crawl.retry_delay(F.col("tries"), F.lit(None)).alias("delay"))


@query("SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 100)::BIGINT AS batch FROM events")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.batches(table(spark, sf_dir, "events").select("event_id"), "event_id").select("event_id", "batch")


@query("""
WITH e AS (SELECT user_id, (ts, event_id) AS moment, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS s FROM events),
a AS (SELECT user_id, arg_min(s, moment) FILTER (WHERE s IN ('completed', 'failed')) AS e, arg_max(s, moment) AS l, min(moment) FILTER (WHERE s = 'running') AS r, min(moment) FILTER (WHERE s IN ('completed', 'failed')) AS t, count(*) AS events FROM e GROUP BY user_id)
SELECT user_id, coalesce(e, l) AS state, events, coalesce(e, l) = 'paused' OR (coalesce(e, l) = 'failed' AND coalesce(r < t, FALSE)) AS resumable FROM a""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"signup": "pending", "view": "running", "click": "paused", "purchase": "completed", "error": "failed"}
    to = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return crawl.job_states(table(spark, sf_dir, "events").withColumn("state", F.try_element_at(to, F.col("event_type"))), "user_id")


@query("SELECT user_id || ':' || event_type AS active_key, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS requests FROM events GROUP BY ALL")
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.submissions(table(spark, sf_dir, "events").withColumn("active_key", F.concat_ws(":", "user_id", "event_type")), "active_key")


@query("""
WITH s AS (SELECT s_nationkey AS page_id, ['r' || n_regionkey, 'n' || n_nationkey] AS a, n_name AS title FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION ALL SELECT c_nationkey, ['n' || n_nationkey], n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT page_id, array_to_string(arg_max(a, len(a)), '/') AS path, min(title) AS title, count(*) AS sightings, 0::BIGINT AS conflicts FROM s GROUP BY page_id""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    region, nation = F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")
    a = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("page_id"), F.array(region, nation).alias("ancestor_ids"), F.col("n_name").alias("title"))
    b = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_nationkey").alias("page_id"), F.array(nation).alias("ancestor_ids"), F.col("n_name").alias("title"))
    return crawl.resolve_inventory(a.unionByName(b), ["title"]).select("page_id", F.array_join("ancestor_ids", "/").alias("path"), "title", "sightings", "conflicts")
