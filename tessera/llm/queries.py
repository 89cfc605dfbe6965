"""The operators as queries over whole tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chaining, codebooks, disclosure, hnsw, infill, langid, order_minhash, packing, simhash, suffixes, token_counts, toxicity
from .common import crc_mod, table


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.both_sides(chaining.shared_passages(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.strip_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data, and of words that disclose some, in all documents. Hard rows: see ``disclosure.sanitise``."""
    found = disclosure.sanitise(table(spark, sf_dir, "documents"))
    counts = [disclosure.count_of(F.col("spans"), k).cast("bigint").alias(f"n_{name}") for k, name in enumerate(disclosure.KINDS)]
    base, spans = disclosure.listed(F.col("spans"), base=True), disclosure.listed(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256"))


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings. Hard rows: see ``codebooks.encode``."""
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``infill`` over all documents; the outputs and the texts rebuilt from them as digests. Hard rows: see ``infill``."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    made = infill.infill(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_order_minhash, op2_simhash, op3_collinear_chaining, op4_packing, op5_hnsw, op6_suffix_dedup, op7_toxicity, op8_language_id, op9_bpe, op10_token_counts, op11_disclosure, op12_codebooks, op13_infill)
}


def _codebook_sql() -> str:
    """The rounds one after another; a distance is a sum over the components of a part, ties go to the lower entry."""
    steps = ["""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        "x AS MATERIALIZED (SELECT r, vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS v FROM k, range(4) t(p))",
        "c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= 256)"]
    for i in range(codebooks.ROUNDS + 1):
        far = "list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) for i in range(1, len(x.v) + 1)])::HUGEINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, min({far} * 256 + e) AS m FROM x JOIN c{i} c USING (p) GROUP BY r, p)")
        if i < codebooks.ROUNDS:
            total = f"SELECT p, m % 256 AS e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM x JOIN a{i} USING (r, p)) GROUP BY ALL"
            mean = f"SELECT p, e, list((((s - ((s % n) + n) % n) // n)::BIGINT) ORDER BY i) AS v FROM ({total}) GROUP BY p, e"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN ({mean}) m USING (p, e))")
    n = codebooks.ROUNDS
    steps.append(f"o AS (SELECT vec_id, label, string_agg(printf('%02x', (m % 256)::INT), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{n} JOIN k USING (r) GROUP BY r, vec_id, label)")
    return f"""WITH {", ".join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{n}) AS codebooks_sha256 FROM o"""


#: Fingerprints, models, encoders and searches of the other queries cannot be written in DuckDB's SQL; see tests/llm.
ORACLE_SQL: dict[str, str] = {
    # bytes as pairs of hex digits, windows cut from blocks of 1024 bytes; runs of covered bytes, and what lies between them
    "op6_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, length(h) // 2 AS n FROM documents),
b AS (SELECT r, n, k, substr(h, 2048 * k + 1, 2446) AS p FROM (SELECT *, unnest(range(0, (n + 1023) // 1024)) AS k FROM d)),
w AS (SELECT r, 1024 * k + j AS i, md5(substr(p, 2 * j + 1, 400)) AS m FROM (SELECT *, unnest(range(0, least(1024, n - 199 - 1024 * k))) AS j FROM b)),
s AS (SELECT r, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 200, -1))::INT AS fresh FROM s)),
runs AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY r, g),
kept AS (SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS z FROM runs UNION ALL SELECT d.r, coalesce(max(hi), 0), any_value(n) FROM d LEFT JOIN runs USING (r) GROUP BY d.r),
left_ AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a, z) AS k FROM kept JOIN d USING (r) GROUP BY r),
spans AS (SELECT r, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN left_ USING (r) LEFT JOIN spans USING (r)""",
    # units of a text as a list; the restored text is compared with the text itself
    "op13_infill": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::UBIGINT::BIGINT for i in [0, 1, 2, 3]] AS d FROM t),
c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS z, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:z], '') AS m, array_to_string(u[z + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_codebooks": _codebook_sql(),
}
