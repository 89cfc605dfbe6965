"""Queries of a whole delta run: orders as documents of two sources, in two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import delta_run
from tessera.plans.records import _STREAMS_SQL, _numbered
from tessera.plans.registry import DAY, VERSION, query


def versions(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """The old version, the new one, and the inventory between them. Of an order k: new if k % 6 = 5; else gone if k % 5 = 0;
    other texts if k % 7 = 0; other access if k % 11 = 0; without its media if k % 13 = 0."""
    streams = _numbered(spark, sf_dir)
    streams["chunks"] = streams["chunks"].withColumn("content_hash", F.sha2(F.col("l_quantity").cast("string"), 256))
    k = F.col("k")
    rows = streams | {"acl": streams["acl"].withColumn("restricted", F.lit(False))}
    done = lambda s, x: x if s == "documents" else x.drop("k")
    previous = {s: done(s, x.where(k % 6 != 5)) for s, x in rows.items()}
    new = {s: x.where((k % 6 == 5) | (k % 5 != 0)) for s, x in rows.items()}
    new["documents"] = new["documents"].withColumn("content_hash", F.when(k % 7 == 0, F.lit("other")).otherwise(F.col("content_hash")))
    new["chunks"] = new["chunks"].where((k % 7 != 0) | (F.col("chunk_index") != 4)).withColumn("content_hash", F.when((k % 7 == 0) & (F.col("chunk_index") == 2), F.lit("other")).otherwise(F.col("content_hash")))
    new["acl"] = new["acl"].withColumn("restricted", k % 11 == 0)
    new["media_assets"] = new["media_assets"].where(k % 13 != 0)
    state = F.when((k % 6 == 5) | (k % 5 != 0), "present").otherwise(F.element_at(F.lit(["source_deleted", "access_revoked", "moved_out_of_scope"]), (k % 3 + 1).cast("int")))
    inventory = streams["documents"].where((k % 6 != 5) | (k % 2 == 0)).select("document_id", state.alias("state"), F.lit("1").alias("source_version_last_seen"), F.concat(F.lit("seen "), k).alias("detail"))
    return previous, {s: done(s, x) for s, x in new.items()}, inventory


_DELTA_SQL = f"""{_STREAMS_SQL},
has AS (SELECT document_id, bool_or(i = 1 AND NOT git) AS media FROM chunks GROUP BY ALL),
d AS (SELECT docs.*, coalesce(media, FALSE) AS media, ['source_deleted', 'access_revoked', 'moved_out_of_scope'][k % 3 + 1] AS state,
 CASE WHEN k % 6 = 5 THEN 'new' WHEN k % 5 = 0 THEN 'removed' WHEN k % 7 = 0 OR k % 11 = 0 OR (k % 13 = 0 AND media) THEN 'changed' ELSE 'unchanged' END AS outcome FROM docs LEFT JOIN has USING (document_id))
"""


@query(f"""WITH {_DELTA_SQL} SELECT document_id, outcome, concat_ws(',', CASE WHEN outcome = 'removed' THEN state END, CASE WHEN outcome = 'changed' AND k % 7 = 0 THEN 'content_updated' END, CASE WHEN outcome = 'changed' AND k % 11 = 0 THEN 'access_changed' END,
CASE WHEN outcome = 'changed' AND k % 13 = 0 AND media THEN 'dependents_changed' END) AS reasons FROM d""")
def delta_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each document between two versions, and why."""
    change = delta_run.run_delta(*versions(spark, sf_dir), VERSION, DAY)
    return change.outcomes.select("document_id", "outcome", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_DELTA_SQL}, e AS (SELECT document_id, 'chunk' AS t, chunk_id AS e, i FROM chunks UNION ALL SELECT document_id, 'acl', 'acl:' || document_id, NULL FROM docs UNION ALL SELECT document_id, 'media', media_id, NULL FROM media
 UNION ALL SELECT document_id, 'relation', relation_id, NULL FROM relations UNION ALL SELECT document_id, 'symbol', symbol_id, CASE WHEN of IS NOT NULL OR source_version = '0' THEN NULL ELSE -1 END FROM symbols),
x AS (SELECT 'document' AS t, document_id AS e, state AS r FROM d WHERE outcome = 'removed' UNION ALL SELECT t, e, CASE WHEN i = -1 THEN 'content_updated' ELSE state END FROM e JOIN d USING (document_id) WHERE outcome = 'removed'
 UNION ALL SELECT t, e, 'content_updated' FROM e JOIN d USING (document_id) WHERE outcome = 'changed' AND (t = 'chunk' AND k % 7 = 0 AND i IN (2, 4) OR t = 'media' AND k % 13 = 0))
SELECT t AS entity_type, e AS entity_id, r AS reason, CASE WHEN t = 'document' THEN 'seen ' || regexp_extract(e, '[0-9]+$') END AS detail, 'tomb:' || substr(sha256(concat_ws(chr(31), t, e, r, '{VERSION}')), 1, 16) AS tombstone_id FROM x""")
def delta_run_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a delta takes away: removed documents with what hangs on them, and parts of changed ones."""
    return delta_run.run_delta(*versions(spark, sf_dir), VERSION, DAY).tombstones.select("entity_type", "entity_id", "reason", "detail", "tombstone_id")
