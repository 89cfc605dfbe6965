"""An inverted index on disk: postings by bucket of their term and block of rows, with the greatest weight of each block.

Rows are put in blocks by their size, large ones first, so that the rows that common terms weigh most in share a few blocks. A query
reads the buckets of its terms, there only the heads of blocks, and from them the most that any row of a block can score. It
then reads the postings of the best blocks, and of those others that may still hold a row as good as the k-th one found:
the rest, most of the rows that hold a common term, are never scored.

The index grows by segments. A row that is put in again, or taken out, counts as of its last segment only; its older
postings are left where they are until ``merge_segments`` writes the index anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.checkpoints import cut, partitions
from tessera.functions.joins import few
from tessera.operators.retrieval import ranked
from tessera.sources.files import _path

#: Rows of a block, buckets of terms, blocks of a query that are scored before any is left out.
BLOCK, BUCKETS, FIRST = 256, 64, 4
#: Postings that lie together, about, where a bucket is written.
SLICE = 500_000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def segments(spark: SparkSession, path: str) -> list[int]:
    home, fs = _path(spark, path)
    if not fs.exists(home):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(home)]
    return sorted(int(n.removeprefix("segment=")) for n in names if n.startswith("segment="))


def add_segment(terms: DataFrame, path: str, key: str, gone: DataFrame | None = None) -> int:
    """Write (key, term, weight) as the next segment; its number. A row has all its terms in one segment.

    ``gone`` are keys of rows that the index shall not hold any more. A row that is both put in and gone is gone.
    """
    spark = terms.sparkSession
    number = max(segments(spark, path), default=0) + 1
    rows = terms.where(F.col(key).isNotNull() & F.col("term").isNotNull()).select(key, "term", F.col("weight").cast("double").alias("weight"))
    if gone is not None:
        out = gone.select(key).distinct()
        rows = rows.join(F.broadcast(out) if few(out) else out, key, "left_anti")
    # a row's terms are gathered once and kept beside each other: sizes and postings both come from there
    folder = f"{path}/.segment={number}"
    whole = rows.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("terms"), F.sum("weight").alias("size"), F.count("*").alias("n"))
    whole.write.parquet(f"{folder}/rows")
    whole = spark.read.schema(whole.schema).parquet(f"{folder}/rows")
    n, many = whole.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # large rows first, in as many ranges as blocks are needed; within a range by hash
    edges = _edges(whole, n)
    block = F.lit(0).cast("bigint") if not edges else F.aggregate(F.lit(edges), F.lit(0).cast("bigint"), lambda a, e: a + (F.col("size") < e).cast("bigint"))
    per = max(1, -(-n // (len(edges) + 1) // BLOCK))
    placed = whole.withColumn("block", block * per + F.pmod(F.xxhash64(key), F.lit(per)))
    # postings are dealt out once, by bucket and slice of blocks, and stay there to be gathered and written
    slices = max(1, many // (BUCKETS * SLICE))
    each = placed.select(key, "block", F.explode("terms").alias("t")).select("t.term", "block", F.col(key).alias("key"), "t.weight")
    each = each.select("*", _bucket(F.col("term")).alias("bucket"), F.pmod("block", F.lit(slices)).cast("int").alias("slice")).repartition(max(partitions(spark), BUCKETS * slices if slices > 1 else 0), "bucket", "slice")
    post = each.groupBy("bucket", "slice", "term", "block").agg(F.max("weight").alias("most"), F.array_sort(F.collect_list(F.struct("key", "weight"))).alias("postings"))
    post.select("term", "block", "most", "postings", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
    held = placed.select(key, F.lit(True).alias("live"))
    held = held if gone is None else held.unionByName(gone.select(key).distinct().withColumn("live", F.lit(False)))
    held.write.parquet(f"{folder}/keys")
    home, fs = _path(spark, f"{folder}/rows")
    fs.delete(home, True)
    home, fs = _path(spark, folder)
    fs.rename(home, _path(spark, f"{path}/segment={number}")[0])
    return number


def _edges(sizes: DataFrame, n: int) -> list[float]:
    """Sizes that part the rows into at most 256 ranges of at least a block each, largest first."""
    parts = min(256, n // BLOCK)
    if parts < 2:
        return []
    found = sizes.agg(F.percentile_approx("size", [i / parts for i in range(1, parts)], 10_000).alias("e")).first().e
    return sorted(set(map(float, found)), reverse=True)


def _read(spark: SparkSession, path: str, number: int, part: str, key: str) -> DataFrame:
    home = f"{path}/segment={number}"
    if part == "keys":
        return spark.read.parquet(f"{home}/keys").withColumn("segment", F.lit(number))
    kind = spark.read.parquet(f"{home}/keys").schema[key].dataType.simpleString()  # a segment without postings has no file of them
    return spark.read.schema(f"term string, block bigint, most double, postings array<struct<key:{kind},weight:double>>, bucket int").parquet(f"{home}/postings").withColumn("segment", F.lit(number))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _replaced(spark: SparkSession, path: str, known: list[int], key: str) -> DataFrame | None:
    """(key, segment): rows of a segment that a later one has again or takes out. None if no segment can have any."""
    if len(known) == 1:
        return None
    later = _union([_read(spark, path, s, "keys", key) for s in known[1:]]).groupBy(key).agg(F.max("segment").alias("last"))
    return _union([_read(spark, path, s, "keys", key) for s in known[:-1]]).join(later, key).where("segment < last").select(F.col(key).alias("key"), "segment")


def top_k(spark: SparkSession, path: str, query_terms: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best rows of each query (query_id, term, weight) by the dot product over shared terms: (query_id, key, score, rank).

    Exactly those of a scan of all postings; ties go to the smaller key. Weights are not below zero.
    """
    known = segments(spark, path)
    asked = cut(query_terms.where("term IS NOT NULL").select("query_id", "term", F.col("weight").alias("query_weight")))
    buckets = [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS
    if not known or not buckets:
        return spark.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, {key} bigint, score double, rank int")
    index = _union([_read(spark, path, s, "postings", key).where(F.col("bucket").isin(buckets)) for s in known])
    small = F.broadcast(asked) if few(asked) else asked
    bounds = cut(index.select("term", "segment", "block", "most").join(small, "term").groupBy("query_id", "segment", "block").agg(F.sum(F.col("most") * F.col("query_weight")).alias("bound")))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
    placed = cut(bounds.withColumn("place", F.row_number().over(order)))
    dead = _replaced(spark, path, known, key)
    dead = None if dead is None else cut(dead)

    def scored(pairs: DataFrame) -> DataFrame:
        """Scores of all rows in some blocks of queries."""
        wanted = pairs.select("query_id", "segment", "block").join(asked, "query_id")
        hits = index.join(F.broadcast(wanted) if few(wanted) else wanted, ["term", "segment", "block"]).select("query_id", "segment", "query_weight", F.explode("postings").alias("p"))
        rows = hits.select("query_id", "segment", "p.key", (F.col("p.weight") * F.col("query_weight")).alias("s"))
        if dead is not None:
            rows = rows.join(F.broadcast(dead) if few(dead) else dead, ["key", "segment"], "left_anti")
        return rows.groupBy("query_id", "key").agg(F.sum("s").alias("score"))

    first = cut(scored(placed.where(F.col("place") <= FIRST)))
    best = ranked(first, ["query_id"], "key").where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = placed.where(F.col("place") > FIRST).join(best, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    return ranked(first.unionByName(scored(rest)), ["query_id"], "key", k=k).select("query_id", F.col("key").alias(key), "score", "rank")


def merge_segments(spark: SparkSession, path: str, into: str, key: str = "doc_id") -> int:
    """Write the index anew, as one segment in another folder, without what was replaced."""
    known = segments(spark, path)
    rows = _union([_read(spark, path, s, "postings", key) for s in known]).select("term", "segment", F.explode("postings").alias("p")).select("term", "segment", "p.key", "p.weight")
    dead = _replaced(spark, path, known, key)
    live = rows if dead is None else rows.join(dead, ["key", "segment"], "left_anti")
    return add_segment(live.select(F.col("key").alias(key), "term", "weight"), into, key)
