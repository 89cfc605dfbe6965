"""Helpers that the operators share: tables, fresh column names, joins with hot keys, connected components, union-find."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.checkpoints import cut, ensure_checkpoint_dir, partitions

__all__ = ["Roots", "connected_components", "crc_mod", "cut", "ensure_checkpoint_dir", "fresh", "partitions", "salted_join", "small", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``, read by Spark wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows, of a few numbers each, up to which a side of a join goes to every task.
FEW = 1_000_000


def small(side: DataFrame, rows: Column | None = None) -> DataFrame:
    """``side`` (cut before) marked for broadcast if it is counted to be small, else as it is, for a shuffle join.

    ``rows`` says how much each row counts, where rows hold lists.
    """
    n = side.agg(F.coalesce(F.sum(rows if rows is not None else F.lit(1)), F.lit(0))).first()[0]
    return F.broadcast(side) if n <= FEW else side


def salted_join(rows: DataFrame, side: DataFrame, key: str, other: str, each: int = 256) -> DataFrame:
    """``rows`` joined with ``side`` (one row per key) on ``key``, where one key may hold very many rows.

    A key's rows are dealt out by the column ``other`` to as many places as hold about ``each`` of them, and its row of
    ``side`` is copied to those places only.
    """
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / each).cast("int").alias("__places"))
    copied = side.join(many, key).withColumn("__place", F.explode(F.sequence(F.lit(0), F.col("__places") - 1))).drop("__places")
    dealt = rows.join(many.where("__places > 1"), key, "left").withColumn("__place", F.coalesce(F.pmod(F.xxhash64(other), F.col("__places")), F.lit(0)).cast("int")).drop("__places")
    return dealt.join(copied, [key, "__place"]).drop("__place")


class Roots:
    """Union-find over array positions; unions come as whole arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int32)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        return r

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b = ra[apart], rb[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def forest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unite the pairs; positions of those in the least spanning forest, earlier pairs being shorter."""
        out, left = [], np.arange(len(a))
        while True:
            ra, rb = self.find(a[left]), self.find(b[left])
            apart = ra != rb
            left, ra, rb = left[apart], ra[apart], rb[apart]
            if not len(left):
                return np.sort(np.concatenate(out)) if out else left
            first = np.full(len(self.parent), len(a))
            np.minimum.at(first, ra, left)
            np.minimum.at(first, rb, left)
            used = np.unique(first[first < len(a)])
            out.append(used)
            self.union(a[used], b[used])

    def all(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent), dtype=np.int32))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links of type bigint -> (node, root): root is the smallest node that can be reached.

    Alternates the large-star and small-star rewrites until the links no longer change, which takes
    a number of rounds that grows with the logarithm of the longest path. Each round is written to the
    checkpoint folder. The smallest neighbour comes from a combined aggregate and a join, so that a
    node with very many links is never gathered into one row.
    """
    links = cut(edges.where("u <> v").select("u", "v").distinct())

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            near = df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(low, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    before = digest(links)
    while before[0]:
        links = cut(star(star(links, True), False))
        now = digest(links)
        if now == before:
            break
        before = now
    nodes = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots.join(nodes, "node", "left_anti"))
