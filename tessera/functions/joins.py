"""Joins whose keys may hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt_join(rows: DataFrame, side: DataFrame, key: str, other: str, each: int = 10_000) -> DataFrame:
    """Every row of ``rows``, beside its row of ``side`` (at most one per key) or nulls; null keys find nothing.

    The rows of a key go by the column ``other`` to as many places as hold about ``each`` of them; its row of ``side`` is
    copied to those places only. Keys of no more rows than that have one place.
    """
    places = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / each).cast("int").alias("__places")).where("__places > 1")
    hot = side.join(places, key, "left").withColumn("__place", F.explode(F.sequence(F.lit(0), F.coalesce("__places", F.lit(1)) - 1))).drop("__places")
    # rows without a key are dealt out too: they find nothing, but must not meet in one task
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(other), F.lit(1 << 30)).cast("int")).otherwise(F.coalesce(F.pmod(F.xxhash64(other), F.col("__places")), F.lit(0)).cast("int"))
    dealt = rows.join(F.broadcast(places), key, "left") if few(places) else rows.join(places, key, "left")
    return dealt.withColumn("__place", spread).drop("__places").join(hot, [key, "__place"], "left").drop("__place")


def few(side: DataFrame, most: int = 100_000) -> bool:
    """Whether a side has so few rows that it may go to every task."""
    return side.limit(most + 1).count() <= most
