"""Tables of documents, chunks and vectors without a table format: keyed upserts, deletes, listings, exact dense search.

Each operation gives the new rows; the caller writes them to a new version's folder and turns to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessera.functions.checkpoints import cut


def latest(rows: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """Of the rows of each key the one with the greatest ``at``. Rows are combined before they are dealt out by key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("__r"))
    return best.select(*[F.col(c) if c in keys else F.col("__r")[c].alias(c) for c in rows.columns])


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``base`` with ``changes`` put in by key; columns in ``keep`` hold on to the base's values where a row was there.

    ``changes`` has one row per key (see ``latest``) and the columns of ``base``.
    """
    old = base.select(*keys, F.lit(True).alias("__old"), *[F.col(c).alias(f"__{c}") for c in keep])
    put = changes.join(old, list(keys), "left").select(*[F.when(F.col("__old"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in base.columns])
    return base.join(changes.select(*keys), list(keys), "left_anti").select(*base.columns).unionByName(put)


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not among ``gone``."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def cascade_delete(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents in ``gone`` and all that is theirs."""
    return without(documents, gone, [key]), without(chunks, gone, [key]), without(vectors, gone, [key])


def list_documents(documents: DataFrame, by: Sequence[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of documents, with the number of all of them."""
    if not 1 <= limit <= 1000:
        raise ValueError("the limit lies in 1..1000")
    total = documents.agg(F.count("*").alias("total"))
    return documents.orderBy(*by).offset(offset).limit(limit).join(F.broadcast(total))  # one row


#: Queries of one search; more are taken in several searches.
MOST_QUERIES = 4096


def _nearest(asked: Sequence[tuple], k: int, key: str, column: str, query: str):
    ids = np.array([i for i, _ in asked], np.int64)
    q = np.array([v for _, v in asked], np.float64).reshape(len(asked), -1)

    norms = np.sqrt((q * q).sum(1))
    able = np.flatnonzero(norms > 0)
    unit = q[able] / norms[able, None]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top_s, top_k = np.full((len(able), 0), -np.inf), np.empty((len(able), 0), np.int64)
        for b in batches:
            b = b[b[column].map(lambda x: x is not None and len(x) == q.shape[1])]
            if not len(b) or not len(able):
                continue
            keys, v = b[key].to_numpy(), np.array(b[column].tolist(), np.float64)
            sizes = np.sqrt((v * v).sum(1))
            keys, v = keys[sizes > 0], v[sizes > 0] / sizes[sizes > 0, None]
            for i in range(0, len(v), 4096):  # one product for all queries; ties at the cut are settled by the smaller key
                s = np.concatenate((top_s, unit @ v[i : i + 4096].T), 1)
                k_ = np.concatenate((top_k, np.broadcast_to(keys[i : i + 4096], (len(able), len(v[i : i + 4096])))), 1)
                if s.shape[1] > k:
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
                    s = np.where(s >= least - 1e-12, s, -np.inf)
                order = np.lexsort((k_, -s), axis=1)[:, :k]
                top_s, top_k = np.take_along_axis(s, order, 1), np.take_along_axis(k_, order, 1)
        if top_s.size:
            ok = np.isfinite(top_s)
            yield pd.DataFrame({query: np.broadcast_to(ids[able][:, None], top_s.shape)[ok], key: top_k[ok], "score": top_s[ok]})

    return score


def _best(hits: DataFrame, order: WindowSpec, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_top_k_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", query: str = "query_id") -> DataFrame:
    """The k rows nearest by cosine to each of a stated set of queries: (query, key, score, rank).

    The queries (query, column) go to every task in blocks of ``MOST_QUERIES``, a search each; with several blocks each
    search is written to the checkpoint folder before the next. A task scores its rows in blocks and
    keeps k per query, so what is shuffled does not grow with a task's rows. Null and zero vectors, and those of another
    length than the queries', take no part. Ties go to the smaller key.
    """
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), column)
    schema, order = f"{query} bigint, {key} bigint, score double", Window.partitionBy(query).orderBy(F.desc("score"), key)
    blocks = batched(queries.where(F.col(column).isNotNull()).select(query, column).toLocalIterator(), MOST_QUERIES)
    block, hits = next(blocks, None), None
    while block:
        following = next(blocks, None)
        found = rows.mapInPandas(_nearest(block, k, key, column, query), schema)
        if following or hits is not None:  # a block's vectors are not held longer than its search
            found = cut(_best(found, order, k).drop("rank"))
        hits = found if hits is None else hits.unionByName(found)
        block = following
    if hits is None:
        return vectors.sparkSession.createDataFrame([], f"{query} bigint, {key} bigint, score double, rank int")
    return _best(hits, order, k)
