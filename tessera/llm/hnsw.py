"""Nearest neighbours by cosine with a hierarchical navigable small-world graph in each shard.

Equal vectors are one node with its smallest ids. Nodes go to the nearest of the centres that a bounded sample gathers
around; a centre's nodes are dealt into shards of about ``SHARD`` by a hash. Each shard gets a layered graph: nodes are
put in by searching what stands so far, and it is held as flat arrays of neighbours and written as one row.

A query goes to the shards of its nearest centres only. How many that takes is measured: the exact neighbours of a bounded
sample of queries tell how far down its list of centres a query must go to find ``REACH`` of them. Blocks of queries travel
to the graphs; each search is a descent through the layers and a beam search on the ground layer, for all queries of a
block in step. The beam's best go through the exact measure in double precision, and shard results are merged.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .centroids import nearest_centres, spherical_means
from .common import cut, partitions, salted_join

SHARD = 2048
BLOCK = 512
#: Neighbours of a node, twice as many on the ground layer; candidates looked at when building, and when searching.
LINKS, BUILD, BEAM = 16, 64, 96
DOWN = 1 / 16
#: Bounds of the samples: vectors that centres are drawn from, and queries that tell how many centres to go to, so that this
#: part of their neighbours is reached.
SAMPLE, TUNE, REACH = 65_536, 256, 0.98


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def _layers(n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Nodes of each layer, ground first; a layer has about one in sixteen of the nodes below."""
    out = [np.arange(n)]
    while len(out[-1]) > LINKS:
        above = out[-1][rng.random(len(out[-1])) < DOWN]
        out.append(above if len(above) else out[-1][:1])
    return out


def _choose(x: np.ndarray, own: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each own node's candidates (nearest first, -1 for none) those nearer to it than to any chosen before, then the
    nearest of the rest."""
    out = np.full((len(near), most), -1, np.int64)
    for i in range(0, len(near), 256):
        cand, me = near[i : i + 256], own[i : i + 256]
        n, k = cand.shape
        points = x[np.maximum(cand, 0)]
        sim = np.where(cand >= 0, np.einsum("nkd,nd->nk", points, x[me]), -np.inf)
        chosen, count = out[i : i + n], np.zeros(n, np.int64)
        closest = np.full((n, k), -np.inf, x.dtype)
        for j in range(k):
            good = np.flatnonzero((closest[:, j] < sim[:, j]) & (count < most) & (cand[:, j] >= 0))
            if len(good):
                chosen[good, count[good]] = cand[good, j]
                count[good] += 1
                closest[good] = np.maximum(closest[good], np.matmul(points[good], points[good, j, :, None])[..., 0])
        for j in range(min(k, most)):
            more = np.flatnonzero((count < most) & (cand[:, j] >= 0))
            more = more[~(chosen[more] == cand[more, j : j + 1]).any(1)]
            chosen[more, count[more]] = cand[more, j]
            count[more] += 1
    return out


def _nearest_first(x: np.ndarray, own: np.ndarray, cand: np.ndarray, k: int) -> np.ndarray:
    """The k best of each row of candidates, without the node itself and without repeats."""
    s = np.where((cand >= 0) & (cand != own[:, None]), np.einsum("nkd,nd->nk", x[np.maximum(cand, 0)], x[own]), -np.inf)
    order = np.lexsort((cand, -s), axis=1)
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    again = np.zeros(cand.shape, bool)
    again[:, 1:] = cand[:, 1:] == cand[:, :-1]
    cand = np.where(np.isfinite(s) & ~again, cand, -1)
    order = np.argsort(cand < 0, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(cand, order, 1)


def _link(x: np.ndarray, links: np.ndarray, new: np.ndarray, cand: np.ndarray, most: int) -> None:
    """Link new nodes to chosen candidates, and back; a full node keeps those of its links that it would choose."""
    out = _choose(x, new, cand, most)
    links[new, :most] = out
    src, dst = np.repeat(new, most), out.reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    mutual = (links[dst] == src[:, None]).any(1)
    src, dst = src[~mutual], dst[~mutual]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    free = (links[dst] < 0).sum(1)
    fits = place < free
    links[dst[fits], links.shape[1] - free[fits] + place[fits]] = src[fits]
    full = np.unique(dst[~fits])
    if len(full):
        extra = np.full((len(full), int(place.max()) + 1), -1, np.int64)
        row = np.searchsorted(full, dst[~fits])
        extra[row, place[~fits] - free[~fits]] = src[~fits]
        both = np.concatenate((links[full], extra), 1)
        kept = _choose(x, full, _nearest_first(x, full, both, both.shape[1]), links.shape[1])
        links[full] = kept


def build(x: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, links) of each layer of a graph over unit vectors, ground first; links are rows of node numbers.

    Layers are made from the top. Into each, nodes go in growing batches: first those of the layer above, then the others;
    a batch is searched for in the layer as it stands, and its nodes also see each other.
    """
    sets = _layers(len(x), np.random.default_rng(seed))
    above: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(sets) - 1, -1, -1):
        most = LINKS if i == 0 else LINKS // 2
        links = np.full((len(x), 2 * most), -1, np.int64)
        upper = sets[i + 1] if i + 1 < len(sets) else sets[i][:0]
        order = np.concatenate((upper, np.setdiff1d(sets[i], upper, assume_unique=True)))
        done = min(len(order), 32)
        first = order[:done]
        _link(x, links, first, _nearest_first(x, first, np.broadcast_to(first, (done, done)), BUILD), most)
        while done < len(order):
            batch = order[done : done + max(16, done // 2)]
            found = search(x, [(order[:done], links), *above], x[batch], BUILD)[0]
            s = x[batch] @ x[batch].T
            np.fill_diagonal(s, -np.inf)
            n = min(BUILD, len(batch) - 1)
            if n > 0:
                found = np.concatenate((found, batch[np.argpartition(-s, n - 1, axis=1)[:, :n]]), 1)
            _link(x, links, batch, _nearest_first(x, batch, found, BUILD), most)
            done += len(batch)
        above.insert(0, (sets[i], links))
    return [(nodes.astype(np.int32), links[nodes].astype(np.int32)) for nodes, links in above]


def search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities of a beam for each query, best first; -1 where there are fewer nodes.

    Layers are (nodes, links), ground first, links a row for every vector.
    """
    m = len(q)
    at = np.repeat(layers[-1][0][:1], m).astype(np.int64)
    best = np.einsum("md,md->m", x[at], q)
    for _, links in layers[:0:-1]:
        moving = np.arange(m)
        while len(moving):
            near = links[at[moving]]
            s = np.where(near >= 0, np.einsum("mkd,md->mk", x[np.maximum(near, 0)], q[moving]), -np.inf)
            j = s.argmax(1)
            better = s[np.arange(len(moving)), j] > best[moving]
            moving, near, s, j = moving[better], near[better], s[better], j[better]
            at[moving], best[moving] = near[np.arange(len(moving)), j], s[np.arange(len(moving)), j]
    links = layers[0][1]
    beam = min(beam, len(x))
    found, score = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, x.dtype)
    opened = np.zeros((m, beam), bool)
    seen = np.zeros((m, len(x)), bool)
    found[:, 0], score[:, 0] = at, best
    seen[np.arange(m), at] = True
    live = np.arange(m)
    while len(live):
        todo = np.where(opened[live] | (found[live] < 0), -np.inf, score[live])
        j = todo.argmax(1)
        go = todo[np.arange(len(live)), j] > -np.inf
        live, j = live[go], j[go]
        if not len(live):
            break
        opened[live, j] = True
        near = links[found[live, j]]
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        s = np.full(near.shape, -np.inf, x.dtype)
        s[r, c] = np.einsum("kd,kd->k", x[near[r, c]], q[live[r]])
        all_s, all_f = np.concatenate((score[live], s), 1), np.concatenate((found[live], np.where(new, near, -1)), 1)
        all_o = np.concatenate((opened[live], np.zeros(s.shape, bool)), 1)
        keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        score[live], found[live], opened[live] = (np.take_along_axis(a, keep, 1) for a in (all_s, all_f, all_o))
    order = np.argsort(-score, axis=1, kind="stable")
    found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
    return np.where(np.isfinite(score), found, -1), score


def _dump(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(1, keepdims=True)
    v = v / big
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision; components are scaled by a power of two where squares would overflow or vanish."""
    q, v = (a * np.exp2(-np.frexp(np.abs(a).max(-1, keepdims=True))[1]) for a in (q, v))
    return (q * v).sum(-1) / (np.sqrt((q * q).sum(-1)) * np.sqrt((v * v).sum(-1)))


def _full(n: int, nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    links = np.full((n, rows.shape[1]), -1, np.int32)
    links[nodes] = rows
    return links


def _graphs(k: int):
    """(shard, vector, ids) -> (shard, graph); a shard's rows come together, as they were dealt by it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            for shard, vector, ids in zip(b.shard, b.vector, b.ids, strict=True):
                held.setdefault(shard, []).append((vector, ids))
        for shard, rows in held.items():
            v = np.array([np.frombuffer(a, "<f8") for a, _ in rows])
            ids = np.full((len(rows), k + 1), -1, np.int64)
            for i, (_, x) in enumerate(rows):
                ids[i, : len(x)] = x
            order = np.lexsort((ids[:, 0],))
            v, ids = v[order], ids[order]
            layers = build(_unit(v), len(v))
            parts = {f"{kind}{i}": a for i, pair in enumerate(layers) for kind, a in zip(("nodes", "links"), pair, strict=True)}
            yield pd.DataFrame({"shard": [shard], "graph": [_dump(v=v, ids=ids, layers=np.array([len(layers)]), **parts)]})

    return run


def _search_pairs(k: int, beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for graph, block in zip(b.graph, b.block_data, strict=True):
                g, q = np.load(io.BytesIO(graph)), np.load(io.BytesIO(block))
                v, ids, qv, qid = g["v"], g["ids"], q["v"], q["ids"]
                layers = [(g[f"nodes{i}"], _full(len(v), g[f"nodes{i}"], g[f"links{i}"])) for i in range(int(g["layers"][0]))]
                found, _ = search(_unit(v), layers, _unit(qv), beam)
                r, c = np.nonzero(found >= 0)
                s = cosine(qv[r], v[found[r, c]])
                near = ids[found[r, c]]
                row, col = np.nonzero((near >= 0) & (near != qid[r][:, None]))
                out = pd.DataFrame({"query_id": qid[r][row], "vec_id": near[row, col], "score": s[row]})
                out = out.drop_duplicates(["query_id", "vec_id"]) if len(np.unique(qid)) == len(qid) else out.groupby(["query_id", "vec_id"], as_index=False).score.max()
                out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                yield out.groupby("query_id", sort=False).head(k)

    return run


def _first_ids(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("vec_id")
            out = b.groupby(["dim", "vector"], sort=False).vec_id.agg(lambda x: x.tolist()[: k + 1]).reset_index(name="ids")
            yield out[["dim", "vector", "ids"]]

    return run


def _vectors(column) -> np.ndarray:
    return np.array([np.frombuffer(x, "<f8") for x in column])


def _cells(centres: dict[int, np.ndarray], probes: dict[int, int] | None, name: str):
    """(dim, vector, ...) -> with the cells (dim, centre) of each: one, or as many as are probed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                at = nearest_centres(_unit(_vectors(part.vector)), centres[dim], probes[dim] if probes else 1)[0]
                for j in range(at.shape[1]):
                    yield part.assign(cell=at[:, j])[["dim", "cell", "vector", name]]

    return run


def _exact(asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """(dim, vector, ids, cell) -> (dim, query, cell, score): the k nearest nodes of each query in these rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                q, own = asked[dim]
                s = _unit(q) @ _unit(_vectors(part.vector)).T
                first = np.array([x[0] for x in part.ids])
                s[own[:, None] == first] = -np.inf
                n = min(k, s.shape[1])
                top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(n), (len(q), n))
                yield pd.DataFrame({"dim": dim, "query": np.repeat(np.arange(len(q)), n), "cell": part.cell.to_numpy()[top].reshape(-1), "score": np.take_along_axis(s, top, 1).reshape(-1).astype(float)})

    return run


def _probes(nodes: DataFrame, asked: DataFrame, centres: dict[int, np.ndarray], k: int) -> dict[int, int]:
    """How many centres a query must go to: measured on up to TUNE queries of each length against all rows."""
    n = {r.dim: r.n for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20))
    held: dict[int, list] = {d: [] for d in n}
    for d in n:  # vectors of different lengths: a handful
        for r in asked.where(F.col("dim") == d).where(draw < int(min(1.0, TUNE / n[d]) * (1 << 20))).limit(2 * TUNE).collect():
            held[d].append((np.frombuffer(r.vector, "<f8"), r.vec_id))
    queries = {d: (np.array([v for v, _ in x]), np.array([i for _, i in x])) for d, x in held.items() if x}
    out = {d: len(centres[d]) for d in centres}
    if not queries:
        return out
    near = nodes.where(F.col("dim").isin(list(queries))).select("dim", "vector", "ids", "cell").mapInPandas(_exact(queries, k), "dim int, query bigint, cell bigint, score double")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("dim", "query").orderBy(F.desc("score"), "cell"))).where(F.col("rank") <= k)
    ranks: dict[int, list[int]] = {}
    for r in best.collect():  # at most 2 * TUNE * k rows of each length
        order = nearest_centres(_unit(queries[r.dim][0][r.query : r.query + 1]), centres[r.dim], len(centres[r.dim]))[0][0]
        ranks.setdefault(r.dim, []).append(int(np.flatnonzero(order == r.cell)[0]) + 1)
    return out | {d: int(np.sort(x)[min(int(REACH * len(x)), len(x) - 1)]) for d, x in ranks.items()}


def nearest(vectors: DataFrame, queries: Column, k: int = 5, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k nearest found of each query, by cosine.

    ``queries`` is a condition on vec_id. Candidates are all rows but those of the query's own vec_id; ties go to the
    smaller vec_id. Vectors that are null, zero, or hold null or non-finite components take no part, and vectors of
    different lengths never meet. Rows that share vec_id and vector count once; a vec_id with several vectors is each of
    them, and its nearest one is what counts. Other columns are not looked at. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    doubles = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL").where(usable(F.col("v"))).select("vec_id", "v", F.size("v").alias("dim"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # adding zero makes one of both zeros
            yield pa.record_batch({"vec_id": b.column(0), "dim": b.column(2), "vector": pa.array([(np.array(x.values, "<f8") + 0.0).tobytes() for x in b.column(1)], pa.binary())})

    packed = doubles.mapInArrow(pack, "vec_id bigint, dim int, vector binary")
    first = packed.mapInPandas(_first_ids(k), "dim int, vector binary, ids array<bigint>")
    nodes = cut(first.groupBy("dim", "vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")))
    asked = cut(packed.where(queries).distinct())
    centres: dict[int, np.ndarray] = {}
    for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect():  # a row per length of vectors
        drawn = nodes.where(F.col("dim") == r.dim).where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / r.n) * (1 << 30)))
        sample = [np.frombuffer(x.vector, "<f8") for x in drawn.select("vector").limit(2 * SAMPLE).collect()]  # SAMPLE on the average
        if sample:
            centres[r.dim] = spherical_means(_unit(np.array(sample)), min(-(-r.n // shard), max(1, len(sample) // 16)))
        else:
            centres[r.dim] = np.zeros((1, r.dim), np.float32)
    placed = cut(nodes.mapInPandas(_cells(centres, None, "ids"), "dim int, cell bigint, vector binary, ids array<bigint>"))
    probes = _probes(placed, asked, centres, k)
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    at = F.xxhash64("dim", "cell", "part")
    dealt = placed.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")).select(at.alias("shard"), "vector", "ids")
    n = max(1, -(-nodes.count() // shard))
    graphs = cut(dealt.repartition(n, "shard").mapInPandas(_graphs(k), "shard bigint, graph binary"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, part in b.groupby("shard"):
                for i in range(0, len(part), BLOCK):
                    p = part.iloc[i : i + BLOCK]
                    yield pd.DataFrame({"shard": [s], "block_data": [_dump(v=_vectors(p.vector), ids=p.vec_id.to_numpy())]})

    routed = asked.mapInPandas(_cells(centres, probes, "vec_id"), "dim int, cell bigint, vector binary, vec_id bigint").join(sizes, ["dim", "cell"])
    routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(at.alias("shard"), "vector", "vec_id")
    asks = routed.repartition(partitions(spark), "shard", F.pmod(F.xxhash64("vec_id"), F.lit(8))).mapInPandas(blocks, "shard bigint, block_data binary")
    # queries travel; a graph is copied only where very many of them meet it
    pairs = salted_join(cut(asks), graphs, "shard", "block_data", 16).select("graph", "block_data")
    found = pairs.mapInPandas(_search_pairs(k, beam), "query_id bigint, vec_id bigint, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
