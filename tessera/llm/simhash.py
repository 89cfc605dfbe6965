"""SimHash fingerprints, and exact search for pairs within a few bits by vantage-point trees over overlapping shards.

Fingerprints have 64 bits. Of a pair that differs in at most 3 bits, one half differs in at most one. Over each half a
vantage-point tree, drawn from a bounded sample, deals all fingerprints out by their Hamming distance to vantage points:
a leaf of the tree is a shard. A fingerprint so near to a border that the triangle inequality allows a partner beyond it
also visits the shards there. Each shard goes on with a tree of its own; every pair within 3 bits meets in one.

Only links that join two parts not yet joined leave a shard, so that a group of n copies gives fewer than n links.

``near_duplicates`` links by similarity instead: 256 bits over sets of shingles of five words, of which two texts differ
in a share that follows the angle between their sets. The trees find the links within 3 of the first 64 bits. At the
distances of the others no border prunes anything, so further candidates come from tables of drawn bits, as many as a
stated recall needs. Each link is checked against the two sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Roots, connected_components, cut, fresh, partitions, salted_join, small
from .windows import mix

#: Bound of the sample that the trees across shards are drawn from, and fingerprints that a shard is meant to hold.
SAMPLE, SHARD = 65_536, 4096
#: Fingerprints in a shard above which it is compared part by part in several tasks.
FULL = 16_384
LEAF = 128


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words; words are runs without ASCII white space, A-Z in lower case.

    Repeats count. Fewer than k words: one hash of all of them. No word: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    k = min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    f = xxhash.xxh64_intdigest
    return np.array([f(flat[s:e], 42) for s, e in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Bit i is 1 if it is set in over half the rows of hashes, a word of bits per column; 0 without rows."""
    hashes = hashes[:, None] if hashes.ndim == 1 else hashes
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[i : i + 8192])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of each row of (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), k))[0] for t in b.column(1)], np.uint64)
            yield pa.record_batch({"doc_id": b.column(0), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


# ---- exact links within a few bits


class Tree:
    """A vantage-point tree over words of bits, whose leaves are shards."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int):
        self.radius = radius
        self.vantage: list[int] = []
        self.mu: list[int] = []
        self.near: list[int] = []
        self.far: list[int] = []  # inner nodes count from 0, leaves from -1 down
        self.leaves = 0
        rng = np.random.default_rng(len(sample))

        def grow(x: np.ndarray) -> int:
            best = None
            for v in x[rng.integers(0, len(x), 4)] if len(x) > leaf else ():
                d = np.bitwise_count(x ^ v)
                mu = int(np.median(d))
                mu -= int((d <= mu).all())
                halves, border = np.count_nonzero(d <= mu), np.count_nonzero((d > mu - radius) & (d <= mu + radius))
                cost = max(halves, len(x) - halves) + border / 2
                if 0 < halves < len(x) and (best is None or cost < best[0]):
                    best = cost, v, mu, d <= mu
            if best is None:
                self.leaves += 1
                return -self.leaves
            i = len(self.mu)
            self.vantage.append(int(best[1]))
            self.mu.append(best[2])
            self.near.append(0)
            self.far.append(0)
            self.near[i], self.far[i] = grow(x[best[3]]), grow(x[~best[3]])
            return i

        self.root = grow(sample) if len(sample) else -1
        self.leaves = max(self.leaves, 1)

    def shards(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(positions of x, shard, home): each value's own shard once, and the shards that it visits."""
        vantage, mu = np.array(self.vantage, np.uint64), np.array(self.mu, np.int64)
        near, far = np.array(self.near, np.int64), np.array(self.far, np.int64)
        at, node, home = np.arange(len(x)), np.full(len(x), self.root), np.ones(len(x), bool)
        while len(at):
            done = node < 0
            for h in (True, False):
                pick = done & (home == h)
                if pick.any():
                    yield at[pick], -1 - node[pick], h
            at, node, home = at[~done], node[~done], home[~done]
            if not len(at):
                return
            d, m = np.bitwise_count(x[at] ^ vantage[node]).astype(np.int64), mu[node]
            # |d(x, v) - d(y, v)| <= d(x, y): home rows go to one side, and beyond it from the inner edge of the border
            inner = d <= m
            to_near, to_far = np.where(home, inner, d <= m + self.radius), np.where(home, ~inner, d > m - self.radius)
            visit = home & inner & (d > m - self.radius)
            at, node, home = (
                np.concatenate((at[to_near], at[to_far], at[visit])),
                np.concatenate((near[node[to_near]], far[node[to_far]], far[node[visit]])),
                np.concatenate((home[to_near], home[to_far], np.zeros(int(visit.sum()), bool))),
            )


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds the words of a fingerprint."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def vp_join(half: np.ndarray, reach: int, fps: np.ndarray, radius: int, union, home: np.ndarray | None = None) -> None:
    """Call union(i, j) with arrays of positions for all pairs within ``reach`` by ``half`` and ``radius`` by ``fps``.

    With ``home``, pairs of which neither row is at home are left out.
    """

    def brute(a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 512):
            x, y = np.nonzero(np.bitwise_count(fps[a[i : i + 512], None] ^ fps[None, b]) <= radius)
            if len(x):
                union(a[i : i + 512][x], b[y])

    own = np.arange(len(fps)) if home is None else np.flatnonzero(home)
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(own, None)]
    if home is not None:
        todo.append((np.flatnonzero(~home), own))
    while todo:
        a, b = todo.pop()
        other = a if b is None else b
        if not len(a) or not len(other):
            continue
        if len(a) * len(other) <= LEAF * LEAF:
            brute(a, other)
            continue
        v = half[other[len(other) // 2]]
        da = np.bitwise_count(half[a] ^ v).astype(np.int64)
        db = da if b is None else np.bitwise_count(half[b] ^ v).astype(np.int64)
        mu = int(np.median(db))
        mu -= int((db <= mu).all())
        near_a, near_b = da <= mu, db <= mu
        parts = [(a[near_a], other[near_b]), (a[~near_a], other[~near_b])]
        across = [(a[near_a & (da > mu - reach)], other[~near_b & (db <= mu + reach)])]
        if b is not None:
            across.append((a[~near_a & (da <= mu + reach)], other[near_b & (db > mu - reach)]))
        if max(len(x) * len(y) for x, y in [*parts, *across]) > 0.9 * len(a) * len(other):
            brute(a, other)
            continue
        todo += [(x, None if b is None else y) for x, y in parts] + across


def by_key(columns: int, work):
    """A function for mapInArrow over rows of bigints sorted by the first: ``work`` gets all rows of whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            rows = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)])
            if not len(rows):
                continue
            at = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last key may go on in the next batch
            if at or held and held[-1][-1, 0] != rows[0, 0]:
                yield from work(np.concatenate([*held, rows[:at]]))
                held = []
            held.append(rows[at:])
        if held:
            yield from work(np.concatenate(held))

    return run


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    starts = np.concatenate(([0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]))
    return list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))


def _link_shards(radius: int, reach: int):
    """Rows (key, home, fp), the key's lowest bit the half -> (u, v): links within ``radius``."""

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, e in _spans(rows[:, 0]):
            home, fp = rows[s:e, 1], rows[s:e, 2].view(np.uint64)
            half = fp >> np.uint64(32) if rows[s, 0] & 1 else fp & np.uint64(0xFFFFFFFF)
            roots = Roots(len(fp))
            vp_join(half, reach, fp, radius, roots.union, home == 1)
            r = roots.all()
            moved = np.nonzero(r != np.arange(len(r)))[0]
            if len(moved):
                yield pa.record_batch({"u": pa.array(fp[moved].view(np.int64)), "v": pa.array(fp[r[moved]].view(np.int64))})

    return by_key(3, work)


def links(distinct: DataFrame, radius: int = 3, shard: int = SHARD, full: int = FULL) -> DataFrame:
    """(fp), each once -> (u, v) links whose components are those of all pairs within ``radius`` bits."""
    spark, reach = distinct.sparkSession, radius // 2
    n = distinct.count()
    drawn = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    sample = np.array([r.fp for r in drawn.limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)  # SAMPLE on the average
    sample.sort()
    leaf = max(8, shard * len(sample) // max(n, 1))
    trees = [Tree(h, leaf, reach) for h in (sample & np.uint64(0xFFFFFFFF), sample >> np.uint64(32))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for side, tree in enumerate(trees):
                for at, leaf, home in tree.shards(fp >> np.uint64(32) if side else fp & np.uint64(0xFFFFFFFF)):
                    yield pa.record_batch({"key": pa.array(leaf * 2 + side), "home": pa.array(np.full(len(at), int(home))), "fp": pa.array(fp[at].view(np.int64))})

    rows = distinct.select("fp").mapInArrow(deal, "key bigint, home bigint, fp bigint")
    # a row per shard, of which there are at most SAMPLE / 4
    sizes = {r.key: r.n for r in rows.where("home = 1").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > full).collect()}
    if sizes:
        # all pairs of parts of such a shard are compared, each in a task of its own; parts are drawn by a hash
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, c in sizes.items() for x in (k, -(-c // full))]), F.col("key")), F.lit(1))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pair = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("pair"), F.col("home").alias("role")))).when(
            F.col("home") == 1,
            F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
                (F.least(F.col("own"), j) * F.col("parts") + F.greatest(F.col("own"), j)).cast("int").alias("pair"),
                F.when(F.col("own") <= j, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("role"),
            )),
        ).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct((j * F.col("parts") + j).cast("int").alias("pair"), F.lit(0).cast("bigint").alias("role"))))
        split = rows.withColumn("parts", parts).withColumn("own", own).select("key", "fp", F.explode(pair).alias("p"))
        rows = split.select((F.shiftleft(F.col("p.pair").cast("bigint"), 20) * 2 + F.col("key")).alias("key"), F.col("p.role").alias("home"), "fp")
    dealt = rows.repartition(partitions(spark), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_link_shards(radius, reach), "u bigint, v bigint")


def near_groups(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp) rows -> (doc_id, fp, component_id): the smallest doc_id that links of ``radius`` bits reach.

    Equal fingerprints are one node, whatever their number. ``fps`` should be cut, as it is read three times.
    """
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = cut(connected_components(links(distinct.select("fp"), radius)).withColumnsRenamed({"node": "fp"}))
    linked = comp.join(distinct, "fp")
    low = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(linked, low, "root", "fp").select("fp", "component_id")
    alone = distinct.join(comp, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    return fps.join(named.unionByName(alone), "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id), one row per row of ``docs``.

    Null and empty texts and texts of white space have fingerprint zero and link like any other. Other columns of
    ``docs`` are not looked at. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, k))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(fps, radius).select("doc_id", hexed.alias("fingerprint"), "component_id")


# ---- near duplicates by similarity

#: Bits by which candidates may differ (of 256; a similarity of 0.8 gives 39, give or take 6), least bits of a table's
#: key, part of the pairs of similarity 0.8 that meet in no table, rows of a key that are compared in one task.
LIMIT, BITS, MISSED, GROUP = 54, 6, 0.03, 1024
#: Rows of a key up to which keys are compared many at once.
SMALL = 32
#: Bytes of shingle sets and pairs that are checked together; shingles that are compared at once.
BLOCK, PAIRS, COLUMNS = 16 << 20, 8192, 8192


def wide_fingerprints(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, text) -> (doc_id, node, f0, f1, f2, f3): 256 bits over the set of shingles of k words, from four mixes of
    their hashes, and a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)) for t in b.column(1)]
            wide = np.array([fingerprint(mix(h[:, None] + np.arange(4, dtype=np.uint64))) for h in sets], np.uint64).reshape(-1, 4).view(np.int64)
            words = {f"f{i}": pa.array(wide[:, i]) for i in range(4)}
            node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": b.column(0), "node": pa.array(node), **words})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, node bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(text) -> (node, shingles): the sorted set of shingle hashes and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)).tobytes() for t in b.column(0)]
            node = np.array([xxhash.xxh64_intdigest(h) for h in sets], np.uint64).view(np.int64)
            yield pa.record_batch({"node": pa.array(node), "shingles": pa.array(sets, pa.binary())})

    return docs.select("text").mapInArrow(run, "node bigint, shingles binary")


def layout(n: int, similarity: float = 0.8, missed: float = MISSED) -> tuple[int, int]:
    """(bits of a key, number of tables) for n fingerprints: keys hold some hundreds of rows, and but for ``missed`` of them
    all pairs of that similarity that differ in at most ``LIMIT`` bits are expected to share a key, at any size."""
    bits = max(BITS, math.ceil(math.log2(max(n, 2))) - 9)
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    weight = [math.comb(256, d) * p**d * (1 - p) ** (256 - d) for d in range(LIMIT + 1)]
    share = [math.comb(256 - d, bits) / math.comb(256, bits) for d in range(LIMIT + 1)]
    tables = 1
    while sum(w * (1 - s) ** tables for w, s in zip(weight, share, strict=True)) > missed * sum(weight):
        tables += max(1, tables // 32)
    return bits, tables


def _drawn(bits: int, tables: int) -> list[np.ndarray]:
    """The bits that each table draws."""
    rng = np.random.default_rng(7)
    return [rng.choice(256, bits, replace=False) for _ in range(tables)]


def _table_keys(bits: int, tables: int):
    """(node, comp, words) -> a row per table, keyed by the table's number over the bits that it draws."""
    drawn = _drawn(bits, tables)
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]).view(np.uint64)
            set_ = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            for t, d in enumerate(drawn):
                yield pa.record_batch([pa.array(set_[:, d].astype(np.int64) @ weights + (t << bits)), *b.columns], names=["key", *b.schema.names])

    return run


def _near_pairs(limit: int, f: np.ndarray, comp: np.ndarray, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a key, a block of rows and a word of the fingerprints at a time; small numbers, as there can be many."""
    words = np.ascontiguousarray(f.T)
    out = [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint8))]
    for i in range(0, len(f) - 1, 256):
        d = sum((np.bitwise_count(w[i : i + 256, None] ^ w[i + 1 :]) for w in words), np.uint16(0))
        x, y = np.nonzero(d <= limit)
        ok = y >= x  # columns start one behind the block's first row
        x, y = x[ok], y[ok]
        a, b = x + i, y + i + 1
        ok = comp[a] != comp[b]
        if apart is not None:
            ok &= apart[a] != apart[b]
        out.append((a[ok].astype(np.int32), b[ok].astype(np.int32), d[x[ok], y[ok]].astype(np.uint8)))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _candidates(limit: int):
    """Rows (key, part, node, comp, words) sorted by key and part -> (u, v, place): pairs within ``limit`` of different comps.

    Of a key come the pairs of a least spanning forest by distance. A row (u, null, null) tells that u has more. Rows of part -1 - p are compared with those of part p.
    """

    def pick(nodes: np.ndarray, comp: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(d.astype(np.uint8), kind="stable")  # pairs come in the order of their nodes
        a, b = a[order], b[order]
        place = np.unique(comp, return_inverse=True)[1]
        keep = np.zeros(len(a), bool)
        keep[Roots(int(place.max()) + 1).forest(place[a], place[b])] = True
        return order[keep], np.unique(np.concatenate((a[~keep], b[~keep])))

    def at_once(key: np.ndarray, part: np.ndarray, comp: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of all keys of up to SMALL rows, each row compared with the next ones of its key, at once."""
        out = [(np.empty(0, np.int64),) * 3]
        for step in range(1, SMALL):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                break
            other = same + step
            ok = (comp[same] != comp[other]) & ((part[same] >= 0) | (part[same] != part[other]))
            same, other = same[ok], other[ok]
            d = _apart(f[same], f[other])
            hit = d <= limit
            out.append((same[hit], other[hit], d[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, part, nodes, comp, f = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4:].view(np.uint64)
        us, vs, places, more = ([np.empty(0, np.int64)] for _ in range(4))

        def send(at: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
            kept, rest = pick(nodes[at], comp[at], a, b, d)
            us.append(nodes[at][a[kept]])
            vs.append(nodes[at][b[kept]])
            places.append(key[at][a[kept]])
            more.append(nodes[at][rest])

        spans = np.array(_spans(key))
        size = spans[:, 1] - spans[:, 0]
        at = np.flatnonzero(np.repeat(size <= SMALL, size))
        a, b, d = at_once(key[at], part[at], comp[at], f[at])
        a, b = at[a], at[b]
        order = np.argsort(key[a], kind="stable")
        a, b, d = a[order], b[order], d[order]
        for s, e in _spans(key[a]) if len(a) else ():
            if e - s == 1:
                us.append(nodes[a[s:e]])
                vs.append(nodes[b[s:e]])
                places.append(key[a[s:e]])
            else:
                of_key = np.unique(np.concatenate((a[s:e], b[s:e])))
                send(of_key, np.searchsorted(of_key, a[s:e]), np.searchsorted(of_key, b[s:e]), d[s:e])
        for s, e in spans[size > SMALL].tolist():
            a, b, d = _near_pairs(limit, f[s:e], comp[s:e], part[s:e] if part[s:e].min() < 0 else None)
            if len(a):
                send(np.arange(s, e), a, b, d)
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield pa.record_batch({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v)), "place": pa.array(np.concatenate(places))})
        open_ = np.unique(np.concatenate(more))
        if len(open_):
            yield pa.record_batch({"u": pa.array(open_), "v": pa.nulls(len(open_), pa.int64()), "place": pa.nulls(len(open_), pa.int64())})

    return by_key(8, work)


def _masks(bits: int, tables: int) -> np.ndarray:
    """The bits that each table draws, as words of a fingerprint."""
    set_ = np.zeros((tables, 256), np.uint8)
    for t, d in enumerate(_drawn(bits, tables)):
        set_[t, d] = 1
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64)


def _met_here(limit: int, masks: np.ndarray, table: int, part: np.ndarray, comp: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a place, nearest first, that differ in up to ``limit`` bits, are of different comps, and share no earlier
    table's key: each pair of the corpus is met so in one place."""
    a, b, d = _near_pairs(limit, f, comp, part if part.min() < 0 else None)
    for m in masks[:table]:
        apart = np.zeros(len(a), bool)
        for w in np.flatnonzero(m):
            apart |= (f[a, w] ^ f[b, w]) & m[w] != 0
        a, b, d = a[apart], b[apart], d[apart]
    order = np.argsort(d, kind="stable")
    return a[order], b[order]


def _asked(limit: int, masks: np.ndarray):
    """Rows (place, part, at, node, comp, words) sorted by place -> (place, node) of those in a pair met there."""

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, e in _spans(rows[:, 0]):
            if e - s > 1:
                a, b = _met_here(limit, masks, int(rows[s, 2]), rows[s:e, 1], rows[s:e, 4], rows[s:e, 5:].view(np.uint64))
                at = np.unique(np.concatenate((a, b)))
                if len(at):
                    yield pa.record_batch({"place": pa.array(rows[s:e, 0][at]), "node": pa.array(rows[s:e, 3][at])})

    return by_key(9, work)


def _similar_here(limit: int, masks: np.ndarray, similarity: float):
    """Rows (place, part, at, node, comp, words, shingles) sorted by place -> (u, v): links, by checked pairs, between the
    comps of a place, fewer than it has rows. The sets of one place are held at a time."""

    def links_of(rows: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        comp = np.unique(rows[:, 4], return_inverse=True)[1]
        a, b = _met_here(limit, masks, int(rows[0, 2]), rows[:, 1], rows[:, 4], rows[:, 5:].view(np.uint64))
        size = np.array([len(x) for x in sets])
        ok = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[ok], b[ok]
        # of shingles that stand in one set only nothing is shared
        ids, of, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(n > 1) - 1
        owner, keep = np.repeat(np.arange(len(sets)), size), n[of] > 1
        owner, of = owner[keep], shared[of[keep]]
        width = int((n > 1).sum())
        roots, us, vs = Roots(int(comp.max()) + 1), [], []
        step = 256
        while len(a):
            x, y, a, b = a[:step], b[:step], a[step:], b[step:]
            apart = roots.find(comp[x]) != roots.find(comp[y])
            x, y = x[apart], y[apart]
            if len(x):
                both = np.zeros(len(x), np.int64)
                if width // COLUMNS < 32:
                    for c in range(0, width, COLUMNS):
                        inside = (of >= c) & (of < c + COLUMNS)
                        bits = np.zeros((len(sets), COLUMNS), np.uint8)
                        bits[owner[inside], of[inside] - c] = 1
                        bits = np.packbits(bits, axis=1).view(np.uint64)
                        for k in range(0, len(x), 4096):
                            both[k : k + 4096] += np.bitwise_count(bits[x[k : k + 4096]] & bits[y[k : k + 4096]]).sum(1, dtype=np.int64)
                else:
                    both[:] = [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                good = both >= similarity * (size[x] + size[y] - both) - 1e-9
                x, y = x[good], y[good]
                used = roots.forest(comp[x], comp[y]) if len(x) else []
                us += rows[x[used], 3].tolist() if len(x) else []
                vs += rows[y[used], 3].tolist() if len(x) else []
            step *= 4
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        sets: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            us, vs = links_of(np.array(rows), sets)
            return pa.record_batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

        for b in batches:
            numbers = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(9)])
            for r, held in zip(numbers, b.column(9), strict=True):
                if rows and rows[-1][0] != r[0]:
                    yield done()
                    rows, sets = [], []
                rows.append(r.copy())
                sets.append(np.frombuffer(held.as_buffer(), np.uint64).copy())  # a view would hold the whole batch
        if rows:
            yield done()

    return run


def _similar(similarity: float):
    """Rows (block, u, null, shingles), then (block, u, v, null), sorted by block -> (u, v) of the pairs whose sets have at
    least that Jaccard similarity. The sets of one block are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for b in batches:
            us, vs = [], []
            for at, u, v, held in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if at != block:
                    block, sets = at, {}
                if v is None:
                    sets[u] = np.frombuffer(held.as_buffer(), np.uint64).copy()  # a view would hold the whole batch
                    continue
                p, q = sets[u], sets[v]
                if min(len(p), len(q)) < similarity * max(len(p), len(q)) - 1e-9:
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= similarity * (len(p) + len(q) - both) - 1e-9:
                    us.append(u)
                    vs.append(v)
            yield pa.record_batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the pairs (u, v, place) whose sets (node, shingles) have the similarity.

    The pairs of a place are checked together, so that a set goes there once, not once a pair. A place is cut into blocks,
    by hashes of both ends, until a block holds about ``BLOCK`` bytes of sets and ``PAIRS`` pairs.
    """
    ends = pairs.select("place", F.explode(F.array("u", "v")).alias("node")).distinct()
    sizes = small(cut(sets.select("node", F.octet_length("shingles").alias("size"))))
    wide = ends.join(sizes, "node").groupBy("place").agg(F.sum("size").alias("size"))
    full = pairs.groupBy("place").agg(F.count("*").alias("n")).join(wide, "place")
    cuts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.sqrt(F.col("n") / PAIRS))).cast("int")
    many = cut(full.select("place", cuts.alias("cuts")).where("cuts > 1"))
    side = [F.pmod(F.xxhash64(x), F.coalesce("cuts", F.lit(1))) for x in ("u", "v")]
    dealt = cut(pairs.join(small(many), "place", "left").select(F.xxhash64("place", *side).alias("block"), "u", "v"))
    asked = dealt.select("block", F.explode(F.array("u", "v")).alias("node")).distinct()
    held = salted_join(asked, sets, "node", "block").select("block", F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"), "shingles")
    rows = held.unionByName(dealt.withColumn("shingles", F.lit(None).cast("binary")))
    sorted_ = rows.repartition(partitions(pairs.sparkSession), "block").sortWithinPartitions("block", F.col("v").asc_nulls_first())
    return sorted_.mapInArrow(_similar(similarity), "u bigint, v bigint")


WIDE = "node bigint, comp bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint"


def _placed(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, comp, words) -> (place, part, at, node, comp, words): a row for each table ``at``, at the place of its key there.

    A key of very many rows, or of very large sets where ``rows`` tell their ``size`` in bytes, is cut into parts, and each
    pair of parts has a place of its own.
    """
    names = ["node", "comp", "f0", "f1", "f2", "f3"]
    first = rows.select(*names).mapInArrow(_table_keys(bits, tables), "key bigint, " + WIDE)
    counted = first.withColumn("size", F.lit(0)) if "size" not in rows.columns else first.join(small(rows.select("node", "size")), "node")
    parts = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / BLOCK)).cast("int")
    wide = cut(counted.groupBy("key").agg(parts.alias("parts")).where("parts > 1"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    both = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, own).otherwise(-1 - own).alias("part")))
    )
    parted = first.join(small(wide), "key", "left").withColumn("p", F.explode(both))
    return parted.select(F.xxhash64("key", "p.i", "p.j").alias("place"), F.col("p.part").cast("bigint").alias("part"), F.shiftright("key", bits).alias("at"), *names)


def _tree_links(docs: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """(u, v): links of ``nodes`` by vantage-point trees, within 3 of the first 64 bits, whose sets have the similarity."""
    heads = cut(nodes.groupBy("f0").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "f0").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    near = links(heads.select(F.col("f0").alias("fp")))
    for end in ("u", "v"):
        near = near.join(heads.select(F.col("f0").alias(end), F.col("head").alias(f"{end}_head")), end)
    pairs = cut(same.unionByName(near.select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))).distinct().withColumn("place", F.col("v")))
    return cut(_checked(pairs, _sets(docs, nodes, pairs.select(F.explode(F.array("u", "v")).alias("node")), k), similarity))


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from one text each."""
    ends = cut(wanted.select("node").distinct())
    named = cut(nodes.join(ends, "node", "left_semi").select(F.col("first").alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").join(small(named), "doc_id", "left_semi")
    return cut(shingle_sets(texts, k).join(small(ends), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))


def similar_links(docs: DataFrame, nodes: DataFrame, k: int, similarity: float = 0.8) -> DataFrame:
    """(u, v): links between ``nodes`` (node, first, words of the fingerprint) whose components are those of all candidates
    whose sets of shingles have the similarity.

    First come the links of the vantage-point trees. What is too far apart for them, keys of drawn bits find: they send a
    spanning forest of their candidates; once those are checked, the sets of rows with further candidates between parts not
    yet joined go to the places where these meet, and all such pairs are checked there. What comes out of a place are fewer
    links than it has rows.
    """
    spark = docs.sparkSession
    bits, tables = layout(nodes.count(), similarity)

    def named(good: DataFrame) -> DataFrame:
        return cut(nodes.join(connected_components(good), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"))

    good = _tree_links(docs, nodes, k, similarity)
    placed = _placed(named(good), bits, tables).drop("at")
    dealt = placed.repartition(partitions(spark), "place").sortWithinPartitions("place", "part", "node")
    found = cut(dealt.mapInArrow(_candidates(LIMIT), "u bigint, v bigint, place bigint"))
    pairs = cut(found.where("v IS NOT NULL").groupBy("u", "v").agg(F.min("place").alias("place")))
    good = good.unionByName(cut(_checked(pairs, _sets(docs, nodes, pairs.select(F.explode(F.array("u", "v")).alias("node")), k), similarity)))
    left = cut(found.where("v IS NULL").select(F.col("u").alias("node")).distinct())
    if left.isEmpty():
        return good
    sets = _sets(docs, nodes, left, k)
    rows = cut(named(good).join(sets.select("node", F.octet_length("shingles").alias("size")), "node"))
    masks, schema = _masks(bits, tables), "place bigint, node bigint"
    places = cut(_placed(rows, bits, tables))
    order = ["place", "part", "node"]
    asked = cut(places.repartition(partitions(spark), "place").sortWithinPartitions(*order).mapInArrow(_asked(LIMIT, masks), schema))
    held = salted_join(places.join(asked, ["place", "node"], "left_semi"), sets, "node", "place").select(*places.columns, "shingles")
    more = held.repartition(partitions(spark), "place").sortWithinPartitions(*order).mapInArrow(_similar_here(LIMIT, masks, similarity), "u bigint, v bigint")
    return good.unionByName(cut(more))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text) -> (doc_id, group_id): the smallest doc_id that links reach, for every row with a doc_id.

    Texts are linked if their sets of shingles of k words have at least that Jaccard similarity; a text of fewer words is
    one shingle. Every link is checked against the sets. Candidates share a key in a table of drawn bits and differ in at
    most ``LIMIT`` bits, which finds over 95 in 100 pairs of similarity 0.8 and nearly all from 0.85, at any size. Null
    and empty texts, and texts of white space, are never linked to others, nor to each other.
    """
    own = docs.where("doc_id IS NOT NULL")
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    fps = cut(wide_fingerprints(own.where(worded), k))
    names = ["f0", "f1", "f2", "f3"]
    nodes = cut(fps.groupBy("node", *names).agg(F.min("doc_id").alias("first")))
    comp = cut(connected_components(similar_links(own.where(worded), nodes, k, similarity)))
    linked = comp.join(nodes.select("node", "first"), "node")
    named = salted_join(linked, linked.groupBy("root").agg(F.min("first").alias("group_id")), "root", "node").select("node", "group_id")
    named = named.unionByName(nodes.join(comp, "node", "left_anti").select("node", F.col("first").alias("group_id")))
    grouped = fps.select("doc_id", "node").join(named, "node").select("doc_id", "group_id")
    return grouped.unionByName(own.where(~worded).select(F.col("doc_id").cast("bigint"), F.col("doc_id").cast("bigint").alias("group_id")))


def keep_first(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the smallest doc_id, once. Columns are kept.

    Rows without a doc_id stay. Of rows that share a doc_id one stays, the one whose text has the least hash. An empty
    table stays empty.
    """
    key, many, place = fresh(docs, "key", "many", "place")
    groups = near_duplicates(docs, k, similarity)
    low = groups.groupBy("doc_id").agg(F.min("group_id").alias("group_id"), (F.count("*") > 1).alias(many)).where("doc_id = group_id")
    stay = small(cut(low.select(F.col("doc_id").alias(key), many)))
    kept = docs.join(stay, docs["doc_id"] == F.col(key)).drop(key)
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    several = kept.where(many).withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).drop(place, many)
    return kept.where(~F.col(many)).drop(many).unionByName(several).unionByName(docs.where("doc_id IS NULL"))
