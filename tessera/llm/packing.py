"""Packing of token sequences by lexical retrieval.

Documents are encoded once. Whole windows of a long document fill sequences of their own. What is left over is dealt out
by content: each remainder has a direction, the sum of random vectors of its tokens under BM25 weights; it goes to the
nearest of the centres that a bounded sample gathers around, and within a centre's rows to those on the same sides of
random planes. So neighbours of the whole corpus mostly stand together, in shards of ``SHARD`` of that order. In a shard,
an inverted index with BM25 weights (document frequencies and the mean length are of all documents) returns for each seed
document its unused neighbours, best first, and they fill the seed's window; the last one is cut at the window's end and
its rest stays unused. A shard's open window goes on into the next shard of the same partition. The tokens that are left
at the end of a partition go into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import nearest_centres, spherical_means
from .common import cut, partitions
from .tokens import fast_encoder

#: Documents in one shard of the index.
SHARD = 512
K1, B = 1.2, 0.75
#: Of the order by content: length of a direction, planes, centres, and the bound of the sample that these are drawn from.
DIMENSIONS, PLANES, CENTRES, SAMPLE = 64, 24, 256, 8192
END = 1


def _encode(path: str):
    """(doc_id, text) -> a row (doc_id, ids) each, and one row (null, n, counts) with the split's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = fast_encoder(path)
        counts = np.zeros(e.size, np.int64)
        docs = tokens = 0
        for b in batches:
            ids = []
            for x in b.column(1):
                t = np.append(e.encode(x.as_py()), np.uint32(END)).astype("<u4")
                counts[np.unique(t)] += 1
                tokens += len(t)
                ids.append(t.astype("<u2").tobytes() if e.size <= 65536 else t.tobytes())
            docs += len(ids)
            if ids:
                yield pa.record_batch({"doc_id": b.column(0), "ids": pa.array(ids, pa.binary()), "docs": pa.nulls(len(ids), pa.int64()), "tokens": pa.nulls(len(ids), pa.int64())})
        if docs:
            yield pa.record_batch({"doc_id": pa.nulls(1, pa.int64()), "ids": pa.array([counts.tobytes()], pa.binary()), "docs": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0):
            c = np.frombuffer(x.as_py(), np.int64)
            total = c if total is None else total + c
    if total is not None:
        some = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(some), "n": pa.array(total[some])})


class Shard:
    """BM25 over the documents of one shard, as flat posting arrays."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(x) for x in ids])
        keys = np.repeat(np.arange(len(ids), dtype=np.uint64), sizes) << np.uint64(32) | np.concatenate(ids).astype(np.uint64)
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        tf = np.diff(np.append(first, len(keys)))
        doc, term = (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        self.n = len(ids)
        self._own = np.searchsorted(doc, np.arange(len(ids) + 1))
        names, term = np.unique(term, return_inverse=True)
        order = np.argsort(term, kind="stable")
        self._post_doc, self._post_weight = doc[order], weight[order]
        self._start = np.searchsorted(term[order], np.arange(len(names) + 1))
        self._term = term

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of each document for the seed's distinct terms."""
        terms = self._term[self._own[seed] : self._own[seed + 1]]
        lo, n = self._start[terms], self._start[terms + 1] - self._start[terms]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self._post_doc[at], self._post_weight[at], self.n)


class Packer:
    """Fills windows in turn; gives (document, start, length, window number, offset)."""

    def __init__(self, window: int, first: int):
        self.window, self.number, self.filled = window, first, 0

    def put(self, doc, start: int, length: int):
        row = (doc, start, length, self.number, self.filled)
        self.filled += length
        if self.filled == self.window:
            self.number, self.filled = self.number + 1, 0
        return row

    @property
    def room(self) -> int:
        return self.window - self.filled


def pack_shard(packer: Packer, docs: list, ids: list[np.ndarray], starts: list[int], shard: Shard) -> tuple[list, list[int]]:
    """Pack what documents hold from ``starts`` on. Returns the rows, and the documents of the window still open.

    Those are given back in full: nothing of an open window is settled yet.
    """
    rows, start = [], np.array(starts)
    left = np.array([len(x) for x in ids]) - start
    unused = left > 0
    opened: list[tuple[int, int, int]] = []
    while unused.any():
        seed = int(np.argmax(unused))
        score = shard.scores(seed)
        order = np.argsort(-score, kind="stable")
        opened, filled = [], 0
        for d in [seed, *order[order != seed].tolist()]:
            if not unused[d]:
                continue
            n = int(min(left[d], packer.window - filled))
            opened.append((d, int(start[d]), n))
            filled += n
            start[d] += n
            left[d] -= n
            unused[d] = left[d] > 0
            if filled == packer.window:
                rows += [packer.put(docs[d], s, n) for d, s, n in opened]
                opened = []
                break
    return rows, [(d, s) for d, s, _ in opened]


class Directions:
    """Where a remainder stands in the order by content."""

    def __init__(self, idf: np.ndarray, mean: float):
        rng = np.random.default_rng(5)
        self.vectors = rng.standard_normal((len(idf), DIMENSIONS), np.float32)
        self.planes = rng.standard_normal((DIMENSIONS, PLANES), np.float32)
        self.idf, self.mean = idf, mean

    def of(self, ids: np.ndarray) -> np.ndarray:
        term, tf = np.unique(ids, return_counts=True)
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / self.mean))
        v = weight.astype(np.float32) @ self.vectors[term]
        norm = np.sqrt(v @ v)
        return v / norm if norm > 0 else v

    def place(self, x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre, and on which side of each plane the way from it lies."""
        own = nearest_centres(x, centres, 1)[0][:, 0]
        return own, ((x - centres[own]) @ self.planes > 0) @ (np.int64(1) << np.arange(PLANES)[::-1])


def _piece(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (doc_id, ids, start of ids, doc_tokens, start, length, sequence, offset)."""
    doc, ids, first, total, start, n, number, offset = zip(*rows, strict=True)
    crc = [zlib.crc32(x[s - f : s - f + k].astype("<u4").tobytes()) for x, f, s, k in zip(ids, first, start, n, strict=True)]
    columns = {"doc_id": doc, "start": start, "length": n, "ids_crc32": crc, "doc_tokens": total, "sequence_id": number, "offset": offset}
    return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def _whole(window: int, dtype: str):
    """(doc_id, ids) -> the pieces of whole windows of long documents; their sequences have even numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for key, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), dtype)
                for s in range(0, len(ids) // window * window, window):
                    rows.append((key, ids, 0, len(ids), s, window, 2 * number, 0))
                    number += 1
            if rows:
                yield _piece(rows)

    return run


def _remainders(window: int, dtype: str, idf: np.ndarray, mean: float, centres: np.ndarray | None):
    """(doc_id, ids) -> (centre, side, doc_id, start, doc_tokens, ids): what whole windows leave; without centres directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = Directions(idf, mean)
        for b in batches:
            keys, left, start, total = [], [], [], []
            for key, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), dtype)
                s = len(ids) // window * window
                if s < len(ids):
                    for to, v in ((keys, key), (left, ids[s:]), (start, s), (total, len(ids))):
                        to.append(v)
            if not left:
                continue
            x = np.stack([directions.of(i) for i in left])
            if centres is None:
                yield pa.record_batch({"x": pa.array([v.tobytes() for v in x], pa.binary())})
                continue
            own, side = directions.place(x, centres)
            yield pa.record_batch({
                "centre": pa.array(own), "side": pa.array(side), "doc_id": pa.array(keys, pa.int64()), "start": pa.array(start, pa.int64()),
                "doc_tokens": pa.array(total, pa.int64()), "ids": pa.array([i.tobytes() for i in left], pa.binary()),
            })

    return run


def _pack(window: int, dtype: str, idf: np.ndarray, mean: float):
    """(doc_id, start, doc_tokens, ids) in their order -> pieces; their sequences have odd numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        held: list[tuple] = []  # (doc_id, ids, start of ids, doc_tokens, ids that are packed)
        new = 0  # held rows that were in no shard yet: very short ones can stay in an open window by the thousand

        def out(rows):
            return _piece([(*d[:4], d[2] + s, n, 2 * number + 1, offset) for d, s, n, number, offset in rows])

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal held
            ids = [d[1] for d in held]
            rows, rest = pack_shard(packer, held, ids, [d[4] for d in held], Shard(ids, idf, mean))
            held = [(*held[d][:4], s) for d, s in rest]
            if rows:
                yield out(rows)

        for b in batches:
            for key, start, total, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                held.append((key, np.frombuffer(x.as_py(), dtype), start, total, 0))
                new += 1
                if new >= SHARD:
                    yield from shard()
                    new = 0
        if held:
            yield from shard()
        todo, rows = list(held), []
        total = sum(len(d[1]) - d[4] for d in todo)
        for bit in range(total.bit_length() - 1, -1, -1):  # each power of two in the total is a sequence of its own
            if not total >> bit & 1:
                continue
            packer.window = 1 << bit
            while todo:
                d = todo[0]
                n = min(packer.room, len(d[1]) - d[4])
                number = packer.number
                rows.append(packer.put(d, d[4], n))
                todo[0] = (*d[:4], d[4] + n)
                if todo[0][4] == len(d[1]):
                    todo.pop(0)
                if packer.number > number:
                    break
        if rows:
            yield out(rows)

    return run


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, window: int = 2048) -> DataFrame:
    """(doc_id, text) -> one row per piece of a document.

    A document is the ids of its text and then id 1; a null or empty text is id 1 alone. ``start`` counts the ids before
    the piece, ``offset`` those before it in its sequence. Every sequence has ``window`` ids, but for those at the end of
    a partition, whose lengths are powers of two. Rows that share a doc_id are documents of their own. Other columns are
    not looked at, and an empty table has no piece.
    """
    spark = docs.sparkSession
    encoded = cut(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_encode(path), "doc_id bigint, ids binary, docs bigint, tokens bigint"))
    stats = encoded.where("docs IS NOT NULL")
    n, tokens = stats.agg(F.sum("docs"), F.sum("tokens")).first()
    size = fast_encoder(path).size
    df = np.zeros(size)
    for i, count in stats.select("ids").mapInArrow(_frequencies, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect():  # a row per id of the vocabulary at most
        df[i] = count
    idf, mean, dtype = np.log1p(((n or 0) - df + 0.5) / (df + 0.5)), (tokens or 1) / max(n or 1, 1), "<u2" if size <= 65536 else "<u4"
    rows = encoded.where("docs IS NULL").select("doc_id", "ids")
    drawn = rows.where(F.pmod(F.xxhash64("ids"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n or 1, 1)) * (1 << 30)))
    sample = [np.frombuffer(r.x, np.float32) for r in drawn.mapInArrow(_remainders(window, dtype, idf, mean, None), "x binary").limit(2 * SAMPLE).collect()]  # SAMPLE on the average
    centres = spherical_means(np.stack(sample) if sample else np.zeros((0, DIMENSIONS), np.float32), CENTRES)
    left = rows.mapInArrow(_remainders(window, dtype, idf, mean, centres), "centre bigint, side bigint, doc_id bigint, start bigint, doc_tokens bigint, ids binary")
    # the row's number parts equal directions, so that copies of one text, however many, are cut into ranges too
    order = ["centre", "side", "row"]
    dealt = left.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    packed = dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_pack(window, dtype, idf, mean), PIECES)
    return rows.mapInArrow(_whole(window, dtype), PIECES).unionByName(packed)
