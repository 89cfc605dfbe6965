"""Vectors as short codes: a codebook of integer entries for each part of a vector, fitted by rounds of nearest entries and means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut, salted_join

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components up to this size are summed and multiplied as 64-bit integers, larger ones as Python's own.
PLAIN = 1 << 25
#: Scaled components beyond this size count as this size; errors beyond 63 bits count as the largest 63-bit number.
MOST, MOST_ERROR = 1 << 62, (1 << 63) - 1
#: Rows whose distances to all entries of a part are held at a time.
BLOCK = 4096


def edges(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; of a width that the number of parts does not divide the first ones are longer."""
    return [0, *np.cumsum([width // parts + (i < width % parts) for i in range(parts)]).tolist()]


def scaled(column: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept rows of a list column and their components as integers, floor(scale * x), a row each.

    Null lists and lists with a null or non-finite component are dropped. Without a ``width`` all kept rows must share one.
    """
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()  # of null lists nothing is kept; their lengths count as 0
    valid = np.ones(len(column), bool) if not column.null_count else ~np.asarray(column.is_null())
    lengths = np.where(valid, lengths, 0)
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else lengths
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    keep = valid & (bad[starts + lengths] == bad[starts])
    if width is not None:
        keep &= lengths == width
    at = np.flatnonzero(keep)
    if not len(at):
        return at, np.empty((0, width or 0), np.int64)
    w = int(lengths[at[0]])
    rows = np.floor(scale * values[starts[at][:, None] + np.arange(w)])
    if rows.size and np.abs(rows).max() > PLAIN:
        return at, np.array([[max(-MOST, min(MOST, int(x))) if np.isfinite(x) else (MOST if x > 0 else -MOST) for x in r] for r in rows.tolist()], object).reshape(rows.shape)
    return at, rows.astype(np.int64)


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry, the first of equals, and the squared distance: |x|^2 - 2 x.c + |c|^2, all in integers."""
    if x.dtype != entries.dtype:
        x, entries = x.astype(object), entries.astype(object)
    norms = (entries * entries).sum(1)
    best, error = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    for i in range(0, len(x), BLOCK):
        rows = x[i : i + BLOCK]
        far = norms - 2 * (rows @ entries.T)
        j = far.argmin(1)
        best[i : i + BLOCK] = j
        error[i : i + BLOCK] = far[np.arange(len(rows)), j] + (rows * rows).sum(1)
    return best, error


@dataclass(frozen=True)
class Codebooks:
    """For each part a matrix of entries; all parts have as many. Its size depends on the width of vectors only."""

    parts: tuple[np.ndarray, ...]
    scale: int
    width: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for part in self.parts for x in part.ravel()).encode()).hexdigest()

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared error of each row (down) in each part (across)."""
        cuts = edges(self.width, len(self.parts))
        found = [nearest_entries(rows[:, a:z], part) for a, z, part in zip(cuts, cuts[1:], self.parts, strict=False)]
        return np.stack([b for b, _ in found], 1), np.stack([e for _, e in found], 1)


def _integers(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.array(rows, object).reshape(len(rows), width)
    return out if out.size and max(map(abs, out.ravel())) > PLAIN else out.astype(np.int64)


def _first(vectors: DataFrame, entries: int, scale: int) -> list[list[int]]:
    """The kept vectors of the least ids (null ids last, equal ids by content), of the width of the very first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in np.unique(np.asarray(b.column(1).value_lengths().fill_null(-1))):
                if w >= 0:
                    at, rows = scaled(b.column(1), scale, int(w))
                    yield pa.record_batch({"vec_id": b.column(0).take(pa.array(at, pa.int64())), "x": pa.array([[str(int(v)) for v in r] for r in rows], pa.list_(pa.string()))})

    # only the least ids of each task and file go on; texts of digits order otherwise than numbers, which only equal ids see
    least = vectors.select(F.col("vec_id").cast("bigint"), "embedding")
    kept = least.mapInArrow(run, "vec_id bigint, x array<string>")
    width = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    if not width:
        return []
    same = kept.where(F.size("x") == len(width[0].x))
    return [[int(v) for v in r.x] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of (vec_id, embedding), fitted on all rows; None if no row is kept.

    A codebook starts as the parts of the vectors of the ``entries`` least ids. Each round sends the books to all tasks,
    each of which adds up the rows that are nearest to an entry, one sum per entry and component; the sums meet by a grouped
    shuffle, and an entry becomes the floor of its mean. An entry that is nearest to nothing stays.
    """
    first = _first(vectors, entries, scale)
    if not first:
        return None
    width = len(first[0])
    cuts, x = edges(width, parts), _integers(first, width)
    books = Codebooks(tuple(x[:, a:z].copy() for a, z in zip(cuts, cuts[1:], strict=False)), scale, width)
    source = vectors.select("embedding")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            """The sums of one task: their number does not depend on its rows."""
            n = [np.zeros(len(p), np.int64) for p in books.parts]
            sums = [np.zeros(p.shape, object) for p in books.parts]
            for b in batches:
                _, rows = scaled(b.column(0), books.scale, books.width)
                own, _ = books.assign(rows)
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    here = np.zeros(sums[k].shape, rows.dtype)
                    np.add.at(here, own[:, k], rows[:, a:z])
                    sums[k] += here
                    n[k] += np.bincount(own[:, k], minlength=len(n[k]))
            for k, part in enumerate(sums):
                used = np.flatnonzero(n[k])
                entry, place = np.repeat(used, part.shape[1]), np.tile(np.arange(part.shape[1]), len(used))
                yield pa.record_batch({
                    "part": pa.array(np.full(len(entry), k), pa.int32()), "entry": pa.array(entry, pa.int32()), "place": pa.array(place, pa.int32()),
                    "n": pa.array(n[k][entry], pa.int64()), "total": pa.array([str(v) for v in part[used].ravel()], pa.string()),
                })

        sums = source.mapInArrow(run, "part int, entry int, place int, n bigint, total string")
        means = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        new = [p.astype(object) for p in books.parts]
        for r in means.collect():  # at most one row per component of the books
            new[r.part][r.entry, r.place] = int(r.total) // r.n
        books = Codebooks(tuple(_integers(p.tolist(), p.shape[1]) for p in new), scale, width)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, label: str | None = "label") -> DataFrame:
    """(vec_id, embedding, label) -> (vec_id, label, entries, error), one row per kept row: the nearest entry of each part
    and the squared distances, added up over the parts, which are at most 2^63 - 1.

    Rows whose vector is null, holds a null or non-finite component or is of another width than the books are dropped; rows
    that share an id, or have none, are coded each. Without books the result is empty. Other columns are not looked at.
    """
    own = vectors.select(F.col("vec_id").cast("bigint"), "embedding", (F.col(label) if label else F.lit(None)).cast("string").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if books else ():
            at, rows = scaled(b.column(1), books.scale, books.width)
            entry, error = books.assign(rows)
            at = pa.array(at, pa.int64())
            total = [min(int(e), MOST_ERROR) for e in error.astype(object).sum(1)] if len(error) else []
            yield pa.record_batch({"vec_id": b.column(0).take(at), "label": b.column(2).take(at), "entries": pa.array(entry.tolist(), pa.list_(pa.int32())), "error": pa.array(total, pa.int64())})

    return own.mapInArrow(run, "vec_id bigint, label string, entries array<int>, error bigint")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding, label) -> (vec_id, code, error, label_error, codebooks_sha256): ``fit``, then ``encode``.

    A code has two hex digits per part. ``label_error`` adds up the errors of all rows of the same label, nulls as one
    label. An empty table, or one without a vector to keep, gives an empty result.
    """
    books = fit(vectors, parts, entries, rounds, scale)
    coded = cut(encode(vectors, books).withColumn("kind", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))))
    sums = cut(coded.groupBy("kind").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_ERROR).cast("decimal(38,0)")).cast("bigint").alias("label_error")))
    # a row per label: to all tasks if counted few, else to as many places as a label's rows need
    joined = coded.join(F.broadcast(sums), "kind") if sums.count() <= FEW else salted_join(coded, sums, "kind", "vec_id", 100_000)
    digits = F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e.cast("bigint"))), 2, "0"))
    return joined.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
