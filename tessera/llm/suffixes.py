"""Byte strings of a given length that occur more than once, found by grouping suffixes digit by digit to a stated depth.

This is not a sort of all suffixes: see the README for why. Suffixes are told apart by up to three digits, each a hash of
many bytes, no deeper than the threshold, and a suffix leaves as soon as its group is settled:

1. Only content-chosen anchors go in: any two equal strings of ``size`` bytes hold the same anchor at the same place.
   The first digit is the ``gram`` bytes from the anchor. A suffix alone with its digit leaves.
2. The second digit is all that a string around the anchor can reach. Suffixes that share it have all their strings
   repeated and are settled; one of them stays to stand for them.
3. What is left differs somewhere near the anchor. For each place of a string around the anchor, the last digit is
   the bytes of just that string: groups of two or more are exactly the repeated strings.

Suffixes of one document that share both digits travel as one row. A digit shared by very many suffixes (``GIANT``) is
dealt out by its whole strings in pass 3, and by the second digit in passes 1 and 2; a second digit that is common by
itself is dealt out by document, as its count needs no more looking at. So no group is ever gathered in one task. The
second digits of a digit that is dealt out are counted beforehand, over all its rows. Digits are compared by hashes of 64
bits within a group that already shares one of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, partitions
from .windows import Rolling, anchors, mix, runs

#: Different surroundings of one first digit above which pass 3 deals it out by whole strings.
GIANT = 8192
SALTS = 64
#: Rows of the sample that finds digits common enough to be dealt out. It steers where rows go, never what is found.
SAMPLE = 2000
CHUNK = 1 << 16


def _bytes(x) -> np.ndarray:
    v = x.as_py()
    return np.frombuffer(v.encode("utf-8", "surrogatepass") if v else b"", np.uint8)


class Hot(NamedTuple):
    """Digits that are dealt out, sorted, the number of second digits of each, and second digits dealt out by document."""

    digits: np.ndarray
    around: np.ndarray
    kinds: np.ndarray | None = None


def _anchor_rows(size: int, gram: int, hot: Hot | None):
    """(key, tag, text) -> rows of ANCHORS; only those of hot digits while these are not counted."""
    reach = size - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            more: list[bytes | None] = []
            for i, x in enumerate(b.column(2)):
                data = _bytes(x)
                if len(data) < size:
                    continue
                roll = Rolling(data)
                h = roll.windows(gram)
                at = anchors(h, reach + 1)
                lo, hi = np.maximum(at - reach, 0), np.minimum(at + size, len(data))
                around = roll.slices(lo, hi) ^ mix(((at - lo) * 4096 + (hi - at)).astype(np.uint64))
                kinds, first, which, many = np.unique(around, return_index=True, return_inverse=True, return_counts=True)
                rest: list[bytes | None] = [None] * len(kinds)
                for k in np.flatnonzero(many > 1).tolist():
                    rest[k] = at[which == k][1:].astype("<i4").tobytes()
                more += rest
                out.append((np.full(len(kinds), i), h[at[first]], kinds, at[first]))
            if out:
                i, digit, around, at = (np.concatenate(x) for x in zip(*out, strict=True))
                salt, kinds = np.zeros(len(i), np.int32), np.zeros(len(i), np.int64)
                if hot is not None:
                    c = np.isin(digit, hot.digits)
                    if hot.kinds is None:
                        i, digit, around, at, salt, kinds = (x[c] for x in (i, digit, around, at, salt, kinds))
                        more, c = [more[k] for k in np.flatnonzero(c).tolist()], c[c]
                    else:
                        kinds[c] = hot.kinds[np.searchsorted(hot.digits, digit[c])]
                    salt[c] = np.uint64(1) + around[c] % np.uint64(SALTS)
                    c = np.isin(around, hot.around)
                    salt[c] = np.uint64(SALTS + 1) + mix(b.column(0).to_numpy()[i[c]].astype(np.uint64) + np.uint64(1)) % np.uint64(SALTS)
                yield pa.record_batch({
                    "digit": pa.array(digit.view(np.int64)), "salt": pa.array(salt), "kinds": pa.array(kinds), "around": pa.array(around.view(np.int64)),
                    "key": b.column(0).take(pa.array(i)), "tag": b.column(1).take(pa.array(i)), "at": pa.array(at.astype(np.int32)),
                    "more": pa.array(more, pa.binary()),
                })

    return run


ANCHORS = "digit bigint, salt int, kinds bigint, around bigint, key bigint, tag bigint, at int, more binary"


def _surroundings(size: int, gram: int):
    """(key, tag, text, marks of digit, at, giant) -> rows for pass 3: bytes around the anchor, or whole strings."""
    reach = size - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: dict[str, list] = {k: [] for k in ("i", "digit", "second", "at", "left", "right")}
            for i, (x, marks) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                data = _bytes(x)
                at = np.array([m["at"] for m in marks.as_py()], np.int64)
                digit = np.array([m["digit"] for m in marks.as_py()], np.int64)
                giant = np.array([m["giant"] for m in marks.as_py()], bool)
                raw = data.tobytes()
                for d, a in zip(digit[~giant].tolist(), at[~giant].tolist(), strict=True):
                    parts["i"].append(i)
                    parts["digit"].append(d)
                    parts["second"].append(0)
                    parts["at"].append(a)
                    parts["left"].append(raw[max(a - reach, 0) : a])
                    parts["right"].append(raw[a + gram : a + size])
                if giant.any():
                    starts = np.unique(np.concatenate([np.arange(max(a - reach, 0), min(a, len(data) - size) + 1) for a in at[giant].tolist()]))
                    for k, which in (("digit", 0), ("second", 1)):
                        parts[k] += Rolling(data, which).slices(starts, starts + size).view(np.int64).tolist()
                    parts["i"] += [i] * len(starts)
                    parts["at"] += starts.tolist()
                    parts["left"] += [None] * len(starts)
                    parts["right"] += [None] * len(starts)
            i = pa.array(parts["i"], pa.int64())
            yield pa.record_batch({
                "digit": pa.array(parts["digit"], pa.int64()), "second": pa.array(parts["second"], pa.int64()),
                "key": b.column(0).take(i), "tag": b.column(1).take(i), "at": pa.array(parts["at"], pa.int32()),
                "left": pa.array(parts["left"], pa.binary()), "right": pa.array(parts["right"], pa.binary()),
            })

    return run


SURROUNDINGS = "digit bigint, second bigint, key bigint, tag bigint, at int, left binary, right binary"


def _matrix(column: list[bytes], width: int, flush_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes read outwards from the anchor, and their lengths."""
    size = np.fromiter(map(len, column), np.int64, len(column))
    joined = b"".join(x[::-1].ljust(width, b"\0") if flush_right else x.ljust(width, b"\0") for x in column)
    return np.frombuffer(joined, np.uint8).reshape(-1, width), size


def _last_digit(size: int, gram: int):
    """Rows sorted by digit -> (key, tag, lo, hi): starts, first to last, of repeated strings."""
    reach = size - gram
    factor = np.uint64(0xC2B2AE3D27D4EB4F)

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        digit = rows.column("digit").to_numpy().view(np.uint64)
        left, n_left = _matrix(rows.column("left").to_pylist(), reach, True)
        right, n_right = _matrix(rows.column("right").to_pylist(), reach, False)
        powers = np.cumprod(np.full(reach + 1, factor, np.uint64))
        before = np.zeros(len(digit), np.uint64)
        after = np.zeros(len(digit), np.uint64)
        for c in range(reach):  # a column at a time: the whole in 64 bits is eight times the bytes
            after += (right[:, c].astype(np.uint64) + np.uint64(1)) * powers[c]
        base, found = mix(digit), np.zeros((len(digit), reach + 1), bool)
        for o in range(reach + 1):  # the string starts o bytes before the anchor
            able = np.flatnonzero((n_left >= o) & (n_right >= reach - o))
            if len(able) > 1:
                h = mix(base[able] ^ mix(before[able] ^ mix(after[able])))
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                hit = np.zeros(len(able), bool)
                hit[order[1:][same]] = hit[order[:-1][same]] = True
                found[able[hit], o] = True
            if o < reach:
                before = before + (left[:, o].astype(np.uint64) + np.uint64(1)) * powers[o]
                after = after - (right[:, reach - o - 1].astype(np.uint64) + np.uint64(1)) * powers[reach - o - 1]
        some = np.flatnonzero(found.any(axis=1))
        padded = np.zeros((len(some), reach + 3), np.int8)
        padded[:, 1:-1] = found[some]
        edge = np.diff(padded, axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        row = some[row]
        at = rows.column("at").to_numpy()[row]
        yield from pa.table({
            "key": rows.column("key").take(pa.array(row)), "tag": rows.column("tag").take(pa.array(row)),
            "lo": pa.array((at - last).astype(np.int32)), "hi": pa.array((at - first).astype(np.int32)),
        }).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            d = b.column(0).to_numpy()
            if n >= CHUNK and d[0] != d[-1]:
                cut_at = int(np.searchsorted(d, d[-1]))
                held[-1] = b.slice(0, cut_at)
                yield from settle(pa.Table.from_batches(held))
                held, n = [b.slice(cut_at)], b.num_rows - cut_at
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def _kept(data: np.ndarray, marks: list | None, size: int) -> tuple[np.ndarray, int]:
    """The bytes that stay, and the number of runs that go."""
    if not marks or len(data) < size:
        return data, 0
    lo, hi = (np.array([y[k] for y in marks], np.int64) for k in ("lo", "hi"))
    for y in marks:
        if y["more"] is not None:
            at = np.frombuffer(y["more"], "<i4").astype(np.int64)
            lo, hi = np.append(lo, at - (y["hi"] - y["lo"])), np.append(hi, at)
    lo, hi = np.maximum(lo, 0), np.minimum(hi, len(data) - size)
    ok = lo <= hi
    steps = np.zeros(len(data) + 1, np.int64)
    np.add.at(steps, lo[ok], 1)
    np.add.at(steps, hi[ok] + size, -1)
    covered = np.cumsum(steps[:-1]) > 0
    return data[~covered], len(runs(covered)[0])


def _strip(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, marks in zip(b.column(1), b.column(2), strict=True):
                data = _bytes(x)
                left, spans = _kept(data, marks.as_py(), size)
                kept = left.tobytes()
                rows.append((len(data), len(data) - len(left), spans, hashlib.sha256(kept).hexdigest(), kept))
            n, removed, spans, sha, kept = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch({"key": b.column(0), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())})

    return run


def _hot_digits(docs: DataFrame, size: int, gram: int) -> Hot | None:
    """First and second digits that lie in over 1 % of a bounded sample of documents, counted over all documents."""
    every = max(1, docs.count() // SAMPLE)
    rows = docs.where(F.pmod(F.xxhash64("key", "tag"), F.lit(every)) == 0).mapInArrow(_anchor_rows(size, gram, None), ANCHORS)
    both = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("digit").alias("value")), F.struct(F.lit(1).alias("which"), F.col("around").alias("value")))).alias("x")).select("x.*").groupBy("which", "value").count()
    common = both.where(F.col("count") >= max(20, SAMPLE // 100)).orderBy(F.desc("count"), "which", "value").limit(20_000).collect()
    hot = Hot(*(np.sort(np.array([r.value for r in common if r.which == w], np.int64).view(np.uint64)) for w in (0, 1)))
    if not len(hot.digits):
        return None
    pairs = docs.mapInArrow(_anchor_rows(size, gram, hot), ANCHORS).select("digit", "around").distinct()
    counts = {r.digit: r["count"] for r in pairs.groupBy("digit").count().collect()}
    return hot._replace(kinds=np.array([counts[d] for d in hot.digits.view(np.int64).tolist()], np.int64))


def repeated_starts(keyed: DataFrame, size: int = 200, gram: int = 50) -> DataFrame:
    """(__key, __tag, text) -> (key, tag, lo, hi, more): every string of ``size`` bytes that starts at lo to hi occurs again.

    The same holds around the places in ``more``, 32 bits each, as around hi. Other columns are not looked at, but kept
    where ``keyed`` is dealt out, so that a caller who joins the result with it reads the same exchange again.
    """
    spark = keyed.sparkSession
    docs = keyed.select(F.col("__key").alias("key"), F.col("__tag").alias("tag"), "text")
    n = partitions(spark)
    reach = size - gram
    hot = _hot_digits(docs, size, gram)
    dealt = docs.mapInArrow(_anchor_rows(size, gram, hot), ANCHORS).repartition(n, "digit", "salt")
    alike, group = Window.partitionBy("digit", "salt", "around"), Window.partitionBy("digit", "salt")
    own = F.xxhash64("key", "tag", "at")
    places = 1 + F.coalesce(F.length("more") / 4, F.lit(0)).cast("int")
    seen = dealt.withColumn("own", own).withColumn("copies", F.sum(places).over(alike)).withColumn("first", F.col("own") == F.min("own").over(alike))
    # a digit with salts has its other surroundings elsewhere, so it brings their number; second digits dealt out by
    # document were each seen twice at least
    wide = F.sum(F.col("first").cast("int")).over(group)
    kinds = F.when(F.col("salt") > 0, F.col("kinds")).otherwise(wide)
    repeated = (F.col("copies") > 1) | (F.col("salt") > SALTS)
    seen = seen.withColumn("kinds", kinds).withColumn("repeated", repeated).where("repeated OR kinds > 1")
    settled = seen.where("repeated").select("key", "tag", (F.col("at") - reach).alias("lo"), F.col("at").alias("hi"), "more")
    open_ = seen.where("first AND kinds > 1").select("key", "tag", F.struct("digit", "at", (F.col("kinds") > GIANT).alias("giant")).alias("m"))
    marks = open_.groupBy(F.col("key").alias("__key"), F.col("tag").alias("__tag")).agg(F.collect_set("m").alias("__places"))
    # rows of one identity are equal texts, each seen above; one of them stands for all
    rest = [c for c in keyed.columns if c not in ("__key", "__tag", "text")]
    one = keyed.join(marks, ["__key", "__tag"]).groupBy("__key", "__tag").agg(*[F.first(c).alias(c) for c in ("text", "__places", *rest)])
    near = one.mapInArrow(_surroundings(size, gram), SURROUNDINGS)
    sorted_ = near.where("left IS NOT NULL").repartition(n, "digit").sortWithinPartitions("digit")
    small = sorted_.mapInArrow(_last_digit(size, gram), "key bigint, tag bigint, lo int, hi int")
    whole = near.where("left IS NULL").select("digit", "second", "key", "tag", "at")
    place = F.xxhash64("key", "tag", "at")
    twice = whole.groupBy("digit", "second").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("digit", "second")
    giant = whole.join(twice, ["digit", "second"]).select("key", "tag", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return settled.unionByName(small.unionByName(giant).withColumn("more", F.lit(None).cast("binary")))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key and __tag, which only rows of equal doc_id and text share: 64 bits of the text's hash, beside
    the doc_id or, for null, 64 bits of another hash."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.withColumns({
        "__key": F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(F.lit(1), text)),
        "__tag": F.xxhash64(text),
    })


def _marked(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``docs`` with __key, __tag and __marks, the repeated starts of each document."""
    keyed = _keyed(docs)
    found = repeated_starts(keyed, size, gram)
    per_doc = found.groupBy(F.col("key").alias("__key"), F.col("tag").alias("__tag")).agg(F.collect_set(F.struct("lo", "hi", "more")).alias("__marks"))
    return keyed.join(per_doc, ["__key", "__tag"], "left")


def strip_repeats(docs: DataFrame, size: int = 200, gram: int = 50) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per row.

    Each byte goes that lies in a string of ``size`` bytes which starts anywhere else too, in the same document or
    another; strings are judged on the input. Null texts count as empty, texts shorter than ``size`` stay whole.
    Rows that share doc_id and text are documents of their own, so each is a repeat of the other.
    """
    marked = _marked(docs.select("doc_id", "text"), size, gram)
    out = marked.select(F.col("doc_id").cast("bigint").alias("key"), "text", F.col("__marks").alias("marks")).mapInArrow(
        _strip(size), "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    return out.withColumn("doc_id", F.col("key")).drop("key")


def strip_texts(docs: DataFrame, size: int = 200, gram: int = 50) -> DataFrame:
    """``docs`` with its columns, texts without their repeats, and n_chars (if there) counted anew.

    As in ``strip_repeats``; a character that loses a part of its bytes goes whole. A null text stays null, and an empty
    table stays empty.
    """
    names = docs.columns
    at, marks_at = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x, m in zip(b.column(at), b.column(marks_at), strict=True):
                keep = _kept(_bytes(x), m.as_py(), size)[0]
                texts.append(keep.tobytes().decode("utf-8", "ignore") if x.is_valid else None)
            columns = list(b.columns[:marks_at])
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=names)

    # other columns travel in one, so that no name of theirs can clash with one of ours
    rest = [c for c in names if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row") if rest else F.lit(None).alias("__row"))
    marked = _marked(packed, size, gram)
    (marks,) = fresh(docs, "marks")
    out = marked.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__row")[c].alias(c) for c in names], F.col("__marks").alias(marks)).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
