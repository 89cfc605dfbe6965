"""Token counts of parts of documents, from one encoding of each whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import fast_encoder

RULES = ("first", "last", "most", "share")


def spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters from which and up to which each token reaches; a token with a part of a character reaches over it."""
    char = np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)
    ends = np.cumsum(lengths[ids])
    return char[ends - lengths[ids]] - 1, char[ends - 1]


def attribute(start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each part [lo, hi), and how many tokens cross one of its borders.

    Both ends of tokens are sorted, so that a part's tokens are one run, found by bisection. A token that crosses a
    border counts by the rule: ``first`` or ``last``: where that character of it lies; ``most``: where over half of it
    lies, or just half and its first character; ``share``: in each part as much of it as lies there.
    """
    begins, stops = np.searchsorted(start, lo), np.searchsorted(start, hi)
    touch_lo, touch_hi = np.searchsorted(end, lo, "right"), stops
    inside_hi = np.maximum(np.searchsorted(end, hi, "right"), begins)
    whole = np.maximum(inside_hi - begins, 0)
    empty = lo >= hi
    crossing = np.where(empty, 0, np.maximum(touch_hi - touch_lo, 0) - whole)
    if rule == "first":
        n = (stops - begins).astype(float)
    elif rule == "last":
        n = (np.searchsorted(end, hi, "right") - np.searchsorted(end, lo, "right")).astype(float)
    else:
        n = whole.astype(float)
        for i in np.flatnonzero(crossing).tolist():
            t = np.concatenate((np.arange(touch_lo[i], min(begins[i], touch_hi[i])), np.arange(max(inside_hi[i], touch_lo[i]), touch_hi[i])))
            t = np.unique(t)
            size = end[t] - start[t]
            part = np.minimum(end[t], hi[i]) - np.maximum(start[t], lo[i])
            n[i] += (part / size).sum() if rule == "share" else ((2 * part > size) | (2 * part == size) & (start[t] >= lo[i])).sum()
    return np.where(empty, 0, n), crossing


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a text: its lines, each with its line feed. No part in an empty text."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    cuts = np.concatenate(([0], at, [len(text)]))
    lo, hi = cuts[:-1], cuts[1:]
    return lo[lo < hi], hi[lo < hi]


def token_counts(docs: DataFrame, path: str, sections: DataFrame | None = None, rule: str = "first") -> DataFrame:
    """(doc_id, text) -> (doc_id, section, start, end, n_tokens, n_crossing), and a row per document with section -1.

    ``sections`` has rows (doc_id, section, start, end) in code points, which may overlap and leave gaps; without it the
    lines of each text are its sections. Positions beyond a text are cut to it. Section -1 is the whole document: its
    n_tokens are all its tokens, so that what no section has can be told; its n_crossing counts tokens over one border
    or more. Null and empty texts have just that row, with 0. Rows that share a doc_id each get the sections of the id.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    own = docs.select(F.col("doc_id").cast("bigint"), "text")
    if sections is None:
        own = own.withColumn("sections", F.lit(None).cast("array<struct<section:bigint,start:bigint,end:bigint>>"))
    else:
        lists = sections.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(
            F.col("section").cast("bigint").alias("section"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))).alias("sections"))
        own = own.join(lists, "doc_id", "left").withColumn("sections", F.coalesce("sections", F.expr("array()").cast("array<struct<section:bigint,start:bigint,end:bigint>>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = fast_encoder(path)
        for b in batches:
            rows: list[tuple[np.ndarray, ...]] = []
            for i, (x, s) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                text = x.as_py() or ""
                ids = e.encode(text)
                if s.is_valid:
                    s = s.as_py()
                    name = np.array([y["section"] for y in s], np.int64)
                    lo, hi = (np.clip(np.array([y[k] or 0 for y in s], np.int64), 0, len(text)) for k in ("start", "end"))
                else:
                    lo, hi = lines(text)
                    name = np.arange(len(lo))
                start, end = spans(text, ids, e.lengths) if len(ids) else (np.empty(0, np.int64),) * 2
                n, crossing = attribute(start, end, lo, hi, rule)
                border = np.unique(np.concatenate((lo, hi)))
                over = int((np.searchsorted(border, end) > np.searchsorted(border, start, "right")).sum())
                rows.append((np.full(len(lo) + 1, i), np.append(name, -1), np.append(lo, 0), np.append(hi, len(text)), np.append(n, len(ids)), np.append(crossing, over)))
            if rows:
                i, name, lo, hi, n, crossing = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield pa.record_batch({"doc_id": b.column(0).take(pa.array(i)), "section": pa.array(name, pa.int64()), "start": pa.array(lo, pa.int64()), "end": pa.array(hi, pa.int64()), "n_tokens": pa.array(n, pa.float64()), "n_crossing": pa.array(crossing, pa.int64())})

    return own.mapInArrow(run, "doc_id bigint, section bigint, start bigint, end bigint, n_tokens double, n_crossing bigint")
