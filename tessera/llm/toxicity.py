"""Toxic passages by maximum-scoring segments, and documents scored by extreme-value statistics.

Each word and each beginning of a word (so that inflected forms share one) has a log-odds between toxic and clean
training documents under an informative Dirichlet prior; a word whose log-odds are not significant counts as neutral, and
words that speak for a clean text count against it. Presence in documents is counted, not repeats. A constant is taken off every word, so that a clean text drifts down.
One linear pass gives all maximal segments. The best one in n clean words follows an extreme-value law with two
parameters: lambda solves sum p(s) exp(lambda s) = 1, K is set from clean documents. A segment is significant if its
expected number in a clean document of that length is below a limit. Two numbers, the best segment and the sum of the
significant ones on that scale, go through a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut

WORD = re.compile(r"[^\W_]+")
#: Bound of what the model is fitted on: labelled documents, drawn by a hash.
MAX_LABELLED = 50_000
STEMS = (4, 5, 6)
MANY = 100_000
PRIOR, FLOOR, LEAST_Z, DRIFT, LEAST_E = 500.0, 0.5, 3.2, 0.5, 0.05


@dataclass
class Model:
    weights: dict[str, float]
    scale: float = 1.0
    log_k: float = 0.0
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def evidence(self, best: float, n: int) -> float:
        """-ln of the number of segments this good to expect in n clean words."""
        return self.scale * best - self.log_k - math.log(max(n, 1))

    def features(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        best = max((s for _, _, s in segments), default=0.0)
        found = [self.evidence(s, n) for _, _, s in segments]
        return self.evidence(best, n), math.log1p(sum(x for x in found if x > -math.log(LEAST_E)))

    def score(self, features: tuple[float, float]) -> float:
        a, b, c = self.coef
        x = a + b * features[0] + c * features[1]
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a text, from its scored words (place, score) in order.

    Words between them score -drift. Each segment is one that no extension or cut-off would better (Ruzzo and Tompa).
    """
    out: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total, before = 0.0, -1
    for place, weight in hits:
        total -= drift * (place - before - 1)
        before = place
        start, total = total, total + weight
        if weight <= 0:
            continue
        first, low = place, start
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j -= 1
            if j < 0 or out[j][3] >= total:
                break
            first, low = out[j][0], out[j][2]
            del out[j:]
        out.append((first, place, low, total))
    return [(a, b, y - x) for a, b, x, y in out]


def stems(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class Weights(dict):
    """Score of a word: of its most toxic stem, or, if none is toxic, of its cleanest one. Words are kept once looked up, a
    bounded number of them."""

    def __init__(self, stem: dict[str, float]):
        super().__init__()
        self.stem = stem

    def __missing__(self, word: str) -> float | None:
        if len(self) > 200_000:
            self.clear()
        found = [x for s in stems(word) if (x := self.stem.get(s)) is not None]
        self[word] = None if not found else max(found) if max(found) > 0 else min(found)
        return self[word]


def _scan(text: str, weights: Weights) -> tuple[list[tuple[int, int, float]], int]:
    words = WORD.findall(text.lower())
    hits = [(i, x) for i, x in enumerate(map(weights.__getitem__, words)) if x is not None]
    return maximal_segments(hits), len(words)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words, sent on whenever there are over ``MANY`` of them."""
    counts = {0: Counter(), 1: Counter()}

    def out() -> pa.RecordBatch:
        words = list(counts[0] | counts[1])
        return pa.record_batch({"word": pa.array(words, pa.string()), "toxic": pa.array([counts[1][w] for w in words], pa.int64()), "clean": pa.array([counts[0][w] for w in words], pa.int64())})

    for b in batches:
        for x, y in zip(b.column(0), b.column(1), strict=True):
            counts[y.as_py()].update({s for w in set(WORD.findall((x.as_py() or "").lower())) for s in stems(w)})
        if len(counts[0]) + len(counts[1]) > MANY:
            yield out()
            counts = {0: Counter(), 1: Counter()}
    yield out()


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method, with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([0.0, *[1e-2] * (len(w) - 1)])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-6), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fit on (doc_id, text) and labels (doc_id, toxic) whose crc32(doc_id) mod 3 is not 1.

    At most about ``max_labelled`` labelled documents are used, drawn by a hash of the id: four fifths for the words'
    scores, the rest for lambda, K and the regression. A document with several labels is toxic if one says so. None if
    either class is missing.
    """
    ours = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), 3) != 1)
    n = ours.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    ours = ours.where(draw < int(min(1.0, max_labelled / max(n, 1)) * 1_000_000))
    ours = ours.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # bounded by max_labelled rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(ours), "doc_id")
    rows = cut(rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held")))
    counts = rows.where("NOT held").select("text", "toxic").mapInArrow(_word_counts, "word string, toxic bigint, clean bigint")
    counts = cut(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not sums[0] or not sums[1]:
        return None
    n1, n0 = float(sums[0]), float(sums[1])
    alpha = (F.col("toxic") + F.col("clean")) * (PRIOR / (n1 + n0)) + FLOOR
    delta = F.log((F.col("toxic") + alpha) / (n1 + PRIOR - F.col("toxic") - alpha)) - F.log((F.col("clean") + alpha) / (n0 + PRIOR - F.col("clean") - alpha))
    z = delta / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    kept = counts.select("word", "clean", delta.alias("delta"), z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy("word").collect()  # words of at most MAX_LABELLED documents
    model = Model({r.word: r.delta - DRIFT for r in kept})
    # background: what a word of a clean document scores; stems of one word add up here, on the safe side
    mass = np.array([(r.clean + FLOOR) / n0 for r in kept])
    p = np.append(mass, max(1 - mass.sum(), 0.0))
    s = np.array([r.delta - DRIFT for r in kept] + [-DRIFT])
    if not (s > 0).any():
        return model
    lo, hi = 0.0, 1.0
    while p @ np.exp(hi * s) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p @ np.exp(mid * s) < 1 else (lo, mid)
    model.scale = max(lo, 1e-3)
    stem = model.weights

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(stem)
        for b in batches:
            found = [_scan(x.as_py() or "", weights) for x in b.column(0)]
            yield pa.record_batch({
                "toxic": b.column(1), "n": pa.array([n for _, n in found], pa.int64()),
                "scores": pa.array([[s for _, _, s in x] for x, _ in found], pa.list_(pa.float64())),
            })

    held = rows.where("held").select("text", "toxic").mapInArrow(segments, "toxic int, n bigint, scores array<double>").collect()  # bounded by max_labelled
    clean = [model.scale * max(r.scores, default=0.0) - math.log(max(r.n, 1)) for r in held if not r.toxic]
    if clean and len(clean) < len(held):
        model.log_k = float(np.mean(clean)) - float(np.euler_gamma)
        x = np.array([model.features([(0, 0, s) for s in r.scores], r.n) for r in held])
        model.coef = tuple(_logistic(x, np.array([r.toxic for r in held], float)))
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, text) -> (doc_id, score, predicted, passages), one row per row of ``docs``.

    ``passages`` are the significant segments: their place in code points of the lower-cased text, and -ln of the number
    to expect in a clean text of that length. Null and empty texts have no passage. Without a model scores are 0. Rows that
    share a doc_id, or have none, are scored like all others; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model.weights if model else {})
        for b in batches:
            scores, passages = [], []
            for x in b.column(1):
                text = x.as_py() or ""
                segments, n = _scan(text, weights) if model else ([], 0)
                scores.append(model.score(model.features(segments, n)) if model else 0.0)
                good = [(i, j, e) for i, j, s in segments if (e := model.evidence(s, n)) > -math.log(LEAST_E)]
                at = [m.span() for m in WORD.finditer(text.lower())] if good else []
                passages.append([{"start": at[i][0], "end": at[j][1], "evidence": e} for i, j, e in good])
            yield pa.record_batch({
                "doc_id": b.column(0), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32()),
                "passages": pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))),
            })

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int, passages array<struct<start:bigint,end:bigint,evidence:double>>")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score under the threshold; columns are kept. Without a model all rows stay.

    Each row is judged by its own text, repeated rows alike; a null or empty text is scored as a text without a word. An
    empty table stays empty.
    """
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model.weights)
        for b in batches:
            yield b.filter(pa.array([model.score(model.features(*_scan(x.as_py() or "", weights))) < threshold for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
