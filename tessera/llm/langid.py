"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with an elastic-net penalty on a bounded sample of documents of each language,
then calibrated by a temperature on the part of the sample that training did not see.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

LETTER = regex.compile(r"\p{L}")
#: Bound of the sample that the model is fitted on: documents of each language, drawn by a hash of the id.
PER_LANGUAGE = 1500
#: Hashed features; n-grams of 1 to 3 characters.
BITS = 15
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 3
PART = 1 << 20
_ASCII = np.full(128, 32, np.uint64)
_ASCII[97:123] = np.arange(97, 123)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and counts of the lower-cased text; ASCII characters other than letters count as spaces."""
    counts = np.zeros(1 << BITS, np.int64)
    for i in range(0, len(text), PART):  # parts overlap by two characters, so that no n-gram is lost
        piece = text[max(i - 2, 0) : i + PART].lower()
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        low = c < 128
        c[low] = _ASCII[c[low]]
        h = c
        for n in (1, 2, 3):
            if n > 1:
                h = h[:-1] * np.uint64(0x110001) + c[n - 1 :]
            new = h[max(3 - n, 0) if i else 0 :]
            counts += np.bincount(((new + np.uint64(n)) * _MULTIPLY >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    some = np.flatnonzero(counts)
    return some, counts[some]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, n = gram_counts(text)
        x = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt(x @ x)
        return (x / norm if norm else x) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its calibrated probability; ``und`` and 0 for a text without a letter."""
        if not text or not LETTER.search(text) or not self.languages:
            return "und", 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, str, int]]) -> Model:
    """Fit on (features, counts, lang, order); rows of one fifth of the orders are kept for the temperature."""
    rows = sorted(rows, key=lambda r: (r[3], r[2], r[0].tobytes()))
    languages = sorted({r[2] for r in rows})
    size = 1 << BITS
    seen = [(at, n, languages.index(lang), o % 5 == 0) for at, n, lang, o in rows if len(at)]
    df = np.zeros(size)
    for at, _, _, held in seen:
        if not held:
            df[at] += 1
    n = sum(not held for *_, held in seen)
    idf = np.log((1 + n) / (1 + df)) + 1
    data = []
    for at, count, y, held in seen:
        x = (1 + np.log(count)) * idf[at]
        data.append((at, x / np.sqrt(x @ x), y, held))
    k = len(languages)
    z, g2 = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias, which no penalty holds

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for at, x, y, held in data:
            if held:
                continue
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - step * w
            g2[at] += g * g
    full = weights(np.arange(size + 1))
    model = Model(languages, idf, full[:-1], full[-1])
    held = [(x @ model.weights[at] + model.bias, y) for at, x, y, h in data if h]
    if held:
        s, y = np.array([a for a, _ in held]), np.array([b for _, b in held])

        def loss(log_t: float) -> float:
            q = s / np.exp(log_t)
            q = q - q.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]))

        grid = np.linspace(-3, 3, 241)
        model.temperature = float(np.exp(grid[np.argmin([loss(t) for t in grid])]))
    return model


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on text and lang of documents whose crc32(doc_id) mod 4 is not 2, at most about ``per_language`` of each.

    Texts become counts of features where they lie; only these go to the one task that fits: at most 2 ** ``BITS`` of them
    for a text, whatever its length, and ``per_language`` texts for a language. None without a row.
    """
    ours = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), 4) != 2)
    rates = ours.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = ours.select("doc_id", "text", "lang").join(F.broadcast(rates), "lang").where(draw < F.col("rate") * 1_000_000)  # a row per language
    sample = sample.select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)).alias("place"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [gram_counts(x.as_py()) for x in b.column(0)]
            yield pa.record_batch({"at": pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()), "n": pa.array([n.astype("<i8").tobytes() for _, n in found], pa.binary()), "lang": b.column(1), "place": b.column(2)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<i8"), r["lang"], r["place"]) for b in batches for r in b.to_pylist()]
        if rows:
            yield pa.record_batch({"model": pa.array([pickle.dumps(train(rows))], pa.binary())})

    counted = sample.mapInArrow(count, "at binary, n binary, lang string, place bigint")
    made = counted.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score), one row per row. Without a model all are ``und``.

    Null, empty and letterless texts are ``und`` with score 0; the whole text counts, whatever its length. Repeated rows and
    rows without a doc_id are judged alike; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.predict(x.as_py()) if model else ("und", 0.0) for x in b.column(1)]
            yield pa.record_batch({"doc_id": b.column(0), "lang_pred": pa.array([x for x, _ in out], pa.string()), "score": pa.array([s for _, s in out], pa.float64())})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a probability of ``least`` or more; columns are kept.

    Null, empty and letterless texts go, and without a model all rows do. Repeated rows are judged alike. An empty table
    stays empty.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(x.as_py()) if model else ("und", 0.0) for x in b.column(at)]
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
