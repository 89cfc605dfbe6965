"""Fill-in-the-middle: texts cut at two drawn word borders and put together anew, with marks, so that the middle comes last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
#: Characters of results after which a batch is handed on.
BATCH_CHARS = 4_000_000


def borders(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text, and where its units end: a unit is a word with the white space before it, or the white space
    at the very end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (points == 0x20) | (points - 9 <= 4)  # unsigned: below 9 wraps to very large
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return points, np.append(ends, len(points)) if len(points) else ends


def _piece(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def infill(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    n units, the form and both cuts follow from the seed and the doc_id alone: of the hex sha256 of ``seed:doc_id`` the first
    two groups of eight digits give the cuts, the third whether a text is changed (in ``rate`` of 100), the fourth whether
    its suffix comes first (``spm``, in ``spm_rate`` of 100) or its prefix (``psm``). Texts that hold one of the marks, and
    null and empty texts, are ``plain``: output is the text (empty for null) and the lengths are null. A null doc_id is
    written as nothing after the colon; rows that share a doc_id are each cut by the same draws. A text without white space
    is one unit, however long; other columns are not looked at; an empty table gives an empty one.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, x, *h in zip(*b.columns, strict=True):
                text, h = x.as_py() or "", [v.as_py() for v in h]
                points, ends = borders(text)
                n = len(ends)
                if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((doc_id.as_py(), n, "plain", None, None, text))
                else:
                    at = np.append(0, ends)
                    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    prefix, middle, suffix = (_piece(points[i:j]) for i, j in ((0, at[low]), (at[low], at[high]), (at[high], len(points))))
                    spm = h[3] % 100 < spm_rate
                    first, second = (SUFFIX + suffix, PREFIX + prefix) if spm else (PREFIX + prefix, SUFFIX + suffix)
                    rows.append((doc_id.as_py(), n, "spm" if spm else "psm", len(prefix), len(middle), first + second + MIDDLE + middle))
                held += len(text)
                if held > BATCH_CHARS:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("bigint"), "text", *draws).mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, types = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Its pieces hold no mark, and no mark can arise over the border of two."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, middle = (F.get(pieces, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
