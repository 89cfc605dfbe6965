"""Windows of source files, and counts of tokens, under a token budget.

Spark deals out documents; what runs per document is one pass over its lines. Tokens are counted by any tokenizer that
gives spans; without one, words and single signs count.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Spans = Callable[[str], list[tuple[int, int]]]
CRUMB = " › "


@dataclass(frozen=True)
class Budget:
    """Tokens of a chunk: aimed at, allowed, repeated from the one before, too few; lines of a code chunk, repeated ones."""

    target: int = 450
    hard: int = 1000
    overlap: int = 64
    lines: int = 40
    repeat: int = 4
    least: int = 96


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]


class Counted:
    """A text whose tokens are found once; how many start between two places is a search in their starts."""

    def __init__(self, text: str, spans: Spans):
        self.text = text
        self.starts = [a for a, _ in spans(text)]

    def tokens(self, a: int, b: int) -> int:
        return bisect_left(self.starts, b) - bisect_left(self.starts, a)


def code_windows_of(lines: list[str], sizes: list[int], head: int, budget: Budget) -> list[tuple[int, int]]:
    """Windows (first line, end) of a file: whole lines up to the target, after as many repeated ones as the hard limit allows.

    ``sizes`` are the lines' tokens, ``head`` those of what stands above each window. A window has at most ``budget.lines``
    lines; a line that does not fit the hard limit by itself cannot be put anywhere, which is an error.
    """
    sums = list(accumulate(sizes, initial=head))
    tokens = lambda a, b: head + sums[b] - sums[a]
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(lines):
        start = at
        if out:
            start = next((at - r for r in range(min(budget.repeat, at, budget.lines - 1), 0, -1) if tokens(at - r, at + 1) <= budget.hard), at)
        if tokens(start, at + 1) > budget.hard:
            raise ValueError("a line of code is over the hard limit")
        end = at + 1
        while end < len(lines) and end + 1 - start <= budget.lines and tokens(start, end + 1) <= budget.target:
            end += 1
        # a first line under the least size takes the next one along, up to the hard limit
        if at == 0 and end == 1 and len(lines) > 1 and budget.lines > 1 and tokens(0, 1) < budget.least and tokens(0, 2) <= budget.hard:
            end = 2
        out.append((start, end))
        at = end
    return out


def code_windows(files: DataFrame, budget: Budget = Budget(), spans: Spans = word_spans, kept: Sequence[str] = ()) -> DataFrame:
    """(document_id, path, text) -> (document_id, part_index, part_total, line_start, line_end, text, token_count), beside
    the columns ``kept``.

    Each window opens with the file's path, which counts towards its tokens. Lines count from 1; null and empty texts have
    no window.
    """
    schema = "array<struct<line_start:int,line_end:int,text:string,token_count:int>>"

    @F.pandas_udf(schema)
    def cut(paths: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for path, text in zip(paths, texts, strict=True):
            lines = text.split("\n") if text else []
            starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
            t = Counted(text, spans)
            sizes = [t.tokens(a, b) for a, b in pairwise(starts)]
            rows = []
            for a, b in code_windows_of(lines, sizes, len(spans(path)), budget):
                whole = path + "\n\n" + "\n".join(lines[a:b])
                rows.append({"line_start": a + 1, "line_end": b, "text": whole, "token_count": len(spans(whole))})
            out.append(rows)
        return pd.Series(out)

    made = files.select("document_id", *kept, cut(F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))).alias("c"))
    return made.select("document_id", *kept, F.size("c").alias("part_total"), F.posexplode("c").alias("part_index", "c")).select("document_id", *kept, "part_index", "part_total", "c.*")


def line_windows(files: DataFrame, lines: int = 40, repeat: int = 4) -> DataFrame:
    """(document_id, text) -> (document_id, line_start, line_end, text): windows of whole lines, lines counted from 1.

    Each window repeats the last lines of the one before. All in column expressions.
    """
    step = lines - repeat
    if repeat < 0 or step < 1:
        raise ValueError("windows must be longer than what they repeat")
    split = files.where("text IS NOT NULL").select("document_id", F.split("text", "\n").alias("l"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("l") - 1 - repeat, F.lit(0)), F.lit(step))
    rows = split.select("document_id", "l", F.explode(starts).alias("s"))
    return rows.select("document_id", (F.col("s") + 1).alias("line_start"), F.least(F.col("s") + lines, F.size("l")).alias("line_end"), F.array_join(F.slice("l", F.col("s") + 1, lines), "\n").alias("text"))


def chunk_report(chunks: DataFrame, by: str = "content_kind") -> DataFrame:
    """Per kind and in all (null): chunks, least, greatest, median and 95th percentile of tokens, by nearest rank."""
    return chunks.rollup(by).agg(
        F.count("*").alias("chunks"), F.min("token_count").alias("least"), F.max("token_count").alias("most"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY token_count)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY token_count)").alias("p95"),
    )
