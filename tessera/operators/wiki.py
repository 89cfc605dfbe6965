"""Sections of wiki pages and their chunks under a token budget: small neighbours merged, large blocks cut, rows continued.

The tokens of a page are found once; a count is then a difference of two places among their starts. That takes a
tokenizer that joins nothing over white space or before a sign; words and single signs count by default. Spark deals out
pages; what runs per page is linear in its length but for searches in sorted places.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.batches import few_rows
from tessera.functions.ids import chunk_id, content_hash
from tessera.functions.text import row_cells, tidy
from tessera.operators.chunking import CRUMB, Budget, Spans, word_spans

# Fixed by the chunk format: what makes structure, where prose may be cut, and the words of a row's continuation.
HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?[ \t]*")
FENCE = re.compile(r"[ \t]*(`{3,})[^`]*")
RULE_CELL = re.compile(r"\s*-{3,}\s*")
BREAKS = (re.compile(r"\n{2}"), re.compile(r"[.!?。！？](?:\s+|$)"), re.compile(r"\n"))
ENTRY = "[table-continuation v1 table={0} row={1} column={2} header_ordinal={2} part={3}/{4}]"
END = "[/]"
FIXED_POINT = 8


class Fault(ValueError):
    """A page that cannot be chunked; the message is a category, never content."""


@dataclass
class Block:
    kind: str
    start: int
    end: int
    lines: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Section:
    path: tuple[str, ...]
    level: int | None
    parent: int
    blocks: list[Block] = field(default_factory=list)


def _bars(line: str) -> int:
    return len(re.findall(r"\\.|(\|)", line)) - len(re.findall(r"\\.", line)) if "\\" in line else line.count("|")


def sections(title: str, text: str) -> list[Section]:
    """Sections of a canonical text, in order: what precedes the first heading if that is anything, then one per heading.

    Headings of three levels part sections, deeper ones are prose. A fence must be closed and a heading named. A table has a
    rule of as many cells as its head and each of its rows, and no indent; what only looks like one is prose.
    """
    if not title.strip():
        raise Fault("invalid_page_title")
    lines, at, places = text.split("\n") if text else [], 0, []
    for line in lines:
        places.append((at, at + len(line)))
        at += len(line) + 1
    out = [Section((title,), None, -1)]
    open_: list[tuple[int, int, str]] = []  # level, place in out, label
    prose: list[int] = []

    def flush() -> None:
        used = [i for i in prose if lines[i]]
        if used:
            out[-1].blocks.append(Block("prose", places[used[0]][0], places[used[-1]][1]))
        prose.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if fence := FENCE.fullmatch(line):
            end = next((j for j in range(i + 1, len(lines)) if len(lines[j].strip()) >= len(fence[1]) and not lines[j].strip().strip("`")), None)
            if end is None:
                raise Fault("unclosed_code_fence")
            flush()
            out[-1].blocks.append(Block("code_block", places[i][0], places[end][1], places[i : end + 1]))
            i = end + 1
            continue
        heading = HEADING.fullmatch(line)
        if heading and len(heading[1]) <= 3:
            label = (heading[2] or "").strip()
            if not label:
                raise Fault("empty_structural_heading")
            flush()
            level = len(heading[1])
            while open_ and open_[-1][0] >= level:
                open_.pop()
            parent = open_[-1][1] if open_ else -1
            open_.append((level, len(out), label))
            out.append(Section((title, *(x for _, _, x in open_)), level, parent))
            i += 1
            continue
        end = _table_end(lines, i)
        if end:
            flush()
            out[-1].blocks.append(Block("table", places[i][0], places[end - 1][1], places[i:end]))
            i = end
            continue
        prose.append(i)
        i += 1
    flush()
    return out if out[0].blocks else out[1:]


def _table_end(lines: list[str], i: int) -> int:
    """The line behind the table that begins at line i, or 0."""
    if i + 1 == len(lines) or "|" not in lines[i] or any(x[:1] in (" ", "\t") or not _bars(x) for x in lines[i : i + 2]):
        return 0
    rule, width = row_cells(lines[i + 1]), len(row_cells(lines[i]))
    if len(rule) != width or not all(RULE_CELL.fullmatch(c) for c in rule):
        return 0
    j = i + 2
    while j < len(lines) and lines[j][:1] not in ("", " ", "\t") and _bars(lines[j]) and not FENCE.fullmatch(lines[j]):
        heading = HEADING.fullmatch(lines[j])
        if heading and len(heading[1]) <= 3:
            break
        j += 1
    return j if all(len(row_cells(x)) == width for x in lines[i + 2 : j]) else 0


@dataclass
class Part:
    path: tuple[str, ...]
    kind: str
    unit: str
    body: str
    index: int | None = None
    total: int | None = None


class Pager:
    """The chunks of one page."""

    def __init__(self, title: str, text: str, budget: Budget, spans: Spans):
        self.text, self.budget, self.spans = text, budget, spans
        self.sections = sections(title, text)
        found = spans(text)
        self.starts, self.ends = [a for a, _ in found], [z for _, z in found]
        self.counts: Counter[str] = Counter()

    def tokens(self, a: int, z: int) -> int:
        return bisect_left(self.starts, z) - bisect_left(self.starts, a)

    def size(self, text: str) -> int:
        return len(self.spans(text))

    def parts(self) -> Iterator[Part]:
        i = 0
        while i < len(self.sections):
            s = self.sections[i]
            if s.level is not None and not s.blocks:
                self.counts["empty_sections_skipped"] += 1
                i += 1
            elif self.mergeable(s):
                body, i = self.merged(i)
                yield from self.cut(s, Block("prose", s.blocks[0].start, s.blocks[0].end), CRUMB.join(s.path), 0, body)
            else:
                of: Counter[str] = Counter()
                for b in s.blocks:
                    crumb = CRUMB.join(s.path)
                    unit = crumb if b.kind == "prose" else f"{crumb}#{b.kind.removesuffix('_block')}{of[b.kind]}"
                    yield from self.cut(s, b, unit, of[b.kind])
                    of[b.kind] += 1
                i += 1

    @staticmethod
    def mergeable(s: Section) -> bool:
        return s.level in (2, 3) and [b.kind for b in s.blocks] == ["prose"]

    def merged(self, i: int) -> tuple[str, int]:
        """The body of a section under the least size, with the neighbours that it takes in, and the next section's place.

        Neighbours are sections of prose of the same level under the same heading, each right behind the last one.
        """
        s = self.sections[i]
        body, n = self.text[s.blocks[0].start : s.blocks[0].end], self.size(CRUMB.join(s.path)) + self.tokens(s.blocks[0].start, s.blocks[0].end)
        i += 1
        while n < self.budget.least and i < len(self.sections):
            other = self.sections[i]
            if not self.mergeable(other) or other.level != s.level or other.parent != s.parent:
                break
            heading = f"{'#' * other.level} {other.path[-1]}"
            block = other.blocks[0]
            more = self.size(heading) + self.tokens(block.start, block.end)
            if n + more > self.budget.hard:
                break
            body, n, i = f"{body}\n\n{heading}\n\n{self.text[block.start : block.end]}", n + more, i + 1
            self.counts["sections_merged"] += 1
        return body, i

    def cut(self, s: Section, b: Block, unit: str, ordinal: int, body: str | None = None) -> Iterator[Part]:
        crumb = self.size(tidy(CRUMB.join(s.path)))
        if crumb >= self.budget.hard:
            raise Fault("breadcrumb_over_hard_max")
        if crumb + self.tokens(b.start, b.end) <= self.budget.hard:
            yield Part(s.path, b.kind, unit, self.text[b.start : b.end] if body is None else body)
            return
        self.counts["oversize_splits"] += 1
        self.counts[f"{b.kind.removesuffix('_block')}_split_units"] += 1
        bodies = list({"prose": self.cut_prose, "code_block": self.cut_code, "table": self.cut_table}[b.kind](b, crumb, ordinal))
        if len(bodies) < 2:
            raise Fault("chunk_budget_violation")
        for n, x in enumerate(bodies):
            yield Part(s.path, b.kind, unit + {"prose": f"#w{n}", "table": f"#g{n}", "code_block": ""}[b.kind], x, n, len(bodies))

    # ---- prose

    def ranges(self, a: int, z: int, crumb: int, level: int = 0) -> Iterator[tuple[int, int]]:
        """Paragraphs, else sentences, else lines, else runs of tokens, as large as the hard limit allows to stay whole."""
        if crumb + self.tokens(a, z) <= self.budget.hard:
            yield a, z
        elif level < len(BREAKS):
            inner = [m.end() for m in BREAKS[level].finditer(self.text, a, z) if a < m.end() < z]
            for x, y in zip([a, *inner], [*inner, z], strict=True):
                yield from self.ranges(x, y, crumb, level + 1)
        else:
            self.counts["tokenizer_boundary_fallbacks"] += 1
            room = self.budget.target - crumb if self.budget.target > crumb else self.budget.hard - crumb
            while crumb + self.tokens(a, z) > self.budget.hard:
                end = self.ends[bisect_left(self.starts, a) + room - 1]
                yield a, end
                a = end
            yield a, z

    def cut_prose(self, b: Block, crumb: int, _: int) -> Iterator[str]:
        """Windows of whole ranges up to the target; each repeats the end of what the last one added."""
        cuts = list(self.ranges(b.start, b.end, crumb))
        ends = [z for _, z in cuts]
        i, before = 0, None
        while i < len(cuts):
            a = cuts[i][0]
            start = a if before is None else self.overlap(before, a, crumb + self.tokens(*cuts[i]))
            held = lambda z, start=start: crumb + self.tokens(start, z)
            j = bisect_right(ends, self.budget.target, lo=i, key=held)
            if j == i:
                j = i + 1
                if held(ends[i]) > self.budget.hard:
                    start = a
            self.counts["overlap_windows"] += start < a
            yield self.text[start : ends[j - 1]]
            before, i = a, j

    def overlap(self, before: int, a: int, first: int) -> int:
        """Where the text that is repeated begins: the longest end of text[before:a] that fits, whole paragraphs if any fit,
        else sentences, lines, tokens; ``a`` if nothing does. ``first`` counts the crumb and the first new range."""
        room = min(self.budget.overlap, (self.budget.target if first <= self.budget.target else self.budget.hard) - first)
        if room < 0:
            return a
        for pattern in (*BREAKS, None):
            inner = [m.end() for m in pattern.finditer(self.text, before, a)] if pattern else self.starts[bisect_left(self.starts, before) : bisect_left(self.starts, a)]
            starts = [before, *(x for x in inner if before < x < a)]
            k = bisect_left(starts, -room, key=lambda x: -self.tokens(x, a))
            if k < len(starts) and self.text[starts[k] : a].strip():
                return starts[k]
        return a

    # ---- code and tables

    def cut_code(self, b: Block, crumb: int, _: int) -> Iterator[str]:
        """Runs of lines between the fences; each repeats the last lines of the one before as far as its first line allows."""
        opening, *body, closing = b.lines
        if not body:
            raise Fault("unsplittable_code_line")
        base = crumb + self.tokens(*opening) + self.tokens(*closing)
        limit, raw = self.budget, lambda x: self.text[x[0] : x[1]]
        size = lambda i, j: base + self.tokens(body[i][0], body[j - 1][1])
        i, last = 0, 0
        while i < len(body):
            most = limit.target if size(i, i + 1) <= limit.target else limit.hard
            start = next((i - r for r in range(min(limit.repeat, last, limit.lines - 1), -1, -1) if size(i - r, i + 1) <= most), None)
            if start is None:
                raise Fault("unsplittable_code_line")
            j = bisect_right(range(i + 1, min(len(body), start + limit.lines) + 1), limit.target, key=lambda j, start=start: size(start, j)) + i
            j = max(j, i + 1)
            yield "\n".join([raw(opening), *map(raw, body[start:j]), raw(closing)])
            last, i = j - start, j

    def cut_table(self, b: Block, crumb: int, ordinal: int) -> Iterator[str]:
        """Runs of rows under the head; a row that fits nowhere is continued cell by cell."""
        head, rows = b.lines[:2], b.lines[2:]
        base = crumb + self.tokens(head[0][0], head[1][1])
        if base > self.budget.hard or not rows:
            raise Fault("unsplittable_table_header")
        top = self.text[head[0][0] : head[1][1]]
        i = 0
        while i < len(rows):
            if base + self.tokens(*rows[i]) > self.budget.hard:
                self.counts["table_row_continuation_units"] += 1
                for entries in self.continued(rows[i], row_cells(self.text[slice(*head[0])]), base, ordinal, i):
                    yield "\n".join([top, *entries])
                i += 1
                continue
            j = bisect_right(range(i + 1, len(rows) + 1), self.budget.target, key=lambda j, i=i: base + self.tokens(rows[i][0], rows[j - 1][1])) + i
            j = max(j, i + 1)
            while j > i + 1 and base + self.tokens(rows[i][0], rows[j - 1][1]) > self.budget.hard:
                j -= 1
            yield "\n".join([top, self.text[rows[i][0] : rows[j - 1][1]]])
            i = j

    def continued(self, row: tuple[int, int], headers: list[str], base: int, table: int, row_number: int) -> Iterator[list[str]]:
        """Entries of a row's cells: as many together as fit, a cell that fits nowhere in parts that know how many they are."""
        cells = row_cells(self.text[slice(*row)])
        if len(cells) != len(headers):
            raise Fault("unsplittable_table_row")
        packed: list[str] = []
        size = base
        for column, cell in enumerate(cells):
            fence = "`" * max([3, *(len(x) + 1 for x in re.findall("`+", cell))])

            def entry(fragment: str, part: int, total: int, column=column, fence=fence) -> str:
                return "\n".join([ENTRY.format(table, row_number, column, part, total), fence, fragment + END, fence])

            n = self.size(entry(cell, 1, 1))
            if base + n > self.budget.hard:
                if packed:
                    yield packed
                packed, size = [], base
                fragments = self.fragments(cell, base, entry)
                for part, x in enumerate(fragments, 1):
                    yield [entry(x, part, len(fragments))]
                continue
            if packed and size + n > self.budget.hard:
                yield packed
                packed, size = [], base
            packed.append(entry(cell, 1, 1))
            size += n
        if packed:
            yield packed

    def fragments(self, cell: str, base: int, entry: Callable[[str, int, int], str]) -> list[str]:
        """A cell in the longest runs of tokens that fit beside the mark of the last of so many parts; how many there are
        follows from the marks' length, which settles at once."""
        starts = [a for a, _ in self.spans(cell)]
        total = 1
        for _ in range(FIXED_POINT):
            room = self.budget.hard - base - self.size(entry("", total, total))
            if room < 1:
                raise Fault("unsplittable_table_row")
            cuts = [0, *starts[room::room], len(cell)]
            if len(cuts) - 1 == total:
                return [cell[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
            total = len(cuts) - 1
        raise Fault("unsplittable_table_row")


#: Counters of a page, by name.
COUNTERS = ("sections_merged", "oversize_splits", "empty_sections_skipped", "prose_split_units", "table_split_units", "table_row_continuation_units", "code_split_units", "overlap_windows", "tokenizer_boundary_fallbacks")


def chunk_page(title: str, text: str, budget: Budget, spans: Spans = word_spans) -> tuple[list[dict], dict[str, int]]:
    """Chunks of a canonical text in order, and counters. A chunk opens with the headings above it. A page that breaks a rule
    is a ``Fault``. ``again`` numbers chunks of equal unit and text."""
    p = Pager(title, text, budget, spans)
    seen: Counter[tuple[str, str]] = Counter()
    out = []
    for part in p.parts():
        whole = tidy(f"{CRUMB.join(part.path)}\n\n{part.body}")
        n = len(spans(whole))
        if n > budget.hard:
            raise Fault("chunk_budget_violation")
        out.append({"heading_path": list(part.path), "content_kind": part.kind, "text": whole, "token_count": n, "unit_key": part.unit, "again": seen[part.unit, whole], "part_index": part.index, "part_total": part.total})
        seen[part.unit, whole] += 1
    return out, {k: p.counts[k] for k in COUNTERS}


_FIELDS = {"heading_path": "array<string>", "content_kind": "string", "text": "string", "token_count": "int", "unit_key": "string", "again": "int", "part_index": "int", "part_total": "int"}
_ARROW = {"array<string>": pa.list_(pa.string()), "string": pa.string(), "int": pa.int32()}


def markdown(body: str) -> tuple[str | None, str]:
    """A body that is Markdown already and brings no title."""
    return None, body


def chunk_pages(pages: DataFrame, body: str = "text", budget: Budget = Budget(), read: Callable[[str], tuple[str | None, str]] = markdown, spans: Spans = word_spans, keep: Sequence[str] = ()) -> DataFrame:
    """(document_id, title, ``body``) -> (document_id, title, chunks, counters, fault), one row per page, in one pass; and
    columns to keep.

    ``read`` turns a body into title and Markdown, which is brought into canonical form; a title in the table goes first.
    A null body has no chunks and no fault. Without a column ``title`` all titles are those of the bodies.
    """
    titled = F.col("title") if "title" in pages.columns else F.lit(None)
    chunk_type = pa.list_(pa.struct([(k, _ARROW[v]) for k, v in _FIELDS.items()]))

    def one(title: str | None, x: str | None) -> tuple[list | None, list | None, str | None]:
        if x is None:
            return [], None, None
        found, text = read(x)
        try:
            chunks, counters = chunk_page(title or found or "", tidy(text), budget, spans)
        except Fault as e:
            return None, None, str(e)
        return chunks, list(counters.items()), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            made = [one(t.as_py(), x.as_py()) for t, x in zip(b.column(1), b.column(2), strict=True)]
            chunks, counters, faults = zip(*made, strict=True) if made else ((), (), ())
            new = [pa.array(chunks, chunk_type), pa.array(counters, pa.map_(pa.string(), pa.int64())), pa.array(faults, pa.string())]
            yield pa.record_batch([b.column(0), b.column(1), *new, *b.columns[3:]], names=["document_id", "title", "chunks", "counters", "fault", *keep])

    struct = ",".join(f"{k}:{v}" for k, v in _FIELDS.items())
    rest = pages.select(*keep)
    schema = ", ".join([f"document_id string, title string, chunks array<struct<{struct}>>, counters map<string,bigint>, fault string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)])
    return pages.select(F.col("document_id").cast("string"), titled.cast("string").alias("title"), F.col(body).cast("string").alias("__body"), *keep).mapInArrow(run, schema)


def chunk_rows(made: DataFrame, system: str = "confluence") -> DataFrame:
    """Pages of ``chunk_pages`` -> a row per chunk, with ids; equal chunks of a page get ``-1``, ``-2`` ... in their order."""
    rows = made.select("document_id", F.posexplode("chunks").alias("chunk_index", "c")).select("document_id", "chunk_index", "c.*")
    plain = chunk_id(F.lit(system), F.col("document_id"), F.col("unit_key"), F.col("text"))
    return rows.select(
        F.when(F.col("again") > 0, F.concat_ws("-", plain, "again")).otherwise(plain).alias("chunk_id"), "document_id", "chunk_index", "heading_path", "content_kind", "text", "token_count", "part_index",
        "part_total", content_hash(F.col("text")).alias("content_hash"),
    )


def chunk_counters(made: DataFrame, names: Sequence[str] = COUNTERS) -> DataFrame:
    """One row: pages, those with a fault, and the sums of their counters."""
    sums = [F.coalesce(F.sum(F.try_element_at("counters", F.lit(n))), F.lit(0)).alias(n) for n in names]
    return made.agg(F.count("*").alias("pages"), F.count("fault").alias("faults"), *sums)
