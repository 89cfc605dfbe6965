"""Chunks of wiki pages against a plain version that counts whole strings at every step, and small cases of each rule."""

from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.functions import markup, storage
from tessera.functions.text import row_cells, tidy
from tessera.operators.chunking import Budget, word_spans
from tessera.operators.wiki import END, Fault, chunk_counters, chunk_page, chunk_pages, chunk_rows, sections

SMALL = Budget(target=40, hard=70, overlap=8, lines=6, repeat=2, least=15)


def count(text: str) -> int:
    return len(word_spans(tidy(text)))


class Brute:
    """``tree``: [(level or None, label, [block])], a block is (kind, text, lines)."""

    def __init__(self, title: str, tree: list, b: Budget):
        self.b, self.out, path = b, [], []
        nodes = []
        for i, (level, label, blocks) in enumerate(tree):
            if level is not None:
                path = [(n, x, j) for n, x, j in path if n < level]
            nodes.append((level, label, blocks, path[-1][2] if path else -1, " › ".join([title, *(x for _, x, _ in path), *([label] if level else [])])))
            if level is not None:
                path = [*path, (level, label, i)]
        prose = lambda n: n[0] in (2, 3) and len(n[2]) == 1 and n[2][0][0] == "prose"
        i = 0
        while i < len(nodes):
            level, _, blocks, parent, crumb = nodes[i]
            i += 1
            if prose(nodes[i - 1]):
                body = blocks[0][1]
                while count(f"{crumb}\n\n{body}") < b.least and i < len(nodes) and prose(nodes[i]) and nodes[i][0] == level and nodes[i][3] == parent:
                    trial = f"{body}\n\n{'#' * level} {nodes[i][1]}\n\n{nodes[i][2][0][1]}"
                    if count(f"{crumb}\n\n{trial}") > b.hard:
                        break
                    body, i = trial, i + 1
                self.put("prose", crumb, crumb, body, None, 0)
                continue
            seen = {"table": 0, "code_block": 0, "prose": 0}
            for kind, text, lines in blocks:
                self.put(kind, crumb, {"prose": crumb, "table": f"{crumb}#table{seen[kind]}", "code_block": f"{crumb}#code{seen[kind]}"}[kind], text, lines, seen[kind])
                seen[kind] += 1

    def put(self, kind, crumb, unit, body, lines, ordinal):
        self.n = lambda x: count(f"{crumb}\n\n{x}")
        if self.n(body) <= self.b.hard:
            self.out.append((kind, unit, tidy(f"{crumb}\n\n{body}"), None, None))
            return
        made = {"prose": self.prose, "code_block": self.code, "table": self.table}[kind](body, lines, ordinal)
        for j, x in enumerate(made):
            self.out.append((kind, unit + {"prose": f"#w{j}", "table": f"#g{j}", "code_block": ""}[kind], tidy(f"{crumb}\n\n{x}"), j, len(made)))

    def fine(self, text, level=0):
        if self.n(text) <= self.b.hard:
            return [text]
        if level == 3:
            out = []
            while self.n(text) > self.b.hard:
                best = max((z for _, z in word_spans(text) if self.n(text[:z]) <= self.b.target), default=None) or max(z for _, z in word_spans(text) if self.n(text[:z]) <= self.b.hard)
                out, text = [*out, text[:best]], text[best:]
            return [*out, text]
        pieces = re.split([r"(?<=\n\n)", r"((?<=[.!?])(?:\s+))", r"(?<=\n)"][level], text)
        if level == 1:
            pieces = ["".join(pieces[k : k + 2]) for k in range(0, len(pieces), 2)]
        return [y for p in pieces if p for y in self.fine(p, level + 1)]

    def tail(self, before, new):
        bound = self.b.target if self.n(new) <= self.b.target else self.b.hard
        for pattern in (r"\n{2}", r"[.!?](?:\s+|$)", r"\n", None):
            starts = {0, *([m.end() for m in re.finditer(pattern, before)] if pattern else [a for a, _ in word_spans(before)])}
            good = [s for s in starts if tidy(before[s:]).strip() and count(before[s:]) <= self.b.overlap and self.n(before[s:] + new) <= bound]
            if good:
                return before[min(good) :]
        return ""

    def prose(self, body, *_):
        todo, out, before = self.fine(body), [], ""
        while todo:
            over = self.tail(before, todo[0]) if before else ""
            fits = [k for k in range(1, len(todo) + 1) if self.n(over + "".join(todo[:k])) <= self.b.target]
            if not fits and self.n(over + todo[0]) > self.b.hard:
                over = ""
            k = max(fits, default=1)
            before = "".join(todo[:k])
            out.append(over + before)
            todo = todo[k:]
        return out

    def code(self, _, lines, ordinal):
        first, *body, last = lines
        whole, out, i, before = (lambda x: "\n".join([first, *x, last])), [], 0, []
        while i < len(body):
            most = self.b.target if self.n(whole([body[i]])) <= self.b.target else self.b.hard
            held = next(before[len(before) - r :] for r in range(min(self.b.repeat, len(before), self.b.lines - 1), -1, -1) if self.n(whole([*before[len(before) - r :], body[i]])) <= most)
            fits = [j for j in range(i + 1, min(len(body), i + self.b.lines - len(held)) + 1) if self.n(whole([*held, *body[i:j]])) <= self.b.target]
            j = max(fits, default=i + 1)
            before = [*held, *body[i:j]]
            out.append(whole(before))
            i = j
        return out

    def table(self, _, lines, ordinal):
        top, rows, out, i = lines[:2], lines[2:], [], 0
        whole = lambda x: "\n".join([*top, *x])
        while i < len(rows):
            if self.n(whole([rows[i]])) > self.b.hard:
                out += [whole(x) for x in self.row(whole, rows[i], ordinal, i)]
                i += 1
                continue
            j = max([j for j in range(i + 1, len(rows) + 1) if self.n(whole(rows[i:j])) <= self.b.target], default=i + 1)
            out.append(whole(rows[i:j]))
            i = j
        return out

    def row(self, whole, row, ordinal, i):
        out, packed = [], []
        for c, cell in enumerate(row_cells(row)):
            fence = "`" * max(3, max(map(len, re.findall("`+", cell)), default=0) + 1)
            entry = lambda x, p, n, c=c, fence=fence: f"[table-continuation v1 table={ordinal} row={i} column={c} header_ordinal={c} part={p}/{n}]\n{fence}\n{x}{END}\n{fence}"
            if self.n(whole([entry(cell, 1, 1)])) <= self.b.hard:
                if self.n(whole([*packed, entry(cell, 1, 1)])) > self.b.hard:
                    out, packed = [*out, packed], []
                packed.append(entry(cell, 1, 1))
                continue
            out, packed = [*out, *([packed] if packed else [])], []
            total, parts = 1, []
            while len(parts) != total:
                total, parts, rest = max(len(parts), 1), [], cell
                while rest:
                    best = max(p for p in range(1, len(rest) + 1) if self.n(whole([entry(rest[:p], total, total)])) <= self.b.hard)
                    parts, rest = [*parts, rest[:best]], rest[best:]
            out += [[entry(x, p, total)] for p, x in enumerate(parts, 1)]
        return [*out, *([packed] if packed else [])]


def page(rng: random.Random) -> tuple[list, str]:
    """A random tree of sections, and the page that has it."""
    words = lambda n: " ".join(rng.choice(["alpha", "be", "c3", "de,", "é"]) for _ in range(n))
    sentence = lambda: words(rng.randint(1, 12)) + rng.choice([". ", "! ", "\n", "? ", " "])
    tree = []
    for k in range(rng.randint(1, 7)):
        level = None if k == 0 and rng.random() < 0.5 else rng.choice([1, 2, 2, 2, 3, 3])
        blocks = []
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
            kind = rng.choice(["prose", "prose", "prose", "code_block", "table"])
            if kind == "prose" and not (blocks and blocks[-1][0] == "prose"):
                text = tidy("\n\n".join("".join(sentence() for _ in range(rng.choice([1, 1, 2, 8]))).strip() for _ in range(rng.choice([1, 1, 2, 5]))))
                if rng.random() < 0.1:
                    text = words(200)
                blocks.append(("prose", text, None))
            elif kind == "code_block":
                lines = ["```sql", *("x = 1;" * rng.choice([0, 1, 1, 3]) for _ in range(rng.choice([1, 3, 15]))), "```"]
                blocks.append((kind, tidy("\n".join(lines)), tidy("\n".join(lines)).split("\n")))
            elif kind == "table":
                cell = lambda: words(rng.choice([1, 1, 2, 5] + [60] * (rng.random() < 0.1))) if rng.random() < 0.9 else ""
                lines = ["| a | b |", "| --- | --- |", *(f"| {cell()} | {cell()} |" for _ in range(rng.choice([1, 3, 12])))]
                blocks.append((kind, "\n".join(lines), lines))
        if level or blocks:
            tree.append((level, f"H{rng.randint(1, 3)}", blocks))
    text = "\n\n".join(x for level, label, blocks in tree for x in ([f"{'#' * level} {label}"] if level else []) + [b[1] for b in blocks])
    return tree, text


def test_chunks_equal_plain_version():
    rng = random.Random(11)
    seen = set()
    for _ in range(250):
        tree, text = page(rng)
        assert tidy(text) == text
        budget = replace(SMALL, least=rng.choice([1, 15, 40]), overlap=rng.choice([0, 8, 20]), hard=rng.choice([70, 90]))
        got, counters = chunk_page("T", text, budget)
        want = Brute("T", tree, budget).out
        assert [(c["content_kind"], c["unit_key"], c["text"], c["part_index"], c["part_total"]) for c in got] == want
        assert all(c["token_count"] == count(c["text"]) <= budget.hard for c in got)
        seen |= {k for k, v in counters.items() if v}
    assert len(seen) == len(counters)  # each rule was at work


def test_sections():
    text = "pre\n\n# A\n\n#### deep is prose\n\n### C\n\n| a | b\\|c |\n|---|---|\n| 1 | 2 |\nend\n\n| a |\n| -- |\n\n  ```x\n  # no\n  ````\n## B\n\n| a | b |\n| --- | --- |\n| 1 |"
    found = sections("T", text)
    assert [(s.path, s.level, s.parent) for s in found] == [(("T",), None, -1), (("T", "A"), 1, -1), (("T", "A", "C"), 3, 1), (("T", "A", "B"), 2, 1)]
    assert [[b.kind for b in s.blocks] for s in found] == [["prose"], ["prose"], ["table", "prose", "code_block"], ["prose"]]
    assert sections("T", "") == []


@pytest.mark.parametrize(("title", "text", "fault"), [
    (" ", "a", "invalid_page_title"), ("T", "```\na", "unclosed_code_fence"), ("T", "##", "empty_structural_heading"), ("w " * 80, "a", "breadcrumb_over_hard_max"),
    ("T", f"```\n{'x ' * 80}y\n```", "unsplittable_code_line"), ("T", f"| {'h ' * 80}i |\n| --- |\n| a |", "unsplittable_table_header"), ("T", f"| {'h ' * 50}i |\n| --- |\n| {'a ' * 80}b |", "unsplittable_table_row"),
])
def test_faults(title, text, fault):
    with pytest.raises(Fault, match=fault):
        chunk_page(title, text, SMALL)


def test_continued_cells_can_be_put_together():
    cell = " ".join(f"w{i}" for i in range(900)) + " ```` `x`"
    chunks, counters = chunk_page("T", f"| a | b | c |\n| --- | --- | --- |\n| 1 | {cell} |  |", SMALL)
    entries = re.findall(r"\[table-continuation v1 table=0 row=0 column=(\d) header_ordinal=\d part=(\d+)/(\d+)\]\n(`+)\n(.*?)\[/\]\n\4", "\n".join(c["text"] for c in chunks), re.S)
    by = {c: [x for k, _, _, _, x in entries if k == c] for c in "012"}
    assert "".join(by["1"]) == f" {cell} " and by["0"] == [" 1 "] and by["2"] == ["  "] and counters["table_row_continuation_units"] == 1
    assert [(int(p), int(n)) for c, p, n, _, _ in entries if c == "1"] == [(i + 1, len(by["1"])) for i in range(len(by["1"]))]


def test_pages_as_a_table(spark):
    rows = [("d", "T", "## A\n\nsame\n\n## A\n\nsame"), ("e", "T", None), ("f", None, "x"), ("g", "T", "```"), ("h", "T", "")]
    made = chunk_pages(spark.createDataFrame(rows, "document_id string, title string, text string").withColumn("chunks", F.lit(1)), budget=replace(SMALL, least=0))
    out = chunk_rows(made).orderBy("chunk_index").collect()
    assert out[1].chunk_id == out[0].chunk_id + "-1" and len(out) == 2 and out[0].heading_path == ["T", "A"]
    assert {r.document_id: r.fault for r in made.collect()} == {"d": None, "e": None, "f": "invalid_page_title", "g": "unclosed_code_fence", "h": None}
    total = chunk_counters(made).first()
    assert (total.pages, total.faults, total.sections_merged) == (5, 2, 0)
    assert chunk_pages(made.select("document_id", F.lit("x").alias("text")).limit(0)).collect() == []


def test_whole_tables_against_plain_version(spark, sf):
    """Every web page, and every document as a page in storage format: the same ids as from the plain version."""
    from tessera.functions.ids import page_document_id
    from tessera.plans import queries, wiki

    web = spark.read.parquet(f"{sf}/pages.parquet").select(page_document_id(F.col("page_id")).alias("document_id"), "html").collect()
    want = []
    for r in web:
        title, text = markup.render(r.html)
        text, i = tidy(text), 0
        try:
            tree = [(s.level, s.path[-1], [(b.kind, text[b.start : b.end], [text[a:z] for a, z in b.lines]) for b in s.blocks]) for s in sections(title, text)]
        except Fault:
            continue
        want += [(r.document_id, i, x[2]) for i, x in enumerate(Brute(title, tree, Budget()).out)]
    got = [(r.document_id, r.chunk_index, r.text) for r in queries.QUERIES["wiki_chunks"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(want) >= len(web)
    pages = storage.storage_pages(wiki.storage_bodies(spark, sf)).where("fault IS NULL").select(F.col("doc_id").alias("document_id"), F.lit("P").alias("title"), "text")
    made = chunk_pages(pages, budget=SMALL)
    total = chunk_counters(made).first()
    assert total.pages - total.faults == chunk_rows(made).select("document_id").distinct().count() and total.prose_split_units > 50


def test_long_pages_take_linear_time():
    chunk_page("T", tidy("Some words here. " * 60_000), SMALL)
    chunk_page("T", tidy("| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 40_000 + f"| {'w ' * 50_000} | 3 |"), SMALL)
