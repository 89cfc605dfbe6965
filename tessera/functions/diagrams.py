"""Diagrams of boxes and arrows kept as XML: their cells as records, and the same picture as Mermaid text."""

from __future__ import annotations

import html
import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of one diagram file: bytes, boxes, arrows, depth of boxes in boxes.
MOST_BYTES, MOST_BOXES, MOST_ARROWS, MOST_DEPTH = 4 << 20, 10_000, 20_000, 64
UNSAFE = re.compile(rb"<!(?:DOCTYPE|ENTITY)", re.I)


class Page:
    """One page: boxes with their labels and what holds them, arrows between boxes."""

    def __init__(self, name: str | None, number: int, model: ElementTree.Element):
        roots = [x for x in model if x.tag == "root"]
        if len(roots) != 1:
            raise ValueError("a page has one root")
        self.name, self.id = name, name or f"diagram-{number}"
        cells = [c.attrib for c in roots[0] if c.tag == "mxCell"]
        ids = [c.get("id", "") for c in cells]
        if len(set(ids)) < len(ids):
            raise ValueError("an id occurs twice")
        label = lambda c: html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>", "\n", c.get("value", c.get("label", ""))))).strip()
        self.boxes = {c.get("id", ""): label(c) for c in cells if c.get("vertex") == "1"}
        self.held_by = {c.get("id", ""): c.get("parent") for c in cells}
        self.arrows = sorted((c.get("id", ""), c.get("source"), c.get("target"), label(c)) for c in cells if c.get("edge") == "1" and c.get("vertex") != "1")
        if len(self.boxes) > MOST_BOXES or len(self.arrows) > MOST_ARROWS:
            raise ValueError("too many cells")

    def containers(self, cell: str) -> list[str]:
        """The boxes that hold a cell, outermost first."""
        out: list[str] = []
        at = self.held_by.get(cell)
        while at is not None and at in self.held_by:
            if len(out) > MOST_DEPTH or at in out:
                raise ValueError("boxes hold each other or are too deep")
            out.append(at)
            at = self.held_by[at]
        return [x for x in reversed(out) if x in self.boxes]

    def records(self) -> list[dict]:
        boxes = [{"cell_id": i, "container_ids": self.containers(i), "diagram_id": self.id, "kind": "vertex", "label": self.boxes[i]} for i in sorted(self.boxes)]
        return boxes + [{"cell_id": i, "container_ids": self.containers(i), "diagram_id": self.id, "kind": "edge", "source_id": s, "target_id": t} for i, s, t, _ in self.arrows]

    def mermaid(self, named: bool) -> str:
        inside: dict[str | None, list[str]] = {}
        for i in sorted(self.boxes):
            holders = self.containers(i)
            inside.setdefault(holders[-1] if holders else None, []).append(i)
        names: dict[str, str] = {}

        def name(cell: str) -> str:
            if cell not in names:
                plain = re.sub(r"[^A-Za-z0-9_]", "_", cell)
                plain = plain if plain[:1].isalpha() else "n" + plain
                n = sum(x == plain or x.startswith(plain + "_") and x[len(plain) + 1 :].isdigit() for x in names.values())
                names[cell] = f"{plain}_{n}" if plain in names.values() else plain
            return names[cell]

        shown = lambda text: text.replace("\\", "\\\\").replace('"', "&quot;").replace("\n", "<br/>")
        lines = [f"%% {self.name}"] * bool(named and self.name) + ["flowchart TD"]

        def draw(cell: str, depth: int) -> None:
            pad, own = "    " * depth, name(cell)
            if cell in inside:
                lines.append(f'{pad}subgraph {own}["{shown(self.boxes[cell]) or own}"]')
                for c in inside[cell]:
                    draw(c, depth + 1)
                lines.append(f"{pad}end")
            else:
                lines.append(f'{pad}{own}["{shown(self.boxes[cell])}"]' if self.boxes[cell] else pad + own)

        for i in inside.get(None, []):
            draw(i, 1)
        for _, s, t, text in self.arrows:
            if s in self.boxes and t in self.boxes:
                lines.append(f'    {name(s)} -->|"{shown(text)}"| {name(t)}' if text else f"    {name(s)} --> {name(t)}")
        return "\n".join(lines)


def pages(body: bytes) -> list[Page]:
    """The pages of a diagram file; ValueError for what is none: too large, with declarations, packed, or of another shape."""
    if len(body) > MOST_BYTES or UNSAFE.search(body):
        raise ValueError("too large or unsafe")
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        raise ValueError("no XML") from None
    if root.tag == "mxGraphModel":
        return [Page(None, 1, root)]
    if root.tag != "mxfile" or not len(root):
        raise ValueError("no diagram")
    out = []
    for n, d in enumerate(root, 1):
        if d.tag != "diagram" or (d.text or "").strip() or [x.tag for x in d] != ["mxGraphModel"]:
            raise ValueError("a packed or foreign page")
        out.append(Page(d.get("name") or d.get("id"), n, d[0]))
    return out


def describe(body: bytes | None) -> tuple[str | None, str | None, int, int, str | None]:
    """(records as JSON lines, Mermaid, boxes, arrows, fault)."""
    try:
        found = pages(body or b"")
        records = [r for p in sorted(found, key=lambda p: p.id) for r in p.records()]
        drawn = [p.mermaid(len(found) > 1) for p in found if p.boxes or p.arrows]
    except ValueError as e:
        return None, None, 0, 0, str(e)
    lines = "\n".join(json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in records)
    return lines, "\n\n".join(drawn) + "\n" if drawn else None, sum(len(p.boxes) for p in found), sum(len(p.arrows) for p in found), None


def read_diagrams(files: DataFrame) -> DataFrame:
    """(media_id, body) -> (media_id, extracted_text, mermaid, boxes, arrows, fault, digest), one row per row.

    What is no plain diagram file has a fault and nothing else; a null body is one of them.
    """
    schema = "extracted_text string, mermaid string, boxes int, arrows int, fault string"

    @F.pandas_udf(schema)
    def one(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(b) for b in bodies], columns=["extracted_text", "mermaid", "boxes", "arrows", "fault"])

    rows = files.select("media_id", one("body").alias("d")).select("media_id", "d.*")
    return rows.withColumn("digest", F.sha2("extracted_text", 256))
