"""Wiki pages in storage format as Markdown and the references they make, by one strict pass of an XML parser.

Open elements stand on a stack of frames. A frame gathers what its content becomes; when its element ends it is folded into the
one below. Whatever is to be told of a page (macros, warnings, references, faults) travels along with the text, in the
order of the result, so that content which a page does not show takes what it told with it. A page that breaks a rule
has a fault instead of a result; none stops a job.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.batches import few_rows
from tessera.functions.text import named_entities, tidy

# Fixed by the page format: names of elements and macros, marks and bounds.
BLOCKS = {"article", "div", "section", "layout", "layout-section", "layout-cell"}
INLINE = {"span", "small", "sub", "sup"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NOTICES = {"info": "Info", "note": "Note", "tip": "Tip", "warning": "Warning", "panel": "Panel"}
DIAGRAMS = {"drawio", "drawio-sketch", "drawio-board"}
MACROS = {"structured-macro", "macro"}
SECTIONS = {"thead", "tbody", "tfoot"}
MAX_ROWS, MAX_COLUMNS, MAX_SLOTS = 256, 128, 32_768
MAX_CELL_BYTES, MAX_TABLE_BYTES, MAX_TABLE_DEPTH, MAX_REFERENCES, MAX_NAME_BYTES = 65_536, 1_048_576, 4, 256, 256

_NAME = re.compile(r"[a-z][a-z0-9_.+-]{0,63}")
_LANGUAGE = re.compile(r"[A-Za-z0-9_+.-]{1,32}")
_ISSUE = re.compile(r"[A-Z][A-Z0-9]+-[1-9][0-9]*")
_PAGE = re.compile(r"(?:[?&]pageId=|/pages/(?:viewpage\.action/?)?)([0-9]+)(?:[/?&#]|$)", re.I)
_DECLARATION = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|(?P<bad><!\s*(?:DOCTYPE|ENTITY)\b)", re.S | re.I)
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")


def safe_name(value: str | None) -> str:
    """A name of an element or macro that may be shown; ``unknown`` for all others."""
    value = (value or "unknown").strip().lower()
    return value if _NAME.fullmatch(value) else "unknown"


def identity(value: str | None) -> str:
    """What a reference names, in one line that Markdown leaves alone; ``unknown`` if nothing, or too long."""
    line = " ".join(_CONTROL.sub(" ", unicodedata.normalize("NFC", value or "")).split())
    line = re.sub(r"([\\\[\]])", r"\\\1", line)
    return line if line and len(line.encode("utf-8", "surrogatepass")) <= MAX_NAME_BYTES else "unknown"


def plain(text: str) -> str:
    """Text that Markdown is not to read as markup."""
    return re.sub(r"([\\*_])", r"\\\1", text)


def fence(code: str) -> str:
    return "`" * max([3, *(len(x) + 1 for x in re.findall("`+", code))])


def fenced(code: str, language: str = "") -> str:
    code = unicodedata.normalize("NFC", code.replace("\r\n", "\n").replace("\r", "\n"))
    return f"{fence(code)}{language}\n{code}\n{fence(code)}"


def quoted(text: str) -> str:
    text = tidy(text)
    return "\n\n" + re.sub(r"(?m)^(?=.)", " ", text).replace("\n", "\n>").join((">", "\n\n")) if text else ""


def apart(text: str) -> str:
    return f"\n\n{text}\n\n"


@dataclass
class Note:
    """Something told of a page: a kind, and what it is about."""

    kind: str
    name: str = ""
    more: str = ""


@dataclass
class Cell:
    text: str
    spans: tuple[str | None, str | None]
    hard: bool
    notes: list[Note]


@dataclass
class Frame:
    """An open element. ``mode``: its content is shown, taken as raw text, or left out."""

    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    mode: str = "show"
    macro: str = ""
    parts: list[str] = field(default_factory=list)
    notes: list[Note] = field(default_factory=list)
    lists: list[tuple[str, list[Note]]] = field(default_factory=list)
    cells: list[Cell] = field(default_factory=list)
    rows: list[list[Cell]] = field(default_factory=list)
    items: list[tuple[str, list[tuple[str, list[Note]]]]] = field(default_factory=list)
    parameters: dict[str, str] = field(default_factory=dict)
    bodies: set[str] = field(default_factory=set)
    attachment: dict[str, str] | None = None
    page: dict[str, str] | None = None
    holds_table: bool = False
    holds_code: bool = False
    placed: bool = False  # a part of a table, list or macro where it belongs
    tables: int = 0
    depth: int = 0

    @property
    def text(self) -> str:
        return "".join(self.parts)


class Page:
    """One page: feeds the parser, keeps the stack."""

    def __init__(self) -> None:
        self.stack: list[Frame] = []

    def read(self, body: str) -> Frame:
        parser = expat.ParserCreate(namespace_separator=" ")
        parser.buffer_text, parser.ordered_attributes = True, True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.data
        parser.Parse('<page xmlns:ac="urn:wiki:ac" xmlns:ri="urn:wiki:ri">', False)
        parser.Parse(body, False)
        parser.Parse("</page>", True)
        return self.stack[0]

    # ---- what comes in

    def start(self, tag: str, attributes: list[str]) -> None:
        if not self.stack:
            self.stack.append(Frame("root"))
            return
        up, attrs = self.stack[-1], {}
        for k, v in zip(attributes[::2], attributes[1::2], strict=True):
            attrs.setdefault(local(k), v)
        f = Frame(local(tag), attrs, mode_of(local(tag), up), placed=placed(local(tag), up), tables=up.tables + (up.name == "table" and up.mode == "show"))
        if f.name in MACROS:
            f.macro = safe_name(attrs.get("name"))
            if f.mode == "show" and not known(f.macro):
                f.notes += [Note("unhandled", f.macro), Note("warning", "unhandled_macro", f.macro)]
        if f.name in ("ul", "ol") and up.name == "li" and up.placed:
            f.depth = up.depth + 1
        elif f.name == "li":
            f.depth = up.depth
        if f.mode == "show" and not f.placed and f.name not in SHOWN:
            f.notes += unsupported(f.name)
        if up.name in MACROS and f.name.endswith("-text-body"):
            up.bodies.add(f.name)
        self.stack.append(f)

    def data(self, text: str) -> None:
        f = self.stack[-1]
        if f.mode == "raw":
            f.parts.append(text)
        elif f.mode == "show" and not (f.name in ("table", "ul", "ol", *MACROS) or f.placed and f.name in ("tr", *SECTIONS)):
            f.parts.append(plain(text))

    def end(self, tag: str) -> None:
        if len(self.stack) == 1:
            return
        f, up = self.stack.pop(), self.stack[-1]
        # what lies anywhere inside, shown or not: the first of its kind in the page's order
        up.attachment = up.attachment if up.attachment is not None else f.attrs if f.name == "attachment" else f.attachment
        up.page = up.page if up.page is not None else f.attrs if f.name == "page" else f.page
        up.holds_table |= f.holds_table or f.name == "table"
        up.holds_code |= f.holds_code or f.name == "pre" or f.macro == "code"
        if f.mode == "hide":
            return
        if f.mode == "raw" and f.name not in ("code", "pre"):
            if up.mode == "raw":
                up.parts += f.parts
            elif f.name == "parameter":
                up.parameters[safe_name(f.attrs.get("name"))] = f.text
            elif known(up.macro):
                up.parts.append(f.text)
            else:
                up.parts += ["\n\n"] * bool(up.parts) + [plain(f.text)]
            return
        if up.mode == "raw":
            up.parts += f.parts
        elif f.placed and f.name in ("td", "th"):
            up.cells.append(Cell(f.text, (f.attrs.get("rowspan"), f.attrs.get("colspan")), f.holds_table or f.holds_code, f.notes))
        elif f.placed and f.name == "tr":
            up.rows.append(f.cells)
        elif f.placed and f.name in SECTIONS:
            up.rows += f.rows
        elif f.name in ("ul", "ol") and up.name == "li" and up.placed:
            up.lists.append(_list(f))
        elif f.placed and f.name == "li":
            up.items.append((tidy(f.text), [("", f.notes), *f.lists]))
        elif f.placed and f.name == "rich-text-body":
            up.parts += ["\n\n"] * (bool(up.parts) and not known(up.macro)) + [f.text]
            fold_notes(up, f.notes)
        else:
            text, notes = RENDER.get(f.name, _other)(f)
            up.parts.append(text)
            fold_notes(up, notes)


def fold_notes(up: Frame, notes: list[Note]) -> None:
    if up.notes:
        up.notes += notes
    else:
        up.notes = notes


def local(tag: str) -> str:
    return tag.rpartition(" ")[2].lower()


def known(macro: str) -> bool:
    return macro in HANDLED


def unsupported(name: str) -> list[Note]:
    return [Note("unsupported"), Note("warning", "unsupported_element", safe_name(name))]


def placed(name: str, up: Frame) -> bool:
    if name in ("td", "th"):
        return up.name == "tr" and up.placed
    if name == "tr":
        return up.name == "table" or up.name in SECTIONS and up.placed
    if name == "li":
        return up.name in ("ul", "ol")
    return name in SECTIONS and up.name == "table" or name.endswith("-text-body") and up.name in MACROS


def mode_of(name: str, up: Frame) -> str:
    """What becomes of an element's content, by the element it lies in."""
    if up.mode != "show":
        return up.mode
    if up.name in MACROS:
        if name == "parameter":
            return "raw"
        again = name in up.bodies
        if known(up.macro):  # only the first body counts, and only of the kind that the macro has
            return {"rich-text-body": "show", "plain-text-body": "raw"}[name] if name == HANDLED[up.macro] and not again else "hide"
        return {"rich-text-body": "show", "plain-text-body": "raw"}.get(name, "hide")
    if up.name in ("image", "img", "br", "hr"):
        return "hide"
    if up.name in ("code", "pre"):
        return "raw"
    if up.name in ("ul", "ol"):
        return "show" if name == "li" else "hide"
    if up.name == "table":
        return "show" if name == "tr" or name in SECTIONS else "hide"
    if up.name in SECTIONS and up.placed:
        return "show" if name == "tr" else "hide"
    if up.name == "tr" and up.placed:
        return "show" if name in ("td", "th") else "hide"
    return "raw" if name in ("code", "pre") else "show"


# ---- what an element becomes: its text, and what is told of it


def _other(f: Frame) -> tuple[str, list[Note]]:
    if f.name in ("script", "style"):
        return f"[unsupported:{safe_name(f.name)} omitted]", f.notes
    return f.text.strip() or f"[unsupported:{safe_name(f.name)}]", f.notes


def _media(name: str | None) -> tuple[str, list[Note]]:
    name = identity(name)
    return f"[media: {name}]", [Note("media"), Note("reference", "image_attachment", name)]


def _image(f: Frame) -> tuple[str, list[Note]]:
    return _media((f.attachment or {}).get("filename") or f.attrs.get("alt"))


def _attached(f: Frame) -> tuple[str, list[Note]]:
    if f.attachment is not None:
        return _image(f)
    text, notes = _other(f)
    return text, unsupported(f.name) + notes


def _anchor(f: Frame) -> tuple[str, list[Note]]:
    label, href = f.text.strip() or "link", f.attrs.get("href")
    if not href:
        return label, [*f.notes, Note("warning", "link_target_missing", "a")]
    try:
        parts = None if re.search(r"[\r\n\x00]", href) else urlsplit(href)
    except ValueError:
        parts = None
    if parts is None or parts.scheme.lower() not in ("", "http", "https", "mailto"):
        return label, [*f.notes, Note("warning", "link_target_omitted", "a")]
    page = None if parts.netloc else _PAGE.search(parts.path + ("?" + parts.query if parts.query else ""))
    told = [Note("reference", "page_link", f"confluence:page:{page[1]}")] if page else []
    return f"[{label}]({href.replace(' ', '%20').replace(')', chr(92) + ')')})", f.notes + told


def _list(f: Frame) -> tuple[str, list[Note]]:
    """Items with their own lines under their first one; the lists of an item follow it, and what they tell too."""
    lines, notes = [], []
    for n, (body, parts) in enumerate(f.items, 1):
        mark = f"{n}. " if f.name == "ol" else "- "
        head, *rest = body.split("\n")
        lines.append(f"{'  ' * f.depth}{mark}{head}".rstrip())
        lines += [x and ("  " * f.depth + " " * len(mark) + x).rstrip() for x in rest]
        for text, told in parts:
            lines += [text.strip("\n")] * bool(text.strip("\n"))
            notes += told
    return apart("\n".join(lines)), notes


def _span(value: str | None, limit: int) -> int | None:
    """A number of rows or columns; None for what is no canonical number up to the limit."""
    if value is None:
        return 1
    return int(value) if re.fullmatch(r"[1-9][0-9]{0,2}", value) and int(value) <= limit else None


def grid(rows: list[list[Cell]]) -> list[list[Cell | None]] | None:
    """Cells at the first free places of their rows, a place for each that they cover; None if they cannot be laid out.

    The taken columns of a row are the bits of one number, so that a cell of any height looks at one number too.
    """
    taken, at, width, slots = [0] * len(rows), {}, 0, 0
    for y, row in enumerate(rows):
        for cell in row:
            high, wide = _span(cell.spans[0], MAX_ROWS), _span(cell.spans[1], MAX_COLUMNS)
            if high is None or wide is None or y + high > len(rows) or (slots := slots + high * wide) > MAX_SLOTS:
                return None
            over = 0
            for mask in taken[y : y + high]:
                over |= mask
            block = (1 << wide) - 1
            x = next((x for x in range(MAX_COLUMNS - wide + 1) if not over >> x & block), None)
            if x is None:
                return None
            for i in range(y, y + high):
                taken[i] |= block << x
            at[y, x], width = cell, max(width, x + wide)
        if not row:
            return None
    return [[at.get((y, x)) for x in range(width)] for y in range(len(rows))] if width else None


def encoded(text: str) -> str:
    """A cell in one line; bars and backslashes are escaped, but for those that are."""
    one = lambda m: "<br>" if m[0] == "\n" else m[0] if len(m[0]) > 1 else "\\" + m[0]
    return re.sub(r"\n|\\[|\\]|[|\\]", one, text)


def _markdown_table(rows: list[list[str]]) -> str:
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return apart("\n".join([lines[0], "| " + " | ".join(["---"] * len(rows[0])) + " |", *lines[1:]]))


def _table(f: Frame) -> tuple[str, list[Note]]:
    """A plain table, or a grid of joined cells, or, if that fails, a line for each row."""
    rows = f.rows
    if len(rows) > MAX_ROWS:
        return "", [Note("fault", "table exceeds safety limit")]
    shape = {len(r) for r in rows}
    odd = lambda c: c.hard or any(s is not None and _span(s, limit) != 1 for s, limit in zip(c.spans, (MAX_ROWS, MAX_COLUMNS), strict=True))
    cells = [c for r in rows for c in r]
    if len(shape) == 1 and 0 not in shape and f.tables <= MAX_TABLE_DEPTH and not any(map(odd, cells)):
        plain_rows = [[" ".join(tidy(c.text).split()).replace("|", "\\|") for c in r] for r in rows]
        return _markdown_table(plain_rows), [n for c in cells for n in c.notes]
    laid = grid(rows) if rows and f.tables <= MAX_TABLE_DEPTH else None
    notes: list[Note] = []
    texts: dict[int, str] = {}
    for c in cells:
        notes += c.notes
        value = tidy(c.text)
        if len(value.encode("utf-8", "surrogatepass")) > MAX_CELL_BYTES:
            notes.append(Note("fault", "table cell exceeds safety limit"))
        marks = "".join(f" [{k}:{n}]" for k, n in zip(("rowspan", "colspan"), map(_span, c.spans, (MAX_ROWS, MAX_COLUMNS)), strict=True) if n and n > 1) if laid else ""
        texts[id(c)] = encoded(value + marks)
    if laid:
        text = _markdown_table([[texts[id(c)] if c else "" for c in r] for r in laid])
    else:
        lines = [f"row[{i}]: " + " || ".join(texts[id(c)] for c in r) for i, r in enumerate(rows)] or ["row[0]: "]
        text = apart("\n".join(["[table]", *lines]))
    if len(text.encode("utf-8", "surrogatepass")) > MAX_TABLE_BYTES:
        notes.append(Note("fault", "table output exceeds safety limit"))
    return text, [*notes, Note("complex"), Note("warning", "complex_table_grid" if laid else "complex_table_fallback", "table")]


def _titled(f: Frame) -> str:
    title = f.parameters.get("title", "").strip()
    return f"**{plain(title)}**\n\n" if title else ""


def _code_macro(f: Frame) -> tuple[str, list[Note]]:
    language, told = f.parameters.get("language", ""), []
    if language and not _LANGUAGE.fullmatch(language):
        language, told = "", [Note("warning", "macro_parameter_omitted", f.macro)]
    return apart(_titled(f) + fenced(f.text, language)), told


def _include(f: Frame) -> tuple[str, list[Note]]:
    page = f.page or {}
    name = identity(page.get("content-title") or page.get("content-id") or f.parameters.get("page") or f.parameters.get("title"))
    return f"[included from page: {name}]", [Note("reference", "include_page", name)]


def _diagram(f: Frame) -> tuple[str, list[Note]]:
    p = f.parameters
    name = identity(p.get("diagramname") or p.get("name") or p.get("diagram") or (f.attachment or {}).get("filename"))
    return f"[diagram: {name}]", [Note("media"), Note("reference", "drawio", name)]


def _issue(f: Frame) -> tuple[str, list[Note]]:
    key = f.parameters.get("key", "").strip()
    return (key, []) if _ISSUE.fullmatch(key) else ("[jira-issue]", [Note("warning", "macro_value_omitted", f.macro)])


def _notice(f: Frame) -> tuple[str, list[Note]]:
    body = tidy(f.text)
    return quoted(f"**{NOTICES[f.macro]}:**" + (f"\n{body}" if body else "")), f.notes


#: Macros that are understood, by the kind of body that they have.
HANDLED = {"code": "plain-text-body", "expand": "rich-text-body", "excerpt": "rich-text-body", "include": "", "excerpt-include": "", "jira": "", "toc": "", **dict.fromkeys(DIAGRAMS, ""), **dict.fromkeys(NOTICES, "rich-text-body")}
MACRO: dict[str, Callable[[Frame], tuple[str, list[Note]]]] = {
    "code": _code_macro, "include": _include, "excerpt-include": _include, "jira": _issue, "toc": lambda f: ("", [Note("toc")]),
    "expand": lambda f: (apart(_titled(f) + f.text), f.notes), "excerpt": lambda f: (f.text, f.notes),
    **dict.fromkeys(DIAGRAMS, _diagram), **dict.fromkeys(NOTICES, _notice),
}


def _macro(f: Frame) -> tuple[str, list[Note]]:
    if known(f.macro):
        text, notes = MACRO[f.macro](f)
        return text, [Note("handled", f.macro), *notes]
    body = tidy(f.text)
    return (apart(f"[macro:{f.macro}]\n\n{body}") if body else f"[macro:{f.macro} omitted]"), f.notes


def _inline_code(f: Frame) -> tuple[str, list[Note]]:
    code = re.sub(r"\r\n|\r|\n", " ", f.text)
    pad = " " if "`" in code[:1] + code[-1:] else ""
    return f"{fence(code)}{pad}{code}{pad}{fence(code)}", []


def _around(mark: str) -> Callable[[Frame], tuple[str, list[Note]]]:
    return lambda f: (f"{mark}{f.text.strip()}{mark}", f.notes)


RENDER: dict[str, Callable[[Frame], tuple[str, list[Note]]]] = {
    "p": lambda f: (apart(f.text.strip()), f.notes), "br": lambda f: ("\n", []), "hr": lambda f: (apart("---"), []), "li": lambda f: (f.text, f.notes),
    "strong": _around("**"), "b": _around("**"), "em": _around("*"), "i": _around("*"), "code": _inline_code, "pre": lambda f: (apart(fenced(f.text)), []),
    "blockquote": lambda f: (quoted(f.text), f.notes), "ul": _list, "ol": _list, "table": _table, "a": _anchor, "image": _image, "img": _image, "link": _attached,
    **dict.fromkeys(HEADINGS, lambda f: (apart(f"{'#' * int(f.name[1])} {f.text.strip()}"), f.notes)),
    **dict.fromkeys(BLOCKS, lambda f: (apart(f.text), f.notes)), **dict.fromkeys(INLINE, lambda f: (f.text, f.notes)), **dict.fromkeys(MACROS, _macro),
}
SHOWN = set(RENDER)


def convert(body: str) -> dict:
    """A page's Markdown, references, warnings and counters; or its fault alone."""
    if any(m["bad"] for m in _DECLARATION.finditer(body)):
        return {"fault": "storage XHTML contains a forbidden declaration"}
    try:
        safe = named_entities(body)
    except ValueError:
        return {"fault": "storage XHTML contains an unknown entity"}
    try:
        root = Page().read(safe)
    except (expat.ExpatError, UnicodeEncodeError, IndexError):
        return {"fault": "storage XHTML is malformed"}
    references = 0
    for n in root.notes:
        references += n.kind == "reference"
        if n.kind == "fault" or references > MAX_REFERENCES:
            return {"fault": n.name if n.kind == "fault" else "reference intent limit exceeded"}
    told = Counter((n.kind, n.name) for n in root.notes if n.kind in ("handled", "unhandled"))
    counts = Counter(n.kind for n in root.notes)
    return {
        "text": tidy(root.text),
        "references": [{"ordinal": i, "kind": n.name, "status": "unresolved_target" if n.name == "include_page" or n.more == "unknown" else "deferred_mvp", "identity": n.more} for i, n in enumerate((n for n in root.notes if n.kind == "reference"), 1)],
        "warnings": [{"ordinal": i, "code": n.name, "name": n.more} for i, n in enumerate((n for n in root.notes if n.kind == "warning"), 1)],
        "counters": {**{f"{k}:{name}": v for (k, name), v in sorted(told.items())}, "toc_dropped": counts["toc"], "media_placeholders": counts["media"], "unsupported_elements": counts["unsupported"], "complex_tables": counts["complex"]},
    }


_REFERENCES = "array<struct<ordinal:int,kind:string,status:string,identity:string>>"
_WARNINGS = "array<struct<ordinal:int,code:string,name:string>>"
_ARROW = pa.struct([
    ("text", pa.string()), ("references", pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("status", pa.string()), ("identity", pa.string())]))),
    ("warnings", pa.list_(pa.struct([("ordinal", pa.int32()), ("code", pa.string()), ("name", pa.string())]))), ("counters", pa.map_(pa.string(), pa.int64())), ("fault", pa.string()),
])


def storage_pages(pages: DataFrame, body: str = "storage") -> DataFrame:
    """``pages`` with text, references, warnings, counters and fault in place of the storage text in column ``body``.

    Of a page with a fault all others are null. A null body is no page: all five are null. Columns of those names go.
    """
    made = ("text", "references", "warnings", "counters", "fault")
    kept = [c for c in pages.columns if c != body and c.lower() not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows = [{} if x.as_py() is None else convert(x.as_py()) for x in b.column(len(kept))]
            rows = [{"counters": list(r["counters"].items()), **{k: v for k, v in r.items() if k != "counters"}} if "counters" in r else r for r in rows]
            found = pa.array(rows, _ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *found.flatten()], [*kept, *made])

    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema)
    schema = f"{kept_schema}, text string, references {_REFERENCES}, warnings {_WARNINGS}, counters map<string,bigint>, fault string"
    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(body)).mapInArrow(run, schema)
