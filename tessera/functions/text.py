"""Text functions: canonical form, fixed-size windows, words, and the language of a source file."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space that a line loses at its end, the line feed aside: what Unicode counts as space or separator.
LINE_SPACE = r"[\t\x0B\x0C\x0D\x1C-\x1F\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[A-Za-z0-9]+"


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def compose(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` in Unicode's composed form (NFC). Null stays null. Other columns are kept.

    ASCII texts are composed as they are, so only the others leave the JVM.
    """
    other = F.when(F.octet_length(column) > F.char_length(column), F.col(column))
    return docs.withColumn(column, F.coalesce(_nfc(other), F.col(column)))


def canonical_layout(text: Column) -> Column:
    """Line feeds only, no white space at line ends, at most one empty line together, none at either end."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), LINE_SPACE + r"+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def tidy(text: str) -> str:
    """Composed, line feeds only, no space at line ends, one empty line at most, none at either end."""
    lines = unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in lines)).strip("\n")


def normalize(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` composed and laid out; both null and empty texts stay as they are."""
    return compose(docs, column).withColumn(column, canonical_layout(F.col(column)))


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case, in order; an empty array for null."""
    return F.transform(F.coalesce(F.regexp_extract_all(text, F.lit(WORD), 0), F.array().cast("array<string>")), F.lower)


def window_places(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each window of a text, by bisection among its line feeds.

    A window that does not reach the end of the text ends behind its last line feed, if that is past its middle, else after
    ``size`` characters.
    """
    behind = [m.end() for m in re.finditer("\n", text)]
    start = 0
    while start < len(text):
        last = bisect_right(behind, start + size) - 1
        whole = start + size >= len(text)
        end = len(text) if whole else behind[last] if last >= 0 and behind[last] - 1 > start + size // 2 else start + size
        yield start, end
        start = len(text) if whole else max(end - overlap, start + 1)


def cut_windows(text: str, size: int = 1500, overlap: int = 150) -> list[str]:
    """The text's windows without white space around them; each but the first starts ``overlap`` characters before the end of
    the one before. Windows of white space only are left out."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    return [part for a, z in window_places(text, size, overlap) if (part := text[a:z].strip())]


def char_chunks(docs: DataFrame, size: int = 1500, overlap: int = 150) -> DataFrame:
    """(doc_id, text) -> (doc_id, chunk_index, text), one row per window. Null and blank texts have no row."""

    @F.pandas_udf("array<string>")
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: cut_windows(x or "", size, overlap))

    return docs.select("doc_id", F.posexplode(windows(F.coalesce("text", F.lit("")))).alias("chunk_index", "text"))


def named_entities(text: str) -> str:
    """Named character references as numbers, but for the five that XML has; CDATA sections and comments stay as they are.

    An unknown name is an error, as it would be to a reader of the page.
    """

    def one(m: re.Match[str]) -> str:
        if m["literal"] or m["name"] in ("amp", "lt", "gt", "apos", "quot"):
            return m[0]
        found = html5.get(m["name"] + ";")
        if found is None:
            raise ValueError(f"unknown entity {m['name']}")
        return "".join(f"&#x{ord(c):X};" for c in found)

    return re.sub(r"(?P<literal><!\[CDATA\[.*?\]\]>|<!--.*?-->)|&(?P<name>[A-Za-z][A-Za-z0-9]+);", one, text, flags=re.S)


def row_cells(line: str) -> list[str]:
    """The cells of a Markdown table's row; an escaped bar does not part them."""
    body = line.strip().removeprefix("|")
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    out = [""]
    for m in re.finditer(r"\\.|\||[^\\|]+|\\", body, flags=re.S):
        if m[0] == "|":
            out.append("")
        else:
            out[-1] += m[0]
    return out


def instant(value: Column) -> Column:
    """An RFC 3339 time as text in UTC with six digits of a second; null for what is none: no offset, or no such day."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,6})?([Zz]|[+-]\d{2}:\d{2})$"
    at = F.try_to_timestamp(F.when(value.rlike(shape), F.upper(value)))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


#: File extensions and the names of their languages.
LANGUAGES = {
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "inl": "cpp", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go",
    "rs": "rust", "cs": "csharp", "php": "php", "py": "python", "pyw": "python", "sh": "shell", "bash": "shell", "zsh": "shell",
    "fish": "shell", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini", "conf": "ini", "mk": "make",
    "make": "make", "gradle": "gradle", "sql": "sql", "xml": "xml", "xsd": "xml", "xsl": "xml", "xslt": "xml", "svg": "xml",
}


def language_of(path: Column) -> Column:
    """The language of a file by its extension; ``unknown`` for the others."""
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.lit("unknown"))
