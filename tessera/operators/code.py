"""Source files as documents and chunks, and symbols tied to the chunks that hold them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import symbols as declared
from tessera.functions.checkpoints import spread
from tessera.functions.ids import chunk_id, content_hash, file_document_id, symbol_id
from tessera.functions.text import language_of, normalize, tidy
from tessera.operators.chunking import Budget, Counted, Spans, code_windows, word_spans


def git_documents(files: DataFrame, branch: str, commit: str) -> DataFrame:
    """(repo, path, text) -> a document per file, its text in canonical form; files without a text are left out.

    Everybody who sees the repository sees its files. Files are dealt out first, as all that is made of them is slow.
    """
    rows = normalize(spread(files.where("text IS NOT NULL").select("repo", "path", "text"), "repo", "path"))
    return rows.select(
        file_document_id(F.col("repo"), F.col("path")).alias("document_id"), F.lit("git").alias("source_system"), "repo", F.lit(branch).alias("branch"), F.col("path").alias("file_path"),
        F.lit(commit).alias("source_version"), "text", content_hash(F.col("text")).alias("content_hash"), language_of(F.col("path")).alias("language"), F.array(F.concat(F.lit("repo:"), "repo")).alias("acl_tags"),
    )


def git_chunks(documents: DataFrame, budget: Budget = Budget(), spans: Spans = word_spans) -> DataFrame:
    """Documents of ``git_documents`` -> their windows of lines, with ids over path and number; equal ones get -1, -2 ..."""
    kept = ("repo", "branch", "file_path", "source_version", "language", "acl_tags")
    rows = code_windows(documents.select("document_id", *kept, F.col("file_path").alias("path"), "text"), budget, spans, kept)
    key = F.concat_ws(":", F.lit("git"), "repo", "file_path")
    plain = chunk_id(F.lit("git"), key, F.concat(F.col("file_path"), F.lit("#w"), F.col("part_index").cast("string")), F.col("text"))
    again = F.row_number().over(Window.partitionBy("document_id", "__id").orderBy("part_index")) - 1
    ids = rows.withColumn("__id", plain).withColumn("__again", again)
    named = F.when(F.col("__again") > 0, F.concat_ws("-", "__id", "__again")).otherwise(F.col("__id"))
    return ids.withColumn("chunk_id", named).withColumn("content_hash", content_hash(F.col("text"))).drop("__id", "__again")


def tie_symbols(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo, file_path, symbol_id, line_start, ...) -> with chunk_id: the first chunk that holds the symbol's first line.

    Files are short lists of chunks, so the two sides meet by file, and only the first fitting chunk is kept.
    """
    held = chunks.select("repo", "file_path", F.col("line_start").alias("__from"), F.col("line_end").alias("__to"), F.col("chunk_id").alias("__chunk"), F.col("part_index").alias("__part"))
    fits = F.when(F.col("line_start").between(F.col("__from"), F.col("__to")), F.struct("__part", "__chunk"))
    keys = symbols.columns
    found = symbols.join(held, ["repo", "file_path"], "left").groupBy(*keys).agg(F.min(fits)["__chunk"].alias("chunk_id"))
    return found


def runs_of_lines(header: str, lines: list[str], budget: Budget, spans: Spans) -> list[tuple[int, int]]:
    """Runs of whole lines (first, end), each as long as the hard limit and the number of lines allow under a header; each
    repeats the last lines of the one before. A line that fits nowhere stands alone, over the limit."""
    counted = Counted("\n".join(lines), spans)
    starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
    sums = [0, *accumulate(counted.tokens(a, b) for a, b in pairwise(starts))]
    room = budget.hard - len(spans(header))
    out, at = [], 0
    while True:
        end = at + 1
        while end < len(lines) and end - at < budget.lines and sums[end + 1] - sums[at] <= room:
            end += 1
        out.append((at, end))
        if end >= len(lines):
            return out
        at = max(at + 1, end - budget.repeat)


def units(repo: str, path: str, language: str, text: str, budget: Budget, spans: Spans) -> tuple[list[dict], list[dict], bool]:
    """The symbols of a file, its chunks, and whether it could be read only in part.

    A class, namespace or package is chunked as its own signature and those of its members, a function as its lines; over
    the hard limit they are cut into runs of lines. Each chunk opens with repository, path and name, and the comment
    above the symbol. A file without symbols is chunked as runs of lines.
    """
    found, partial = declared.scan(language, text)
    lines = text.split("\n")
    members: dict[str | None, list[str]] = {}
    for x in found:
        members.setdefault(x.parent, []).append(x.signature)
    symbols, chunks = [], []
    for x in found:
        header = f"// {repo} · {path} · {x.qualified_name}" + (f"\n\n{x.comment}" if x.comment else "")
        first = x.line_start if x.aggregate else x.line_start + (x.comment.count("\n") + 1 if x.comment else 0)
        body = "\n".join([x.signature, *members.get(x.qualified_name, [])]).split("\n") if x.aggregate else lines[first - 1 : x.line_end]
        whole = tidy(header + "\n\n" + "\n".join(body))
        if len(spans(whole)) <= budget.hard:
            parts = [(whole, x.line_start, x.line_end, x.qualified_name)]
        else:
            parts = []
            for i, (a, b) in enumerate(runs_of_lines(header, body, budget, spans)):
                part = tidy(header + "\n\n" + "\n".join(body[a:b]))
                parts.append((part, min(first + a, x.line_end), min(first + b - 1, x.line_end), f"{x.qualified_name}#p{i}"))
        own = len(chunks)
        for i, (part, a, b, unit) in enumerate(parts):
            n = (i, len(parts)) if len(parts) > 1 else (None, None)
            chunks.append({"content_kind": "code_symbol", "symbol": x.qualified_name, "text": part, "token_count": len(spans(part)), "unit_key": unit, "line_start": a, "line_end": b, "part_index": n[0], "part_total": n[1]})
        symbols.append({
            "symbol_type": x.symbol_type, "name": x.name, "qualified_name": x.qualified_name, "parent_symbol": x.parent, "signature": x.signature, "overloaded": x.overloaded,
            "line_start": x.line_start, "line_end": x.line_end, "unit_key": chunks[own]["unit_key"], "first_text": chunks[own]["text"],
        })
    if not found:
        header = f"// {repo} · {path}"
        runs = runs_of_lines(header, lines, budget, spans)
        for i, (a, b) in enumerate(runs):
            part = tidy(header + "\n\n" + "\n".join(lines[a:b]))
            chunks.append({"content_kind": "code_window", "symbol": None, "text": part, "token_count": len(spans(part)), "unit_key": f"{path}#w{i}", "line_start": a + 1, "line_end": b, "part_index": i, "part_total": len(runs)})
    return symbols, chunks, partial


_SYMBOL = {"symbol_type": "string", "name": "string", "qualified_name": "string", "parent_symbol": "string", "signature": "string", "overloaded": "boolean", "line_start": "int", "line_end": "int", "unit_key": "string", "first_text": "string"}
_CHUNK = {"content_kind": "string", "symbol": "string", "text": "string", "token_count": "int", "unit_key": "string", "line_start": "int", "line_end": "int", "part_index": "int", "part_total": "int"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_STATUS = {False: "ok", True: "partial"}


def read_symbols(documents: DataFrame, budget: Budget = Budget(), spans: Spans = word_spans) -> DataFrame:
    """Documents of ``git_documents`` in C++ and Java -> (document_id, repo, branch, file_path, source_version, language,
    acl_tags, symbols, chunks, parse_status), a row per file. Files in other languages are left out."""
    kept = ("document_id", "repo", "branch", "file_path", "source_version", "language", "acl_tags")
    lists = [pa.list_(pa.struct([(k, _ARROW[v]) for k, v in fields.items()])) for fields in (_SYMBOL, _CHUNK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = {n: b.column(i).to_pylist() for i, n in enumerate((*kept, "text"))}
            made = [units(*row, budget, spans) for row in zip(of["repo"], of["file_path"], of["language"], of["text"], strict=True)]
            cols = [pa.array([m[0] for m in made], lists[0]), pa.array([m[1] for m in made], lists[1]), pa.array([_STATUS[m[2]] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *cols], [*kept, "symbols", "chunks", "parse_status"])

    struct = lambda fields: "array<struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">>"
    schema = f"document_id string, repo string, branch string, file_path string, source_version string, language string, acl_tags array<string>, symbols {struct(_SYMBOL)}, chunks {struct(_CHUNK)}, parse_status string"
    return documents.where(F.col("language").isin("cpp", "java") & F.col("text").isNotNull()).select(*kept, "text").mapInArrow(run, schema)


def _unit_id(unit: Column, body: Column) -> Column:
    return chunk_id(F.lit("git"), F.concat_ws(":", F.lit("git"), "repo", "file_path"), unit, body)


def git_symbols(read: DataFrame, scanned_at: str) -> DataFrame:
    """Files of ``read_symbols`` -> a record per symbol, each with the id of the first chunk that holds it."""
    s = F.col("s")
    rows = read.select("*", F.explode("symbols").alias("s"))
    return rows.select(
        symbol_id(F.col("repo"), F.col("branch"), F.col("file_path"), s["qualified_name"], s["signature"], s["overloaded"]).alias("symbol_id"), "repo", "branch", F.col("source_version").alias("commit_hash"),
        "file_path", "language", s["symbol_type"].alias("symbol_type"), s["name"].alias("name"), s["qualified_name"].alias("qualified_name"), s["signature"].alias("signature"), s["line_start"].alias("line_start"),
        s["line_end"].alias("line_end"), s["parent_symbol"].alias("parent_symbol"), _unit_id(s["unit_key"], s["first_text"]).alias("chunk_id"), "parse_status", F.lit(scanned_at).alias("scanned_at"),
    )


def symbol_chunks(read: DataFrame) -> DataFrame:
    """Files of ``read_symbols`` -> their chunks: of symbols, or, where a file has none, of runs of lines."""
    c = F.col("c")
    rows = read.select("document_id", "repo", "branch", "file_path", "source_version", "language", "acl_tags", F.explode("chunks").alias("c"))
    return rows.select("document_id", "repo", "branch", "file_path", "source_version", "language", "acl_tags", "c.*", _unit_id(c["unit_key"], c["text"]).alias("chunk_id"), content_hash(c["text"]).alias("content_hash")).drop("unit_key")


def opening_chunks(read: DataFrame, kinds: Sequence[str] = tuple(sorted(declared.AGGREGATES))) -> DataFrame:
    """``symbol_chunks`` that open the symbols of these kinds. The first chunks of a file's symbols stand in the order of its
    symbols, so that no row needs another file's."""
    first = F.filter("chunks", lambda c: (c.content_kind == "code_symbol") & (F.coalesce(c.part_index, F.lit(0)) == 0))
    return symbol_chunks(read.withColumn("chunks", F.array_compact(F.zip_with("symbols", first, lambda s, c: F.when(s.symbol_type.isin(*kinds), c)))))


def symbol_metrics(read: DataFrame) -> DataFrame:
    """One row: files, symbols and chunks, files read in part, files without symbols, parts of symbols that were cut."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    cut = F.size(F.filter("chunks", lambda c: (c.content_kind == "code_symbol") & c.part_total.isNotNull()))
    return read.agg(
        F.count("*").alias("files"), count(F.size("symbols")).alias("symbols"), count(F.size("chunks")).alias("chunks"), count((F.col("parse_status") == "partial").cast("int")).alias("partial"),
        count((F.size("symbols") == 0).cast("int")).alias("fallback"), count(cut).alias("cut_parts"),
    )


def diagram_chunks(diagrams: DataFrame, system: str = "confluence") -> DataFrame:
    """(document_id, media_id, title, mermaid) -> a chunk per drawn diagram: its title, then the picture as text."""
    fence = F.concat_ws("\n\n", F.nullif(F.coalesce("title", F.lit("")), F.lit("")), F.concat(F.lit("```mermaid\n"), F.regexp_replace("mermaid", r"\n+\z", ""), F.lit("\n```")))
    rows = diagrams.where("mermaid IS NOT NULL").select("document_id", "media_id", fence.alias("text"))
    key = chunk_id(F.lit(system), F.col("document_id").cast("string"), F.concat(F.lit("drawio:"), "media_id"), F.col("text"))
    return rows.select(key.alias("chunk_id"), "document_id", "media_id", F.lit("diagram").alias("content_kind"), "text", content_hash(F.col("text")).alias("content_hash"))
