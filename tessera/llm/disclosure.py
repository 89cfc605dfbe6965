"""Personal data by fixed patterns, and words that give it away, judged by how often they stand near it in the corpus.

A protected entity is one value of one kind (an address, a number). Its information is -log2 of the share of documents that
hold it. A word tells of an entity as much as their pointwise mutual information, where they meet if the word stands within
a few words of the entity. A word that tells over a set part of what there is to know discloses the entity: it is replaced by
its first letters, if these do not disclose one, else removed. Words of few contexts, or of little evidence, are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity that count as near it, and letters of the two generalisations of a word.
NEAR, STEMS = 8, (4, 2)
#: Part of an entity's information from which a word discloses it, different contexts it takes, and bits of evidence in all.
PART, LEAST_CONTEXTS, LEAST_BITS = 0.9, 3, 20.0
#: Letters of a word beyond which it is known by its hash.
LONG = 40
#: Disclosing words up to which they go to every task.
FEW_WORDS = 200_000
#: Words counted in a task before they are handed on, and characters of results.
HELD_WORDS, BATCH_CHARS = 200_000, 4_000_000

WORD = re.compile(r"[^\W_]+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9.-]+")
#: A whole run of digits in any case, so that no run is begun twice.
DOTTED = re.compile(r"[0-9]++(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?+")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMERALS = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign is looked at once: what stands before it up to the last match or sign, and the labels behind it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        done = at + 1
        host = HOST.match(text, at + 1)
        if start < at and host and host[0][0] != ".":
            labels = host[0].partition("..")[0].rstrip(".")
            if "." in labels:
                done = at + 1 + len(labels)
                yield start, done
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        if m[1] is not None and all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    """The last digit makes the sum a multiple of ten, every second digit from the right counting as the digits of its double."""
    own = [int(d) for d in digits[::-1]]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits with 18 signs between them
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(NUMERALS.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as a place in KINDS, end) of all personal data in a text, in order; each kind by itself."""
    found = [(a, k, z) for k, f in enumerate((emails, addresses, cards, phones)) for a, z in f(text)]
    return sorted(found)


def entity(text: str, kind: int) -> str:
    """What an entity is known by, however it is written: letters in lower case, numbers without signs; its hash."""
    plain = text.lower() if kind == 0 else ".".join(p.lstrip("0") or "0" for p in text.split(".")) if kind == 1 else NUMERALS.sub("", text)
    return hashlib.md5(f"{KINDS[kind]}:{plain}".encode("utf-8", "surrogatepass")).hexdigest()


def key(word: str) -> str:
    """A word as it is counted; a very long one by its hash."""
    return word if len(word) <= LONG else "#" + hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()


def forms(word: str) -> list[str]:
    """A word and its generalisations, longest first."""
    return [key(word), *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _words(text: str) -> set[str]:
    return set(map(str.lower, WORD.findall(text)))


def _all_forms(text: str) -> set[str]:
    return {f for w in _words(text) for f in forms(w)}


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of the words of a text that lie in no span."""
    out, i, reach = [], 0, 0
    for m in WORD.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach = max(reach, spans[i][2])
            i += 1
        # spans that begin before the word's end cover it if they reach into it
        if reach <= m.start():
            out.append(m.span())
    return out


def contexts(text: str) -> list[tuple[str, str, list[str]]]:
    """(entity, context, forms of the near words) of each entity of a text; a context is known by a hash of these words."""
    spans = base_spans(text)
    if not spans:
        return []
    places = words_outside(text, spans)
    out, i = [], 0
    for a, kind, z in spans:
        while i < len(places) and places[i][0] < a:
            i += 1
        j = i
        while j < len(places) and places[j][0] < z:
            j += 1
        near = [text[x:y].lower() for x, y in (*places[max(i - NEAR, 0) : i], *places[j : j + NEAR])]
        known = hashlib.md5(" ".join(near).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((entity(text[a:z], kind), known, sorted({f for w in near for f in forms(w)})))
    return out


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and entity; the contexts of an entity in a document are one list."""
    schema = pa.schema([("entity", pa.string()), ("contexts", pa.list_(pa.struct([("context", pa.string()), ("forms", pa.list_(pa.string()))])))])
    for b in batches:
        rows: list[dict] = []
        for x in b.column(0):
            by: dict[str, list] = {}
            for e, c, f in contexts(x.as_py() or ""):
                by.setdefault(e, []).append({"context": c, "forms": f})
            rows += [{"entity": e, "contexts": c} for e, c in by.items()]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _document_counts(asked: frozenset[str] | None):
    """In how many documents of a task each form stands, of all forms or those asked for; handed on in bounded parts."""
    word_asked = None if asked is None else {f for f in asked if f[-1] != "*"}
    stems_asked = [None if asked is None else {f[:-1] for f in asked if f[-1] == "*" and len(f) == n + 1} for n in STEMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        stems: list[Counter[str]] = [Counter() for _ in STEMS]

        def made() -> pa.RecordBatch:
            names = [*counts, *(f"{w}*" for c in stems for w in c)]
            return pa.record_batch({"form": pa.array(names, pa.string()), "documents": pa.array([*counts.values(), *(n for c in stems for n in c.values())], pa.int64())})

        for b in batches:
            for x in b.column(0):
                text = x.as_py()
                if text:
                    words = _words(text)
                    own = {w if len(w) <= LONG else key(w) for w in words}
                    counts.update(own if word_asked is None else own & word_asked)
                    for n, c, some in zip(STEMS, stems, stems_asked, strict=True):
                        if some is None or some:
                            own = {w[:n] for w in words if len(w) > n}
                            c.update(own if some is None else own & some)
                    if len(counts) > HELD_WORDS:
                        yield made()
                        counts.clear()
                        for c in stems:
                            c.clear()
        yield made()

    return run


def disclosing(docs: DataFrame, part: float = PART, least_contexts: int = LEAST_CONTEXTS, least_bits: float = LEAST_BITS) -> DataFrame:
    """(text) -> (form): words, and beginnings of words marked with a star, that disclose a protected entity.

    Counted over all documents: n those there are, n_e those that hold the entity, n_f those that hold the form, n_ef those
    where it stands near the entity. The form discloses the entity if log2(n_ef n / (n_f n_e)) is at least ``part`` of
    log2(n / n_e), n_ef times as many bits are at least ``least_bits``, and there are ``least_contexts`` different contexts.
    An entity that every document holds tells nothing and is disclosed by nothing. Copies of a text count as documents, but
    their contexts as one.
    """
    texts = docs.select("text")
    n = texts.count()
    rows = texts.mapInArrow(_context_rows, "entity string, contexts array<struct<context:string,forms:array<string>>>")
    rows = cut(rows.groupBy("entity", "contexts").agg(F.count("*").alias("copies")))  # copies of a text become one row in each task
    whole = cut(rows.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.sum(F.size("contexts")).alias("spans")))
    # an entity of fewer contexts can have no form with enough of them; a hot entity's rows are dealt out by their contexts
    common = salted_join(rows, whole.where(F.col("spans") >= least_contexts).select("entity"), "entity", "contexts", 10_000)
    near = common.select("entity", F.explode("contexts").alias("c")).select("entity", "c.context", F.explode("c.forms").alias("form"))
    enough = cut(near.distinct().groupBy("entity", "form").agg(F.count("*").alias("k")).where(F.col("k") >= least_contexts).select("entity", "form"))
    apart = common.select("entity", "copies", F.explode(F.array_distinct(F.flatten("contexts.forms"))).alias("form"))
    meet = apart.groupBy("entity", "form").agg(F.sum("copies").alias("n_ef")).join(enough, ["entity", "form"])
    some = cut(enough.select("form").distinct())
    asked = frozenset(r.form for r in some.collect()) if some.count() <= FEW_WORDS else None  # more of them: all forms are counted
    counts = texts.mapInArrow(_document_counts(asked), "form string, documents bigint").groupBy("form").agg(F.sum("documents").alias("n_f"))
    pairs = cut(salted_join(meet, whole.select("entity", "n_e"), "entity", "form", 10_000))
    told = F.log2(F.col("n_ef") * F.lit(float(n)) / (F.col("n_f") * F.col("n_e")))
    known = F.log2(F.lit(float(max(n, 1))) / F.col("n_e"))
    judged = salted_join(pairs, counts, "form", "entity", 10_000)
    return judged.where((known > 0) & (told >= part * known) & (F.col("n_ef") * told >= least_bits)).select("form").distinct()


def generalise(word: str, forbidden) -> str | None:
    """What stands for a word (in lower case): nothing (None) if it may stay, else its longest harmless beginning, or "" to remove it."""
    own = forms(word)
    if own[0] not in forbidden:
        return None
    return next((f for f in own[1:] if f not in forbidden), "")


_SPAN = "struct<start:bigint,kind:int,end:bigint,put:string>"


def _find(texts: Iterator[str], forbidden: set[str]) -> Iterator[list[dict]]:
    hashed = any(f[0] == "#" for f in forbidden)  # then words must be looked at one by one
    for text in texts:
        base = base_spans(text)
        found = [(a, k, z, f"[{KINDS[k]}]") for a, k, z in base]
        if forbidden and (hashed or not forbidden.isdisjoint(map(str.lower, WORD.findall(text)))):
            found += [(a, 4, z, put) for a, z in words_outside(text, base) if (put := generalise(text[a:z].lower(), forbidden)) is not None]
        yield [dict(zip(("start", "kind", "end", "put"), s, strict=True)) for s in sorted(found)]


def sanitise(docs: DataFrame, part: float = PART, least_contexts: int = LEAST_CONTEXTS, least_bits: float = LEAST_BITS) -> DataFrame:
    """(doc_id, text) -> (doc_id, spans, sanitised), one row per row of ``docs``.

    ``spans`` are (start, kind, end, put) in code points of the text: the personal data, of kinds 0 to 3 of ``KINDS``, and the
    words that disclose some, of kind 4; ``put`` is what stands there instead. ``sanitised`` is the text with that put in;
    where spans overlap, the first one's. Null texts count as empty ones: no spans, an empty result. Rows that share a doc_id
    or text, or have no doc_id, are treated each by its own text; other columns are not looked at; an empty table gives an
    empty one. Every step is linear in a text's length.
    """
    own = docs.select(F.col("doc_id").cast("bigint"), "text")
    forms_ = cut(disclosing(own, part, least_contexts, least_bits))
    words = forms_.where(~F.col("form").endswith("*"))
    if words.count() > FEW_WORDS:
        return _sanitise_joined(own, forms_)
    # words up to FEW_WORDS, and of the stars those that a word among them begins with
    stars = words.select(F.explode(F.array(*[F.concat(F.substring("form", 1, n), F.lit("*")) for n in STEMS])).alias("form")).distinct()
    forbidden = {r.form for r in words.unionByName(forms_.join(stars, "form", "left_semi")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            yield from _results(b.column(0), texts, _find(iter(texts), forbidden))

    return own.mapInArrow(run, f"doc_id bigint, spans array<{_SPAN}>, sanitised string")


_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("put", pa.string())]))


def _results(ids: pa.Array, texts: list[str], found: Iterator[list[dict]]) -> Iterator[pa.RecordBatch]:
    first, spans, made, held = 0, [], [], 0
    for i, s in enumerate(found):
        spans.append(s)
        made.append(put_in(texts[i], s))
        held += len(texts[i])
        if held > BATCH_CHARS or i + 1 == len(texts):
            yield pa.record_batch({"doc_id": ids.slice(first, len(made)), "spans": pa.array(spans, _ARROW_SPANS), "sanitised": pa.array(made, pa.string())})
            first, spans, made, held = i + 1, [], [], 0


def put_in(text: str, spans: list[dict]) -> str:
    """The text with each span replaced; a span that begins inside an earlier one only lengthens it."""
    out, done = [], 0
    for s in spans:
        if s["start"] >= done:
            out += [text[done : s["start"]], s["put"]]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def _sanitise_joined(own: DataFrame, forms_: DataFrame) -> DataFrame:
    """``sanitise`` for any number of disclosing words: the forms that each different text holds are looked up by a join."""
    both = ["h1", "h2"]
    # numbered where the rows are read, so that a task that runs again deals its rows out as before
    keyed = own.select("doc_id", "text", F.monotonically_increasing_id().alias("place"), F.xxhash64("text").alias("h1"), F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 16).alias("h2"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column(0)):
                held = sorted(_all_forms(x.as_py() or ""))
                at = pa.array([i] * len(held), pa.int32())
                yield pa.record_batch({"form": pa.array(held, pa.string()), "h1": b.column(1).take(at), "h2": b.column(2).take(at)})

    asked = keyed.select("text", *both).mapInArrow(words, "form string, h1 bigint, h2 string").distinct()
    hits = salted_join(asked, forms_, "form", "h2", 10_000).groupBy(*both).agg(F.collect_set("form").alias("forbidden"))  # forms of one text
    hits = hits.withColumn("both", F.struct("h1", "h2")).select("both", "forbidden")
    rows = keyed.select("doc_id", "text", "place", F.struct("h1", "h2").alias("both"))
    with_hits = salted_join(rows.join(hits.select("both"), "both", "left_semi"), hits, "both", "place", 1000)
    joined = with_hits.select("doc_id", "text", "forbidden").unionByName(rows.join(hits.select("both"), "both", "left_anti").select("doc_id", "text", F.lit(None).cast("array<string>").alias("forbidden")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            found = (next(_find(iter([t]), set(f.as_py() or ()))) for t, f in zip(texts, b.column(2), strict=True))
            yield from _results(b.column(0), texts, found)

    return joined.mapInArrow(run, f"doc_id bigint, spans array<{_SPAN}>, sanitised string")


def listed(spans: Column, base: bool = False) -> Column:
    """Spans as kind:start:end, joined by commas: all, or those of the fixed patterns."""
    own = F.filter(spans, lambda s: s.kind < 4) if base else spans
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind))
