"""Personal data and what discloses it, codebooks, fill-in-the-middle: against brute force, SQL and exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codebooks, disclosure, infill, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hard(spark):
    texts = [(1, None), (2, ""), (3, "   \n"), (4, "a"), (5, "É́ \U0001f600 日本語"), (6, "same here"), (6, "same here"), (None, "no id +1 (212) 555-0199"), (9, "<P> a b <M>"), (None, None), (10, "x" * 300_000), (11, "a b\t" * 100_000)]
    rows = [(i, t, "en", "s", None) for i, t in texts]
    extra = {c: F.lit("z") for c in ("form", "h1", "spans", "place", "kind", "output", "entity", "n", "label")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


def rows_by_sql(sf: str, name: str) -> list[tuple]:
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return sorted((tuple(r[c] for c in sorted(r)) for r in con.execute(queries.ORACLE_SQL[name]).to_arrow_table().to_pylist()), key=repr)


@pytest.mark.parametrize("name", ["op12_codebooks", "op13_infill"])
def test_equals_sql(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    assert sorted((tuple(r[c] for c in sorted(out.columns)) for r in out.collect()), key=repr) == rows_by_sql(sf, name)


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """The patterns as they are written, and what is asked of their matches."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "phone": lambda d=digits: 9 <= len(d) <= 15,
                    "card": lambda d=digits, s=doubled: 12 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in s) % 10 == 0}[kind]
            if good():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_plain_ones():
    random.seed(7)
    signs = ["a@.b-", "0123. ", "12 -+().", "a@1.+-% 2", "4 1-", "+1234567890() .-", "25.@"]
    found = 0
    for _ in range(30_000):
        text = "".join(random.choice(random.choice(signs)) if random.random() < 0.2 else random.choice(signs[_ % 7]) for _i in range(random.randint(0, 40)))
        found += len(want := plain_spans(text))
        assert disclosure.base_spans(text) == want, text
    assert found > 1000


@pytest.mark.parametrize("text", ["1 " * 400_000, "1" * 800_000, "a" * 800_000, "a@" * 400_000, "a@b" + ".c" * 400_000, "1." * 400_000, "+1(" * 300_000])
def test_long_runs_take_linear_time(text):
    assert isinstance(disclosure.base_spans(text), list)


def test_personal_data_of_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = list(disclosure.KINDS)
    out = queries.op11_disclosure(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        want = plain_spans(texts[r.doc_id])
        text = ",".join(f"{names[k]}:{a}:{z}" for a, k, z in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{n}"] for n in names[:4]] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def corpus() -> list[str]:
    """600 texts; two words stand only near one address, one beginning of a word near another, all else is chance."""
    rng = random.Random(3)
    common = [f"word{i}" for i in range(40)]
    texts = []
    for i in range(600):
        words = rng.choices(common, k=30)
        if i % 20 == 0:
            words[10:10] = ["Zorblatt", rng.choice(common), "who", "is", "zed.9@mail.example.com", f"quirk{'abcdefgh'[i // 20 % 8]}"]
        if i % 50 == 7:
            words[5:5] = ["call", "+1 (212) 555-0199", "glimmer"]
        if i % 3 == 0:
            words.append("10.0.0.1")
        texts.append(" ".join(words))
    return [*texts, *[texts[0]] * 50]


def brute_forms(texts: list[str]) -> set[str]:
    n, has, near, where, seen = len(texts), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        spans = plain_spans(text)
        words = [m for m in disclosure.WORD.finditer(text) if all(z <= m.start() or m.end() <= a for a, _, z in spans)]
        for m in disclosure.WORD.finditer(text):
            for f in disclosure.forms(m[0].lower()):
                where[f].add(i)
        for a, k, z in spans:
            e = disclosure.entity(text[a:z], k)
            has[e].add(i)
            close = [m[0].lower() for m in [*[m for m in words if m.start() < a][-disclosure.NEAR :], *[m for m in words if m.start() >= z][: disclosure.NEAR]]]
            for w in close:
                for f in disclosure.forms(w):
                    near[e, f].add(i)
                    seen[e, f].add(tuple(close))
    out = set()
    for (e, f), docs in near.items():
        known, told = math.log2(n / len(has[e])), math.log2(len(docs) * n / (len(where[f]) * len(has[e])))
        if known > 0 and len(seen[e, f]) >= disclosure.LEAST_CONTEXTS and told >= disclosure.PART * known and len(docs) * told >= disclosure.LEAST_BITS:
            out.add(f)
    return out


def test_disclosing_words_equal_brute_force(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_forms(texts)
    assert {"zorblatt", "zorb*", "quir*", "glimmer"} <= want and "word1" not in want
    assert {r.form for r in disclosure.disclosing(docs).collect()} == want
    out = {r.doc_id: r for r in disclosure.sanitise(docs).collect()}
    assert "orblatt" not in out[0].sanitised and "[email]" in out[0].sanitised and "zed.9" not in out[0].sanitised
    for i, text in enumerate(texts):
        spans = [(s.start, s.kind, s.end) for s in out[i].spans]
        assert spans == sorted(spans) and set(plain_spans(text)) <= set(spans)
        terms = {text[a:z].lower() for a, k, z in spans if k == 4}
        assert terms == {m[0].lower() for m in disclosure.WORD.finditer(text)} & want - {"mail", "example", "com"}
    monkeypatch.setattr(disclosure, "FEW_WORDS", 0)
    joined = {r.doc_id: r for r in disclosure.sanitise(docs.withColumn("place", F.lit(1))).collect()}
    assert joined == out


def test_a_word_is_generalised_as_far_as_needed():
    assert disclosure.generalise("zorblatt", {"other"}) is None
    assert disclosure.generalise("zorblatt", {"zorblatt"}) == "zorb*"
    assert disclosure.generalise("zorblatt", {"zorblatt", "zorb*"}) == "zo*"
    assert disclosure.generalise("zorblatt", {"zorblatt", "zorb*", "zo*"}) == ""
    assert disclosure.put_in("call +1 now", [{"start": 5, "end": 7, "put": "[phone]"}, {"start": 6, "end": 8, "put": "no"}]) == "call [phone]now"


def test_hard_rows_of_personal_data(spark, hard):
    out = disclosure.sanitise(hard)
    got = sorted(out.select("doc_id", F.size("spans").alias("n"), F.length("sanitised").alias("chars")).collect(), key=repr)
    assert len(got) == 12 and [(r.n, r.chars) for r in got if r.doc_id == 1] == [(0, 0)]
    assert sorted(r.n for r in got if r.doc_id is None) == [0, 1]
    assert disclosure.sanitise(hard.limit(0)).collect() == []


# ---- codebooks


def brute_codes(rows: list[tuple]) -> tuple[dict, str]:
    """Python numbers only; rows (id, vector, label) in the order of the entries."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows]
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(4):
        members = [defaultdict(list) for _ in range(4)]
        for _, v, _ in kept:
            for p in range(4):
                members[p][near(v, p)[1]].append(cut(v, p))
        for p in range(4):
            for e, vs in members[p].items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = {}
    for i, v, y in kept:
        found = [near(v, p) for p in range(4)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), y)
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e12])
def test_codes_equal_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 3) * scale], [None, 1, 2][i % 3]) for i in range(300)]
    bad = [(400, None, 1), (401, [1.0, None] * 4, 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, None), (404, [1.0] * 4, 2), (405, [], 2)]
    df = spark.createDataFrame([*rows[::-1], *bad], "vec_id long, embedding array<double>, label int").repartition(3).withColumns({"kind": F.lit("k"), "error": F.lit(1), "entries": F.lit(1)})
    want, digest = brute_codes(rows)
    sums = defaultdict(int)
    for _, error, y in want.values():
        sums[y] += error
    out = codebooks.compress(df).collect()
    assert {(r.vec_id, r.code) for r in out} == {(i, c) for i, (c, _, _) in want.items()} and {r.codebooks_sha256 for r in out} == {digest}
    most = codebooks.MOST_ERROR
    assert all(r.error == min(want[r.vec_id][1], most) for r in out)
    if scale < 1e12:
        assert all(r.label_error == sums[want[r.vec_id][2]] for r in out)


def test_codes_of_hard_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    same = spark.createDataFrame([(None, [1.0] * 6, None), (1, [0.5, -0.5] * 3, "a"), (1, [0.5, -0.5] * 3, "a"), (None, None, "a")], schema)
    out = codebooks.compress(same).collect()
    assert len(out) == 3 and all(r.error == 0 for r in out) and len({r.codebooks_sha256 for r in out}) == 1
    assert codebooks.compress(same.limit(0)).collect() == []
    assert codebooks.compress(same.where("embedding IS NULL")).collect() == []


# ---- fill-in-the-middle


def test_infill_hard_rows(spark, hard):
    made = infill.infill(hard, rate=100)
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r.doc_id, r.back) for r in rows if r.doc_id) == sorted((r.doc_id, r.text or "") for r in hard.collect() if r.doc_id)
    by = {r.doc_id: r for r in rows}
    assert by[1].form == by[2].form == by[9].form == "plain" and by[9].prefix_chars is None and by[9].output == "<P> a b <M>"
    assert by[11].form != "plain" and by[11].n == 200_001 and by[10].n == 1 and by[3].n == 1
    assert {r.form for r in rows} <= {"plain", "spm", "psm"}
    assert infill.infill(hard.limit(0)).collect() == []


def test_units_equal_pattern():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(" \t\n\r\x0b\x0cab\x08\x0e\x1f!\x85\xa0é\U0001f600") for _ in range(rng.randint(0, 30)))
        want = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
        assert infill.borders(text)[1].tolist() == want
