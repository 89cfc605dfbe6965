"""Operators on small cases: edges, ties, nulls, and rules that the whole tables do not reach."""

from __future__ import annotations

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, markup, text, vectors
from tessera.operators import access, crawl, delta, evaluation, integrity, relations, retrieval, store
from tessera.sources import files
from tessera.streaming import capture


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_uuid5_equals_python(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    df = spark.createDataFrame([(x,) for x in ("", "a", "ü", "chunk:git:0")], "n string")
    for n, u in df.select("n", ids.uuid5(ns, F.col("n"))).collect():
        assert u == str(uuid.uuid5(uuid.UUID(ns), n))


def test_page_id_from_url(spark):
    urls = ["http://w/x?pageId=12&a=1", "http://w/spaces/A/pages/77/Title", "http://w/pages/x", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(ids.page_id_from_url(F.col("u")))
    assert [r[0] for r in df.collect()] == ["12", "77", None, None]


def test_normalize(spark):
    cases = {"a \r\nb \r\n\r\n\r\n\r\nc\n": "a\nb\n\nc", "é": "é", "": "", "\n\n": "", "x \ny": "x\ny"}
    df = text.normalize(spark.createDataFrame([(k,) for k in cases], "text string"))
    assert sorted(r[0] for r in df.collect()) == sorted(cases.values())
    assert text.normalize(spark.createDataFrame([(None,)], "text string")).first()[0] is None


def test_char_windows():
    assert text.cut_windows("  ") == []
    long = "".join(f"line {i}\n" for i in range(900))
    parts = text.cut_windows(long, 300, 30)
    assert all(len(p) <= 300 for p in parts)
    assert set(long.split()) <= set(" ".join(parts).split())  # a window may open inside a word that the one before it holds


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("z")), vectors.unit(F.col("a")), vectors.unit(F.col("z"))).first()
    assert tuple(r) == (5.0, 0.0, [0.6, 0.8], [0.0, 0.0])


def test_rrf_ties_keep_insertion_order(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    sparse = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    out = retrieval.fuse(dense, sparse, 3).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [11, 10, 12]


def test_filters_and_bounds(spark):
    with pytest.raises(ValueError):
        retrieval.payload_filter({"space": "x"}, ["label"])
    hits = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 2), (3, 0.1, 3)], "doc_id long, score double, rank int")
    content = spark.createDataFrame([(1, ["group:a"]), (2, ["group:b"]), (3, ["group:a", "restricted:unresolved"])], "doc_id long, acl_tags array<string>")
    assert [r.doc_id for r in retrieval.retrieve("q", hits, content, "doc_id", principals=["group:A"]).collect()] == [1]
    assert [r.doc_id for r in retrieval.retrieve("q", hits, content, "doc_id", threshold=0.5).collect()] == [1, 2]
    with pytest.raises(ValueError):
        retrieval.retrieve("  ", hits, content, "doc_id")
    assert [r.doc_id for r in retrieval.in_given_order([3, 9, 1], content, "doc_id").collect()] == [3, 1]


def test_metrics(spark):
    got = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 7, 6)], "case_id string, doc_id long, rank int")
    want = spark.createDataFrame([("a", 2), ("b", 7), ("c", 1)], "case_id string, doc_id long")
    assert rows(evaluation.case_scores(got, want)) == [("a", True, True, 0.5), ("b", False, True, 1 / 6), ("c", False, False, 0.0)]
    df = spark.createDataFrame([([4, 5], [5]), ([1], [2])], "a array<long>, r array<long>")
    assert [r[0] for r in df.select(evaluation.reciprocal_rank(F.col("a"), F.col("r"))).collect()] == [0.5, 0.0]
    empty = evaluation.summary(evaluation.case_scores(got, want.limit(0)), want).first()
    assert (empty.mrr, empty.evaluated, empty.skipped) == (0.0, 0, 3)


def test_principals(spark):
    df = spark.createDataFrame([(["Ann", "ann", "", "b c", None, "Bob"],)], "n array<string>")
    assert df.select(access.distinct_principals(F.col("n"))).first()[0] == ["Ann", "Bob"]


def test_access_rules(spark):
    levels = [
        ("open", 0, "1", "unrestricted", [], []), ("loose", 0, "1", "unrestricted", [], []), ("two", 0, "1", "restricted", ["A", "b"], []), ("two", 1, "2", "restricted", ["a"], ["g h"]),
        ("one", 0, "1", "unrestricted", [], []), ("one", 1, "3", "restricted", ["Z", "a"], []), ("none", 0, "1", "restricted", ["a"], []), ("none", 1, "2", "restricted", ["b"], []),
        ("lost", 0, "1", "unavailable", [], []), ("lost", 1, "2", "unrestricted", [], []),
    ]
    df = spark.createDataFrame(levels, "document_id string, level int, source_page_id string, classification string, users array<string>, groups array<string>")
    pages = spark.createDataFrame([("open", "KEY1"), ("loose", "bad key"), ("two", "K")], "document_id string, space_key string")
    out = {r.document_id: r for r in access.materialize(df, pages, "c", "t").collect()}
    said = lambda r: (r.is_restricted, r.acl_tags, r.acl_extraction_status, r.acl_confidence)
    assert said(out["open"]) == (False, ["space:KEY1"], "ok", "exact")
    assert said(out["loose"]) == (False, ["restricted:unresolved"], "partial", "approximate")
    assert said(out["two"]) == (True, ["user:a"], "partial", "approximate")
    assert said(out["one"]) == (True, ["user:a", "user:z"], "ok", "exact")
    assert said(out["none"]) == (True, ["restricted:unresolved"], "partial", "approximate")
    assert said(out["lost"]) == (True, ["restricted:unresolved"], "unavailable", "approximate")
    assert (out["two"].allowed_users, out["two"].restriction_source_page_ids, out["two"].restriction_inherited) == (["A", "b"], ["1", "2"], True)
    assert (out["one"].allowed_users, out["one"].restriction_inherited) == (["a", "Z"], False)
    assert out["two"].reason_codes == ["non_enforceable_group_principal", "user_principal_dropped_by_intersection"]
    assert out["none"].reason_codes == ["user_principal_dropped_by_intersection", "empty_effective_intersection"]
    assert out["lost"].allowed_users is None and out["lost"].restriction_source_page_ids is None


def test_issue_keys(spark):
    df = spark.createDataFrame([("1", "AB-1, xAB-2 and AB-1 (CD_E-30) AB-4x")], "document_id string, text string")
    assert df.select(relations.issue_keys(F.col("text"))).first()[0] == ["AB-1", "CD_E-30"]
    assert [r.evidence for r in relations.issue_relations(df, "t", ["AB"]).collect()] == ["AB-1"]


def test_ambiguous_attachment(spark):
    a = spark.createDataFrame([("1", "f", "m1"), ("1", "f", "m2"), ("1", "g", "m3")], "document_id string, filename string, media_id string")
    i = spark.createDataFrame([("1", "f"), ("1", "g")], "document_id string, filename string")
    assert {r.filename: r.media_id for r in relations.attach(i, a).collect()} == {"f": None, "g": "m3"}


def test_delta_round_trip(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "document_id string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "document_id string, content_hash string")
    o = delta.classify(old, new)
    assert rows(o) == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "new")]
    gone = o.where("outcome = 'removed'").select(F.lit("document").alias("entity_type"), F.col("document_id").alias("entity_id"), F.lit("source_deleted").alias("reason"), F.lit(None).cast("string").alias("detail"))
    changed = new.join(o.where("outcome IN ('new', 'changed')"), "document_id", "left_semi")
    whole = delta.overlay(old, changed, delta.tombstones(gone, "v", "t"), "document_id", "document")
    assert delta.differences(whole, new).count() == 0
    assert {r[0] for r in delta.classify(old, new, config_changed=True).select("outcome").collect()} == {"config_invalidated", "removed", "new"}


def test_inventory_conflicts(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "t"), (1, ["b"], "t"), (2, ["a"], "t"), (2, ["x"], "u"), (3, [], "t")], "page_id long, ancestor_ids array<string>, title string")
    out = {r.page_id: (r.ancestor_ids, r.conflicts) for r in crawl.resolve_inventory(df, ["title"]).collect()}
    assert out == {1: (["a", "b"], 0), 2: (["x"], 2), 3: ([], 0)}


def test_failures_and_delays(spark):
    df = spark.createDataFrame([(429,), (500,), (None,), (404,), (200,)], "s int").select(crawl.failure(F.col("s")).alias("f")).select("f.*")
    assert [tuple(r) for r in df.collect()] == [("rate_limited", True), ("server", True), ("transport", True), ("missing", False), ("none", False)]
    d = spark.createDataFrame([(1, None), (9, None), (1, 90)], "n int, after int").select(crawl.retry_delay(F.col("n"), F.col("after")))
    assert [r[0] for r in d.collect()] == [3.0, 60.0, 90.0]


def test_integrity(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert rows(integrity.duplicates(a, "k", "d")) == [("d", "1")]
    assert rows(integrity.unpaired(a, b, "k", "u")) == [("u", "1"), ("u", "3")]
    with pytest.raises(ValueError, match="d: 1"):
        integrity.require_none(integrity.duplicates(a, "k", "d"))
    g = integrity.gate(spark.range(1), [("small", F.col("id") < 1), ("big", F.col("id") > 5), ("none", F.lit(None).cast("boolean"))]).first()
    assert (g.passed, g.reasons) == (False, "big;none")


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, made string")
    new = spark.createDataFrame([(2, "c", "z"), (3, "d", "w")], "id long, v string, made string")
    once = store.upsert(base, new, ["id"], keep=["made"])
    assert rows(once) == rows(store.upsert(once, new, ["id"], keep=["made"])) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "w")]


def test_markdown():
    title, body = markup.render("<title>T</title><h2>Head</h2><p>a <b>b</b> <a href='javascript:x'>c</a> <a href='/d'>e</a><script>no</script><ul><li>1<li>2</ul><table><tr><th>x<th>y<tr><td>1|2</table><pre>c_d</pre>")
    assert title == "T"
    for part in ("## Head", "**b**", "[e](/d)", "- 1\n- 2", "| x | y |", r"| 1\|2 |  |", "```\nc_d\n```"):
        assert part in body
    assert "no" not in body and "javascript" not in body


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 1, "a": 2}\n{"a": NaN}\n[1]\n{"b": 1}\n')
    assert sorted(r.fault for r in files.json_faults(spark, str(p), ["a"]).collect()) == ["blank", "duplicate_key", "malformed", "not_an_object", "unknown_key"]
    out = str(tmp_path / "out")
    files.write_json_lines(spark.createDataFrame([(2, None), (1, "x")], "id long, a string"), out, "id")
    assert [json.loads(r[0]) for r in spark.read.text(out).collect()] == [{"a": "x", "id": 1}, {"a": None, "id": 2}]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    files.write_version({"documents": spark.range(3), "chunks": spark.range(5)}, root, "v1", {"export_mode": "full_snapshot"})
    streams, manifest = files.read_version(spark, root)
    assert manifest["counts"] == {"documents": 3, "chunks": 5} and streams["chunks"].count() == 5
    with pytest.raises(FileExistsError):
        files.write_version({"documents": spark.range(3)}, root, "v1", {})


def test_tree(spark, tmp_path):
    for name, body in {"src/a.py": b"x", "build/b.py": b"x", "vendor/c.c": b"x", "d.png": b"x", "e.c": b"a\0b"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    out = {r.path: (r.excluded, r.language) for r in files.read_tree(spark, str(tmp_path), "r").collect()}
    assert out["src/a.py"] == (None, "python")
    assert (out["build/b.py"][0], out["vendor/c.c"][0], out["d.png"][0], out["e.c"][0]) == ("generated", "vendor", "binary", "binary")


@pytest.mark.parametrize(("block", "cells"), [(100_000, 1 << 21), (40, 64)])
def test_sparse_search_equals_a_scan(spark, monkeypatch, block, cells):
    """Ties, weights of nothing, queries that share no term; in one block of queries and in several, whole and in small parts."""
    draw = random.Random(5)
    docs = [(f"d{i}", f"t{t}", float(draw.randrange(4))) for i in range(60) for t in draw.sample(range(30), draw.randrange(8))]
    asked = [(i, f"t{t}", float(draw.randrange(3))) for i in range(25) for t in draw.sample(range(40), draw.randrange(6))] + [(99, "none", 1.0)]
    met: dict = {}
    for q, term, x in asked:
        for d, other, w in docs:
            if term == other:
                met.setdefault(q, {}).setdefault(d, []).append(x * w)
    want = [(q, d, sum(s), i) for q, m in met.items() for i, (d, s) in enumerate(sorted(m.items(), key=lambda r: (-sum(r[1]), r[0]))[:4], 1)]
    monkeypatch.setattr(retrieval, "ASKED_TERMS", block)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    d, q = spark.createDataFrame(docs, "doc_id string, term string, weight double"), spark.createDataFrame(asked, "query_id int, term string, weight double")
    assert rows(retrieval.sparse_top_k(d, q, 4)) == sorted(want, key=repr)
    assert retrieval.sparse_top_k(d, q.limit(0), 4).count() == 0 and retrieval.sparse_top_k(d.limit(0), q, 4).count() == 0


def test_common_terms_do_not_meet_in_one_task(spark):
    asked = spark.createDataFrame([(1, "the", 1.0), (2, "the", 1.0)], "query_id long, term string, weight double")
    docs = retrieval.asked_postings(spark.createDataFrame([(i, "the end") for i in range(50)], "doc_id long, text string"), "doc_id", F.split("text", " "), asked)
    plan = retrieval.sparse_top_k(docs, asked, 3)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert [line for line in dealt if "doc_id" in line] and not [line for line in dealt if "doc_id" in line and "term" in line], dealt
    assert len([line for line in dealt if "(term" in line]) == 1, dealt  # the distinct terms of the queries


def test_capture_adds_each_page_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run_id string, page_id long, body string"
    for body in ("first", "second"):
        spark.createDataFrame([("r", 1, body), ("r", 2 if body == "first" else 3, body)], schema).write.mode("append").parquet(source)
        capture.capture(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(target).select("page_id", "body")) == [(1, "first"), (2, "first"), (3, "second")]


def test_decisions_of_a_page_are_framed_without_a_cast(monkeypatch):
    """A frame is made for every page: its columns have their types from the start, nulls and all."""
    import pandas as pd

    def astype(*_, **__):
        raise AssertionError("a frame was cast")

    monkeypatch.setattr(pd.DataFrame, "astype", astype)
    at = pd.Timestamp("2026-01-01 10:00:00.000001")
    made = capture._frame([("r", "1", at, "committed", "1", 200, "x"), ("r", "1", at, "overdue", None, None, None)])
    assert [str(t) for t in made.dtypes] == ["object", "object", "datetime64[us]", "object", "object", "Int32", "object"]
    assert made["at"].tolist() == [at, at] and made["http_status"].isna().tolist() == [False, True] and made["sha256"].tolist() == ["x", None]


def test_dense_search_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    want = sorted(store.dense_top_k_many(rows, asked, 3).collect())
    monkeypatch.setattr(store, "MOST_QUERIES", 4)
    assert sorted(store.dense_top_k_many(rows, asked, 3).collect()) == want and len(want) == 30


def test_short_items_are_relevant(spark, tmp_path):
    from tessera.plans import queries

    spark.createDataFrame([(1, "two words"), (2, "日本語"), (3, "a case of five words or more"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "these two words."), (2, "in 日本語 text"), (3, "it is a case of five words or more"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.case_id, r.doc_id) for r in queries._relevant(spark, str(tmp_path)).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_texts_of_relevant_documents_are_not_shuffled(spark, sf):
    from tessera.plans import queries

    plan = queries._relevant(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin [term" in plan
