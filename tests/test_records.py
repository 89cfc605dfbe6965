"""Records, versions in chains, packets, diagrams and code windows on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import canonical, diagrams, text, vectors
from tessera.operators import chunking, crawl, delta, evaluation, integrity, records, relations, retrieval, store
from tessera.sources import files
from tessera.streaming import capture


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


DOCS, CHUNKS, TOMBS = "document_id string, content_hash string", "chunk_id string, document_id string", "tombstone_id string, entity_type string, entity_id string"


def version(spark, docs, chunks, tombs=()):
    make = lambda x, schema: spark.createDataFrame(list(x), schema)
    return {"documents": make(docs, DOCS), "chunks": make(chunks, CHUNKS), "tombstones": make(tombs, TOMBS)}


def test_versions_in_a_chain(spark, tmp_path):
    root = str(tmp_path / "v")
    files.write_version(version(spark, [("a", "1"), ("b", "1")], [("c1", "a"), ("c2", "b")]), root, "v1", {"export_mode": "full_snapshot"})
    files.write_delta(version(spark, [("b", "2"), ("d", "1")], [("c3", "b")], [("t1", "chunk", "c2")]), root, "v2", "v1", {})
    files.write_delta(version(spark, [], [], [("t2", "document", "a"), ("t3", "chunk", "c1")]), root, "v3", "v2", {})
    streams, manifest = files.read_version(spark, root)
    assert manifest["base_dataset_version"] == "v2" and manifest["counts"]["tombstones"] == 2
    assert rows(streams["documents"]) == [("b", "2"), ("d", "1")] and rows(streams["chunks"]) == [("c3", "b")]
    assert rows(files.read_version(spark, root, "v2")[0]["documents"]) == [("a", "1"), ("b", "2"), ("d", "1")]
    with pytest.raises(ValueError, match="tombstone_target"):
        files.write_delta(version(spark, [], [], [("t4", "chunk", "c2")]), root, "v4", "v3", {})
    assert files.latest_version(spark, root) == "v3"
    files.rollback(spark, root, "v1")
    assert files.latest_version(spark, root) == "v1"
    with pytest.raises(FileNotFoundError):
        files.rollback(spark, root, "v4")
    with pytest.raises(ValueError):
        files.write_delta(version(spark, [], []), root, "v1", "v1", {})


def test_a_circle_of_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    for name, base in (("v1", "v2"), ("v2", "v1")):
        files.write_version(version(spark, [], []), root, name, {"export_mode": "delta", "base_dataset_version": base})
    with pytest.raises(ValueError, match="circle"):
        files.read_version(spark, root, "v1")


def test_a_version_is_checked_before_it_is_seen(spark, tmp_path):
    root = str(tmp_path / "v")
    bad = version(spark, [("a", "1"), ("a", "2")], [])
    with pytest.raises(ValueError, match="id_unique"):
        files.write_version(bad, root, "v1", {}, lambda s: integrity.duplicates(s["documents"], "document_id", "id_unique"))
    assert not (tmp_path / "v" / "LATEST").exists() and not (tmp_path / "v" / "v1").exists()
    files.write_version(version(spark, [("a", "1")], []), root, "v1", {})
    (tmp_path / "v" / "v1" / "more").mkdir()
    with pytest.raises(ValueError, match="exactly the streams"):
        files.read_version(spark, root)


def test_packets(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_packet({"documents": spark.createDataFrame([(2, "b"), (1, "a")], "id long, t string")}, path, {"documents": "id"}, {"kind": "x"})
    got = files.read_packet(spark, path, {"documents": "id long, t string"})
    assert [tuple(r) for r in got["documents"].collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="nothing else"):
        files.read_packet(spark, path, {"documents": "id long, t string", "chunks": "id long"})


def test_runs_cases_and_texts(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for name, body in {"b": {"run_id": "b", "created_at": "2026-01-02", "layer1": {"hit_at_10": 0.5, "mrr": 0.4, "n_cases": 3}}, "a": {"run_id": "a", "created_at": "2026-01-01", "layer1": {"hit_at_10": 0.7, "mrr": 0.4, "n_cases": 3}, "layer2": {"hit_at_10": 0.6, "mrr": 0.1, "n_cases": 3}}, "x": {"no": 1}}.items():
        (tmp_path / "r" / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "r" / "broken.json").write_text("{")
    out = evaluation.report(files.read_runs(spark, str(tmp_path / "r"))).collect()
    assert [r.run_id for r in out] == ["a", "b"] and abs(out[0].gap10 - 0.1) < 1e-9 and out[1].gap10 is None and out[1].n_cases == 3
    runs = spark.createDataFrame([("a", "x", "1", 0.1, 0.2, 0.3), ("b", "y", "2", 0.1, 0.4, 0.2)], "run_id string, label string, created_at string, hit5 double, hit10 double, mrr double")
    assert "| b | y | 0.1000 | 0.4000 | 0.2000 | -0.1000 |" in evaluation.leaderboard_markdown(runs)
    assert rows(evaluation.layer_gap(runs.where("run_id = 'b'"), runs.where("run_id = 'a'"), ["hit5"])) == [(0.0,)]
    (tmp_path / "cases.jsonl").write_text('# no\n\n{"id": "1", "user_question": "u", "search_query": "q", "tags": ["a"], "relevant_chunk_ids": ["c"]}\n')
    assert [r.id for r in files.read_cases(spark, str(tmp_path / "cases.jsonl")).collect()] == ["1"]
    (tmp_path / "bad.jsonl").write_text('{"id": "1", "user_question": "u", "search_query": "q", "relevant_chunk_ids": []}\n')
    with pytest.raises(Exception, match="nothing is relevant"):
        files.read_cases(spark, str(tmp_path / "bad.jsonl")).collect()
    assert files.read_texts(spark, str(tmp_path / "cases.jsonl")).first().text.startswith("# no")
    assert files.read_json_lines(spark, str(tmp_path / "r" / "a.json"), "run_id string").first().run_id == "a"


DIAGRAM = b"""<mxfile><diagram name="P"><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>
<mxCell id="g" vertex="1" parent="1" value="Gro&quot;up"/><mxCell id="a-1" vertex="1" parent="g" value="A&lt;br&gt;&lt;b&gt;x&lt;/b&gt;"/><mxCell id="a.1" vertex="1" parent="1"/>
<mxCell id="e" edge="1" parent="1" source="a-1" target="a.1" value="to"/><mxCell id="f" edge="1" parent="1" source="a-1"/></root></mxGraphModel></diagram></mxfile>"""


def test_diagrams(spark, tmp_path):
    twice = DIAGRAM.replace(b'id="a.1"', b'id="g"')
    circle = DIAGRAM.replace(b'id="g" vertex="1" parent="1"', b'id="g" vertex="1" parent="a-1"')
    bodies = [("m1", DIAGRAM), ("m2", b"<!DOCTYPE x><mxfile/>"), ("m3", b"<mxfile><diagram>packed</diagram></mxfile>"), ("m4", None), ("m5", twice), ("m6", circle)]
    out = {r.media_id: r for r in diagrams.read_diagrams(spark.createDataFrame(bodies, "media_id string, body binary")).collect()}
    assert all((r.mermaid is None) == (m != "m1") and (r.fault is None) == (m == "m1") for m, r in out.items())
    assert (out["m1"].boxes, out["m1"].arrows) == (3, 2)
    assert json.loads(out["m1"].extracted_text.split("\n")[0]) == {"cell_id": "a-1", "container_ids": ["g"], "diagram_id": "P", "kind": "vertex", "label": "A\nx"}
    assert out["m1"].mermaid == 'flowchart TD\n    a_1\n    subgraph g["Gro&quot;up"]\n        a_1_1["A<br/>x"]\n    end\n    a_1_1 -->|"to"| a_1\n'
    files.write_diagrams(spark.createDataFrame([("m1", out["m1"].mermaid), ("m2", None)], "media_id string, mermaid string"), str(tmp_path / "d"))
    assert [p.name for p in (tmp_path / "d").iterdir() if p.name[0] != "."] == ["m1.mmd"] and (tmp_path / "d" / "m1.mmd").read_text() == out["m1"].mermaid + "\n"


def test_entities_cells_and_times(spark):
    assert text.named_entities("a&nbsp;&amp;<![CDATA[&nbsp;]]><!--&x;-->&eacute;") == "a&#xA0;&amp;<![CDATA[&nbsp;]]><!--&x;-->&#xE9;"
    with pytest.raises(ValueError):
        text.named_entities("&nosuchthing;")
    assert text.row_cells(r"| a | b\|c |  |") == [" a ", r" b\|c ", "  "] and text.row_cells("x") == ["x"] and text.row_cells(r"|a\\|b|") == [r"a\\", "b"]
    times = ["2026-01-01T02:00:00+02:00", "2026-01-01t00:00:00.25z", "2026-01-01T00:00:00", "2026-02-30T00:00:00Z", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(text.instant(F.col("t")))
    assert [r[0] for r in df.collect()] == ["2026-01-01T00:00:00.000000Z", "2026-01-01T00:00:00.250000Z", None, None, None]


def test_char_windows_follow_the_line_feed():
    body = "a" * 900 + "\n" + "b" * 900
    assert text.cut_windows(body, 1000, 100) == ["a" * 900, "a" * 99 + "\n" + "b" * 900]
    assert text.cut_windows("  " + "x" * 20, 10, 2) == ["x" * 8, "x" * 10, "x" * 6]


def test_code_windows(spark):
    b = chunking.Budget(target=20, hard=30, lines=6, repeat=2, least=5)
    windows = chunking.code_windows_of(["l"] * 20, [3] * 20, 2, b)
    assert windows[0] == (0, 6) and windows[1] == (4, 10) and windows[-1][1] == 20
    assert all(e - s <= 6 and 2 + 3 * (e - s) <= 30 for s, e in windows)
    assert chunking.code_windows_of(["a", "b", "c"], [1, 25, 1], 2, b) == [(0, 2), (0, 3)]
    with pytest.raises(ValueError, match="hard limit"):
        chunking.code_windows_of(["a"], [40], 2, b)
    df = spark.createDataFrame([("d", "src/a.py", "x = 1\n" * 100), ("e", "f", None)], "document_id string, path string, text string")
    out = chunking.code_windows(df).orderBy("part_index").collect()
    assert out[0].text.startswith("src/a.py\n\nx = 1\n") and out[0].line_end == 40 and out[1].line_start == 37 and out[0].part_total == len(out)


def test_batches_keep_nulls(spark):
    df = spark.createDataFrame([(None,), (None,), *((i,) for i in range(97))], "k long").repartition(3)
    for shards in (1, 8):
        out = crawl.batches(df, "k", 10, shards).groupBy("batch").count().collect()
        assert sorted((r.batch, r["count"]) for r in out) == [(i, 10) for i in range(9)] + [(9, 9)]


def test_conflicting_tombstones_fail(spark):
    t = spark.createDataFrame([("chunk", "1", "r", "a"), ("chunk", "1", "r", "b"), ("chunk", "2", "r", None)], "entity_type string, entity_id string, reason string, detail string")
    assert delta.conflicts(t).count() == 1
    with pytest.raises(Exception, match="contradict"):
        delta.tombstones(t, "v", "now").collect()
    assert delta.tombstones(t.where("entity_id = '2'"), "v", "now").count() == 1


def test_raw_store(spark):
    stored = spark.createDataFrame([("r", 1, b"x", None), ("r", 2, b"y", "bad")], "run_id string, page_id int, body binary, sha256 string").withColumn("sha256", F.coalesce("sha256", F.sha2("body", 256)))
    assert records.read_raw(stored, "r", 1).first().body == b"x" and records.read_raw(stored, "r", 9).count() == 0
    with pytest.raises(Exception, match="hash"):
        records.read_raw(stored, "r", 2).collect()
    new = stored.select("run_id", "page_id", "body").unionByName(spark.createDataFrame([("r", 3, b"z")], "run_id string, page_id int, body binary"))
    assert rows(records.publish_raw(stored, new).select("page_id", "status")) == [(1, "REPLAYED"), (2, "REPLAYED"), (3, "PUBLISHED")]
    assert crawl.within_budget(new, stored, 3) and not crawl.within_budget(new, stored, 2)


def test_ambiguous_diagrams_and_double_ids_fail(spark):
    files_ = spark.createDataFrame([(1, "d", "a1"), (1, "d", "a2"), (1, "d.png", "a3")], "page_id int, filename string, attachment_id string")
    asked = spark.createDataFrame([(1, "d.png"), (1, "d")], "page_id int, filename string")
    assert rows(records.match_diagrams(asked.limit(1), files_)) == [(1, "d.png", None)]
    with pytest.raises(Exception, match="ambiguous"):
        records.match_diagrams(asked, files_).collect()
    with pytest.raises(Exception, match="duplicate page_id"):
        records.union_sources([files_], "page_id").collect()


def test_short_links(spark):
    urls = ["https://w/x/AQ", "https://w/x/_wA", "https://w/ctx/x/ZAE", "https://w/x/", "https://w/pages/viewpage.action?pageId=5&title=", "https://w/pages/viewpage.action?title=a&pageId=7"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(records.page_address(F.col("u")).alias("a")).select("a.*")
    assert [(r.base_url, r.page_id) for r in df.collect()] == [("https://w", "1"), ("https://w", "255"), ("https://w/ctx", "356"), (None, None), (None, None), ("https://w", "7")]


def test_digest_of_rows_is_independent_of_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, s string")
    one = canonical.rows_digest(df).first()
    assert one == canonical.rows_digest(df.orderBy(F.desc("k")).repartition(3)).first() and one != canonical.rows_digest(df.distinct()).first()
    assert canonical.rows_digest(df.limit(0)).first().rows == 0


def test_requests(spark):
    hits = spark.createDataFrame([(i, 1.0 - i / 100, i) for i in range(1, 61)], "doc_id long, score double, rank int")
    content = spark.createDataFrame([(i, f"t{i}") for i in range(1, 61) if i != 2], "doc_id long, text string")
    out = retrieval.retrieve("q", hits, content, "doc_id", 3, 0.0, None, F.col("doc_id") / 100.0).collect()
    assert [(r.doc_id, r.rank) for r in out] == [(50, 1), (49, 2), (48, 3)]  # the pool ends at 50
    assert [r.doc_id for r in retrieval.retrieve("q", hits, content, "doc_id", 3).collect()] == [1, 3]
    shown = spark.range(1).select(retrieval.format_hit(F.lit(1), F.lit(0.5), F.lit("T"), F.lit("b"))).first()[0]
    assert shown == "[1] T (score: 0.5000)\nb"
    extra = spark.createDataFrame([(1, {"a": "x"})], "doc_id int, extra map<string,string>")
    assert rows(retrieval.citations(extra, ["doc_id"], "extra", ["a", "b"])) == [(1, "x", None)]


def test_chunks_carry_keys(spark):
    docs = spark.createDataFrame([("d", "AB-1 and CD-2"), ("e", None)], "document_id string, text string")
    chunks = spark.createDataFrame([("c", "d"), ("f", "e")], "chunk_id string, document_id string")
    assert {r.chunk_id: r.jira_keys for r in relations.keys_on_chunks(chunks, docs).collect()} == {"c": ["AB-1", "CD-2"], "f": []}
    merged = spark.createDataFrame([(["b"], ["a", "b"]), (None, ["c"])], "o array<string>, n array<string>").select(relations.merge_relation_ids(F.col("o"), F.col("n")))
    assert [r[0] for r in merged.collect()] == [["a", "b"], ["c"]]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, 'a' AS event_type, 1 AS k UNION ALL SELECT timestamp'2026-01-01 00:20:00', 'a', 1 UNION ALL SELECT timestamp'2026-01-01 02:10:00', 'b', 2").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("ts timestamp, event_type string, k int").parquet(source)
    for name, df, mode in (("counts", capture.window_counts(stream()), "complete"), ("first", capture.first_submissions(stream(), "k"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert rows(spark.table("counts").select("event_type", "count")) == [("a", 2), ("b", 1)]
    assert rows(spark.table("first").select("k")) == [(1,), (2,)]


def test_empty_tables(spark, tmp_path):
    from tessera.plans import queries

    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("retrieve_topk", "retrieve_reranked", "dense_dot_topk", "dense_topk_many", "sparse_topk", "hybrid_rrf", "char_chunks", "normalize_text"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
    assert store.latest(spark.createDataFrame([], "k int, v int"), ["k"], ["v"]).count() == 0
    assert spark.createDataFrame([([1.0, 1.0],)], "v array<double>").select(vectors.norm(F.col("v"))).count() == 1


def test_lines_of_an_order_are_dealt_out_once(spark, sf):
    from tessera.plans.queries import QUERIES

    plan = QUERIES["order_violations"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line]
    assert len(dealt) == 1 and "l_linenumber" not in dealt[0], dealt
