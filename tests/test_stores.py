"""Stores kept in cells, the vectors and chunks in them, and the inverted index: against whole scans, and what a change touches."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inverted, vector_store
from tessera.sources import cells


def test_a_change_writes_its_cells_only(spark, tmp_path):
    root, schema = str(tmp_path / "s"), "k long, v string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    change = lambda rows, gone=None: {"t": cells.Change(frame(rows), ["k"], F.col("k").cast("int") % 5, None if gone is None else frame([(k, None) for k in gone]).select("k"))}
    read = lambda v=None: sorted((r.k, r.v, r.cell) for r in cells.read_store(spark, root, "t", schema, v).collect())
    assert cells.save(spark, root, "v1", change([(i, "a") for i in range(20)])) == {"t": [0, 1, 2, 3, 4]}
    assert cells.save(spark, root, "v2", change([(3, "b"), (23, "c")], gone=[6, 99]), "v1") == {"t": [1, 3]}
    want = {i: "a" for i in range(20)} | {3: "b", 23: "c"}
    del want[6]
    assert read() == sorted((k, v, k % 5) for k, v in want.items())
    assert read("v1") == [(i, "a", i % 5) for i in range(20)]  # the older version is as it was
    assert {x for x in os.listdir(f"{root}/v2/t") if x.startswith("cell=")} == {"cell=1", "cell=3"}
    assert cells.save(spark, root, "v3", change([], gone=[1, 6, 11, 16]), "v2") == {"t": [1]} and all(c != 1 for _, _, c in read())
    assert cells.save(spark, root, "v4", {}, "v3") == {} and read() == read("v3")
    assert sorted(r.k for r in cells.read_store(spark, root, "t", schema, "v2", [3]).collect()) == [3, 8, 13, 18, 23]
    for bad, error in (([(1, "x"), (1, "y")], "share a key"), ([(None, "x")], "no key")):
        with pytest.raises(ValueError, match=error):
            cells.save(spark, root, "v9", change(bad), "v4")
    with pytest.raises(FileExistsError):
        cells.save(spark, root, "v4", {}, "v3")
    assert read() == read("v3")  # the pointer did not turn


def test_vector_search_equals_a_scan_after_changes(spark, tmp_path):
    rng = np.random.default_rng(2)
    groups = rng.normal(size=(12, 6))
    vector = lambda i: [float(x) for x in groups[i % 12] + 0.2 * rng.normal(size=6)]
    data = {i: (i % 3, vector(i)) for i in range(600)}
    data[5] = data[17] = (0, data[0][1])  # ties
    schema = "chunk_id long, label int, embedding array<double>"
    frame = lambda d: spark.createDataFrame([(k, a, v) for k, (a, v) in d.items()], schema)
    chunk = lambda d: spark.createDataFrame([(k, f"t{k}") for k in d], "chunk_id long, text string")
    root = str(tmp_path / "s")
    centre = vector_store.centres(frame(data), 20)
    vector_store.save(spark, root, "v1", chunk(data), frame(data), centre, chunk_cells=4)
    new = {k: (k % 3, vector(k + 1)) for k in (3, 50, 700)}
    data = {k: v for k, v in (data | new).items() if k not in (9, 10)}
    gone = spark.createDataFrame([(9,), (10,)], "chunk_id long")
    touched = vector_store.save(spark, root, "v2", chunk(new), frame(new), centre, gone, "v1", chunk_cells=4)
    assert len(touched["vectors"]) < len(centre)
    queries = {100 + i: [float(x) for x in rng.normal(size=6)] for i in range(8)} | {1: data[0][1]}
    asked = spark.createDataFrame([*queries.items(), (2, None), (3, [0.0] * 6)], "query_id long, embedding array<double>")
    for filters, k in ((None, 4), ({"label": 1}, 4), (None, 1000)):
        want = {}
        for q, v in queries.items():
            u = np.array(v) / np.linalg.norm(v)
            s = sorted((-round(float(u @ np.array(x) / np.linalg.norm(x)), 12), key) for key, (a, x) in data.items() if filters is None or a == filters["label"])
            want[q] = [(key, i + 1) for i, (_, key) in enumerate(s[:k])]
        out = defaultdict(list)
        for r in vector_store.search(spark, root, schema, centre, asked, k, filters).orderBy("query_id", "rank").collect():
            out[r.query_id].append((r.chunk_id, r.rank))
        assert out == want
    assert {r.chunk_id for r in cells.read_store(spark, root, "chunks", "chunk_id long, text string").collect()} == set(data)
    with pytest.raises(ValueError, match="different keys"):
        vector_store.save(spark, root, "v3", chunk([1]), frame({2: data[2]}), centre, None, "v2")
    with pytest.raises(Exception, match="width 6"):
        vector_store.save(spark, root, "v3", chunk([1]), spark.createDataFrame([(1, 0, [1.0])], schema), centre, None, "v2")
    with pytest.raises(ValueError, match="cannot filter"):
        vector_store.search(spark, root, schema, centre, asked, 3, {"far": 1})


def test_index_equals_a_scan_and_scores_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 16)
    rng = random.Random(3)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    docs = {i: rng.choices(words, k=rng.choice([3, 10, 40, 200 if i % 50 == 0 else 5])) for i in range(1200)}
    queries = {q: rng.choices(words, k=4) + ["the"] for q in range(6)} | {50: ["absent"], 51: ["w1", "w1"]}

    def terms(rows: dict, key: str):
        counts = [(i, w, float(ws.count(w))) for i, ws in rows.items() for w in set(ws)]
        return spark.createDataFrame(counts, f"{key} long, term string, weight double")

    def best(k: int) -> dict:
        out = {}
        for q, ws in queries.items():
            s = [(-float(sum(docs[i].count(w) for w in ws)), i) for i in docs]
            out[q] = [(i, -x) for x, i in sorted(s)[:k] if x < 0]
        return {q: x for q, x in out.items() if x}

    def found(path: str, k: int) -> dict:
        out = defaultdict(list)
        for r in inverted.top_k(spark, path, terms(queries, "query_id"), k).orderBy("query_id", "rank").collect():
            out[r.query_id].append((r.doc_id, r.score))
        return out

    path = str(tmp_path / "i")
    assert inverted.add_segment(terms(docs, "doc_id"), path, "doc_id") == 1
    assert found(path, 5) == best(5) and found(path, 2000) == best(2000)
    changed = {i: ["the"] * 60 + ["w1"] for i in (3, 7)} | {2000: ["w1"] * 9}
    gone = spark.createDataFrame([(best(1)[0][0][0],), (7,), (5000,)], "doc_id long")
    top = best(1)[0][0][0]
    assert inverted.add_segment(terms(changed, "doc_id"), path, "doc_id", gone) == 2
    docs = {i: w for i, w in (docs | changed).items() if i not in (top, 7)}
    assert found(path, 5) == best(5)
    back = {top: ["w2"]}
    inverted.add_segment(terms(back, "doc_id"), path, "doc_id")
    docs |= back
    assert found(path, 5) == best(5)
    assert inverted.merge_segments(spark, path, str(tmp_path / "j")) == 1 and found(str(tmp_path / "j"), 5) == best(5)
    # a common term does not make all rows be scored: the blocks of short rows stay unread
    seen = []
    real = inverted.ranked
    monkeypatch.setattr(inverted, "ranked", lambda hits, *a, **b: (seen.append(hits), real(hits, *a, **b))[1])
    found(str(tmp_path / "j"), 3)
    assert seen[-1].where("query_id = 0").count() < len(docs) / 2


def test_index_of_hard_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 1.0), (None, "a", 1.0), (2, "a", 1.0), (3, "a", 1.0)], "doc_id long, term string, weight double")
    path = str(tmp_path / "i")
    asked = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0)], "query_id long, term string, weight double")
    assert inverted.top_k(spark, path, asked, 3).collect() == []
    inverted.add_segment(rows.limit(0), path, "doc_id")
    assert inverted.top_k(spark, path, asked, 3).collect() == []
    inverted.add_segment(rows, path, "doc_id")
    assert [(r.doc_id, r.rank) for r in inverted.top_k(spark, path, asked, 3).orderBy("rank").collect()] == [(2, 1), (3, 2)]
    assert inverted.top_k(spark, path, asked.limit(0), 3).collect() == []


def test_postings_are_dealt_out_once(spark, tmp_path, monkeypatch):
    """No posting is checkpointed; buckets written in several slices hold what a scan finds."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 7))).alias("term"), (1 + F.col("id") % 5).cast("double").alias("weight"))
    seen = []
    real = inverted.cut
    monkeypatch.setattr(inverted, "cut", lambda df: (seen.append(df.columns), real(df))[1])
    monkeypatch.setattr(inverted, "BLOCK", 16)
    monkeypatch.setattr(inverted, "SLICE", 2, raising=False)
    inverted.add_segment(docs, str(tmp_path / "i"), "doc_id", gone=spark.range(0, 600, 50).select(F.col("id").alias("doc_id")))
    assert not [c for c in seen if "term" in c]
    asked = spark.createDataFrame([(1, "the", 1.0), (1, "w3", 2.0), (2, "w5", 1.0)], "query_id long, term string, weight double")
    got = [tuple(r) for r in inverted.top_k(spark, str(tmp_path / "i"), asked, 5).orderBy("query_id", "rank").collect()]
    live = [i for i in range(600) if i % 50]
    score = {1: {i: (1 + i % 5) * (3.0 if i % 7 == 3 else 1.0) for i in live}, 2: {i: 1.0 + i % 5 for i in live if i % 7 == 5}}
    assert got == [(q, i, x, n) for q, m in score.items() for n, (i, x) in enumerate(sorted(m.items(), key=lambda r: (-r[1], r[0]))[:5], 1)]


def test_vector_search_takes_any_number_of_queries(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    frame = lambda d, key: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(d)], f"{key} long, embedding array<double>")
    data, asked = rng.normal(size=(60, 4)), rng.normal(size=(8, 4))
    rows, root = frame(data, "chunk_id"), str(tmp_path / "s")
    centre = vector_store.centres(rows, 6)
    vector_store.save(spark, root, "v1", rows.select("chunk_id"), rows, centre, chunk_cells=2)
    monkeypatch.setattr(vector_store, "MOST_QUERIES", 3)
    got = {(r.query_id, r.rank): r.chunk_id for r in vector_store.search(spark, root, "chunk_id bigint, embedding array<double>", centre, frame(asked, "query_id"), 3).collect()}
    scores = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (data / np.linalg.norm(data, axis=1)[:, None]).T
    assert got == {(i, j + 1): int(c) for i in range(8) for j, c in enumerate(np.argsort(-scores[i])[:3])}
