"""A delta run, a set of pages with faults, and versions whose digests are checked: each against a plain version or a planted fault."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions.canonical import streams_digest
from tessera.operators import delta, delta_run, page_set
from tessera.operators.chunking import Budget
from tessera.plans import delta_plans
from tessera.sources import files


def test_the_delta_over_its_base_is_the_new_version(spark, sf, tmp_path):
    """Laid over the old version in memory, and published and read again."""
    previous, current, inventory = delta_plans.versions(spark, sf)
    previous = {s: x.cache() for s, x in previous.items()}
    current = {s: x.select(*previous[s].columns).cache() for s, x in current.items()}
    change = delta_run.run_delta(previous, current, inventory, "v2", "now")
    made = delta_run.applied(previous, change)
    for s in delta_run.KEYS:
        assert delta.differences(made[s], current[s]).count() == 0, s
    sparse = {s: x.count() for s, x in change.streams.items()}
    assert 0 < sparse["chunks"] < current["chunks"].count() / 2 and sparse["acl"] < current["acl"].count() / 2
    none = spark.createDataFrame([], change.tombstones.schema)
    files.write_version(previous | {"tombstones": none}, str(tmp_path / "v"), "v1", {"export_mode": "full_snapshot"})
    files.write_delta(change.published(), str(tmp_path / "v"), "v2", "v1", {})
    read, manifest = files.read_version(spark, str(tmp_path / "v"))
    assert manifest["base_dataset_version"] == "v1"
    for s in ("documents", "chunks", "relations"):
        assert delta.differences(read[s].select(*current[s].columns), current[s]).count() == 0
    n = {r.metric: r.n for r in delta_run.metrics(change).collect()}
    assert n["rows_chunks"] == sparse["chunks"] and sum(v for k, v in n.items() if k.startswith("documents_")) == change.outcomes.count()
    # nothing changed: nothing to publish
    same = delta_run.run_delta(current, current, inventory.limit(0), "v3", "now")
    assert same.tombstones.count() == 0 and {r.outcome for r in same.outcomes.collect()} == {"unchanged"} and all(x.count() == 0 for x in same.streams.values())


def small(spark, docs: dict[str, str], chunks: list[tuple], acl: list[tuple] = (), media: list[tuple] = ()) -> dict:
    f = spark.createDataFrame
    return {
        "documents": f([(d, h, "confluence", None, None, "1", None) for d, h in docs.items()], "document_id string, content_hash string, source_system string, repo string, branch string, source_version string, file_path string"),
        "chunks": f(list(chunks), "chunk_id string, document_id string, content_hash string"), "acl": f(list(acl), "acl_id string, document_id string, tag string"),
        "media_assets": f(list(media), "media_id string, parent_document_id string"), "symbols": f([], "symbol_id string, chunk_id string, repo string, branch string, commit_hash string, file_path string"),
        "relations": f([], "relation_id string, source_id string, target_id string, resolution_status string"),
    }


INVENTORY = "document_id string, state string, source_version_last_seen string, detail string"


def test_reasons_and_configuration(spark):
    old = small(spark, {"a": "1", "b": "1", "c": "1"}, [("a1", "a", "x"), ("a2", "a", "x"), ("b1", "b", "x"), ("c1", "c", "x")], [("acl:a", "a", "t")], [("m", "b")])
    new = small(spark, {"a": "2", "b": "1", "d": "1"}, [("a1", "a", "y"), ("b1", "b", "x"), ("d1", "d", "x")], [("acl:a", "a", "u")])
    seen = spark.createDataFrame([("c", "access_revoked", "4", "probe")], INVENTORY)
    change = delta_run.run_delta(old, new, seen, "v", "now")
    assert {(r.document_id, r.outcome, tuple(r.reasons)) for r in change.outcomes.collect()} == {
        ("a", "changed", ("content_updated", "access_changed")), ("b", "changed", ("dependents_changed",)), ("c", "removed", ("access_revoked",)), ("d", "new", ())}
    assert {(r.entity_id, r.reason, r.detail) for r in change.tombstones.collect()} == {
        ("a1", "content_updated", None), ("a2", "content_updated", None), ("m", "content_updated", None), ("c", "access_revoked", "probe"), ("c1", "access_revoked", None)}
    again = delta_run.run_delta(old, new, seen, "v", "now", config_changed=True)
    assert {(r.document_id, r.reasons[0]) for r in again.outcomes.collect() if r.outcome == "changed"} == {("a", "config_invalidated"), ("b", "config_invalidated")}
    assert {(r.entity_id, r.reason) for r in again.tombstones.collect()} >= {("a", "config_invalidated"), ("b1", "config_invalidated"), ("m", "config_invalidated"), ("c", "access_revoked")}
    for run in (change, again):
        made = delta_run.applied(old, run)
        assert all(delta.differences(made[s], new[s]).count() == 0 for s in delta_run.KEYS)


@pytest.mark.parametrize(("rows", "check"), [
    ([("c", "present", "1", None)], "document_is_gone_but_present"), ([], "document_is_gone_without_a_reason"), ([("c", "vanished", "1", None)], "state_unknown"), ([("c", "source_deleted", "1", None), ("c", "source_deleted", "2", None)], "inventory_contradicts_itself"),
    ([("c", "source_deleted", "1", None), ("zz", "present", "1", None)], "inventory_names_unknown_document"), ([("c", "source_deleted", "1", None), ("a", "access_revoked", "1", None)], "document_is_there_but_not_present"),
])
def test_an_inventory_that_contradicts_stops_the_run(spark, rows, check):
    old, new = small(spark, {"a": "1", "c": "1"}, []), small(spark, {"a": "1"}, [])
    inventory = spark.createDataFrame(rows, INVENTORY)
    assert [r.check for r in delta_run.inventory_conflicts(old["documents"], new["documents"], inventory).collect()] == [check]
    with pytest.raises(ValueError):
        delta_run.run_delta(old, new, inventory, "v", "now")
    assert delta_run.inventory_conflicts(old["documents"], new["documents"], inventory.limit(0), required=False).count() == 0


def body(**change) -> str:
    page = {"id": "1", "type": "page", "title": "T", "space": {"key": "S"}, "version": {"number": 2, "when": "w"}, "body": {"storage": {"value": "<h2>A</h2><p>text</p><ac:image alt='i'/>", "representation": "storage"}}}
    return json.dumps(page | change)


def storage(value: str) -> dict:
    return {"body": {"storage": {"value": value, "representation": "storage"}}}


def test_pages_that_fail_are_set_aside(spark):
    rows = {
        "1": (200, "2", "2", body()), "2": (404, "2", None, body(id="2")), "3": (200, "2", "3", body(id="3")), "4": (200, "2", None, None), "5": (200, "2", None, body(id="6")), "6": (200, "3", None, body(id="6")), "7": (200, "2", None, "x"),
        "8": (200, "2", None, body(id="8", **storage("<p>"))), "9": (200, "2", None, body(id="9", **storage("<h1/>"))), "10": (200, "2", None, body(id="10", **storage(f"<pre>{'x ' * 2000}y</pre>"))), "11": (200, "2", None, body(id="11", **storage(""))),
    }
    given = [(p, *r) for p, r in rows.items()] + [("12", 200, "2", None, body(id="12"))] * 2 + [(None, 200, "2", None, body())]
    pages = spark.createDataFrame(given, "page_id string, http_status int, source_version string, expected_source_version string, body string").withColumn("fault", F.lit(1))
    done = page_set.process(pages, Budget()).cache()
    assert {(r.page_id, r.stage, r.category, r.detail) for r in page_set.faults(done).collect()} == {
        ("2", "raw_page", "raw_page_status_failed", None), ("3", "raw_page", "source_version_mismatch", None), ("4", "raw_page", "raw_page_read_failed", None), ("5", "document", "document_identity_mismatch", None),
        ("6", "document", "source_version_mismatch", None), ("7", "normalization", "normalization_failed", "payload"), ("8", "normalization", "normalization_failed", "storage XHTML is malformed"),
        ("9", "structure", "structure_failed", "empty_structural_heading"), ("10", "chunking", "chunking_failed", "unsplittable_code_line"), ("12", "raw_page", "invalid_request", None), (None, "raw_page", "invalid_request", None),
    }
    docs = {r.document_id: r for r in page_set.documents(done).collect()}
    assert set(docs) == {"confluence:page:1", "confluence:page:11"} and docs["confluence:page:1"].text == "## A\n\ntext\n\n[media: i]" and docs["confluence:page:1"].references[0].identity == "i"
    chunks = page_set.chunks(done).collect()
    assert [(c.document_id, c.text) for c in chunks] == [("confluence:page:1", "T › A\n\ntext\n\n[media: i]")]
    m = page_set.metrics(done).first()
    assert (m.requested, m.succeeded, m.failed, m.chunks, m.warnings, m.references, m.prose_chunks, m.table_chunks) == (14, 2, 12, 1, 0, 1, 1, 0)
    assert page_set.process(pages.limit(0)).collect() == []


def test_a_version_that_was_tampered_with_is_refused(spark, tmp_path):
    root = str(tmp_path / "v")
    streams = {"documents": spark.createDataFrame([("a", "x"), ("b", None)], "document_id string, text string"), "chunks": spark.range(3).withColumnRenamed("id", "chunk_id")}
    files.write_version(streams, root, "v1", {"export_mode": "full_snapshot"})
    read, manifest = files.read_version(spark, root)
    assert manifest["digest"] == streams_digest(read).first().digest and set(manifest["digests"]) == set(streams)
    spark.createDataFrame([("a", "y"), ("b", None)], "document_id string, text string").write.mode("overwrite").parquet(f"{root}/v1/documents")
    with pytest.raises(ValueError, match="documents"):
        files.read_version(spark, root)
    assert files.read_version(spark, root, verify="counts")[0]["documents"].count() == 2
    part = next(Path(root, "v1", "manifest").glob("part-*"))
    changed = json.loads(part.read_text())
    changed["digests"]["documents"] = "0" * 64
    for crc in Path(root, "v1", "manifest").glob(".*.crc"):
        crc.unlink()
    part.write_text(json.dumps(changed))
    with pytest.raises(ValueError, match="manifest"):
        files.read_version(spark, root)


def test_a_planted_change_is_found_in_any_stream(spark, sf):
    """The run twice gives the same digests; with one field of one row changed, or one row twice, that stream's differs."""
    previous, _, _ = delta_plans.versions(spark, sf)
    twice, _, _ = delta_plans.versions(spark, sf)
    first = streams_digest(previous).first().digest
    assert streams_digest({s: x.repartition(7) for s, x in twice.items()}).first().digest == first
    for s, (key, _) in delta_run.KEYS.items():
        least = previous[s].agg(F.min(key)).first()[0]
        column = next(c for c in previous[s].columns if c != key and dict(previous[s].dtypes)[c] == "string")
        for bad in (previous[s].withColumn(column, F.when(F.col(key) == least, "planted").otherwise(F.col(column))), previous[s].unionByName(previous[s].where(F.col(key) == least))):
            assert streams_digest(previous | {s: bad}).first().digest != first


def test_a_delta_makes_what_is_asked_for(spark, monkeypatch):
    """Outcomes need neither tombstones nor streams, tombstones no streams."""
    old = small(spark, {"a": "1", "b": "1"}, [("a1", "a", "x"), ("b1", "b", "x")])
    new = small(spark, {"a": "2"}, [("a1", "a", "y")])
    seen = spark.createDataFrame([("b", "source_deleted", "1", "x")], INVENTORY)
    monkeypatch.setattr(delta_run, "_differing", lambda *_: pytest.fail("streams were made"))
    change = delta_run.run_delta(old, new, seen, "v", "now")
    assert {(r.document_id, r.outcome) for r in change.outcomes.collect()} == {("a", "changed"), ("b", "removed")}
    assert {(r.entity_type, r.entity_id) for r in change.tombstones.collect()} == {("document", "b"), ("chunk", "b1"), ("chunk", "a1")}


def test_dependents_of_two_versions_are_found_once(spark, sf, monkeypatch):
    """For outcomes and tombstones together; they are what the two versions' own dependents tell."""
    previous, current, inventory = delta_plans.versions(spark, sf)
    rows = lambda x: {tuple(r) for r in x.select("document_id", "entity_type", "entity_id").collect()}
    old, new = rows(delta.dependents(previous)), rows(delta.dependents(current))
    calls, made = [], delta._owned
    monkeypatch.setattr(delta, "_owned", lambda *x: calls.append(1) or made(*x))
    change = delta_run.run_delta(previous, current, inventory, "v", "now")
    assert change.outcomes.count() and change.tombstones.count() and len(calls) == 1
    assert rows(change.parts.where("before AND NOT after")) == old - new and rows(change.parts.where("after AND NOT before")) == new - old
    whole = delta.dependents_changes(previous, current, whole=True)
    assert rows(whole.where("before")) == old and rows(whole.where("after")) == new


def test_symbols_of_no_chunk_do_not_meet(spark):
    """They are dealt out, and find their file; a document that two relations name has each once."""
    streams = small(spark, {"a": "1"}, [("a1", "a", "x")])
    streams["documents"] = spark.createDataFrame([("a", "git", "r", "b", "1", "f")], "document_id string, source_system string, repo string, branch string, source_version string, file_path string")
    streams["symbols"] = spark.createDataFrame([(f"s{i}", "a1" if i % 2 else None, "r", "b", "1" if i < 50 else "2", "f") for i in range(100)], streams["symbols"].schema)
    streams["relations"] = spark.createDataFrame([("r1", "a1", "a", "resolved"), ("r2", "a", "z", "resolved")], streams["relations"].schema)
    want = {("a", "symbol", f"s{i}") for i in range(100) if i % 2 or i < 50} | {("a", "relation", "r1"), ("a", "relation", "r2")}
    made = [tuple(r) for r in delta.dependents(streams).collect()]
    assert len(made) == len(want) and set(made) == want
