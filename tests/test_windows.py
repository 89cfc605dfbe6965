"""The paginated source, stopped and resumed, and the decisions on answers, kept between batches."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import windows
from tessera.streaming import capture


def put(root, name: str, start: int, limit: int, size: int, total: int, **more) -> None:
    folder = root / f"root={name}" / f"start={start}"
    folder.mkdir(parents=True)
    body = {"start": start, "limit": limit, "size": size, "totalSize": total, "results": [{"content": {"id": f"{name}{start + i}"}} for i in range(size)]} | more
    (folder / "part-0.txt").write_text(json.dumps(body))


def test_windows_are_followed_across_stops(spark, tmp_path):
    for name, sizes in {"a": [2, 2, 1], "b": [1], "c": [2, 2]}.items():
        start = 0
        for n in sizes:
            put(tmp_path / "in", name, start, 2, n, sum(sizes))
            start += n
    (tmp_path / "in" / "root=c" / "start=2").rename(tmp_path / "late")
    args = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cursor")
    got = lambda: sorted(r.page_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert windows.follow_windows(*args, per_batch=2, stop_after=1) == 1 and got() == ["a0", "a1", "a2", "a3"]
    assert windows.follow_windows(*args, per_batch=2) == 2 and got() == ["a0", "a1", "a2", "a3", "a4", "b0", "c0", "c1"]
    assert windows.follow_windows(*args) == 0
    (tmp_path / "late").rename(tmp_path / "in" / "root=c" / "start=2")  # the window that was waited for
    assert windows.follow_windows(*args) == 1 and len(got()) == 10
    rows = windows.read_windows(spark, str(tmp_path / "in"))
    assert sorted(r.page_id for r in rows.collect()) == got() and windows.window_gaps(rows).count() == 0
    last = {r.root: r.start for r in rows.where("terminal").collect()}
    assert last == {"a": 4, "b": 0, "c": 2}


def test_gaps(spark, tmp_path):
    for name, parts in {"a": [(0, 2), (4, 2)], "b": [(0, 2)], "c": [(0, 4), (4, 2)]}.items():
        for start, n in parts:
            put(tmp_path, name, start, 4, n, 4 if name == "c" and start == 0 else 6)
    assert {(r.root, r.start, r.fault) for r in windows.window_gaps(windows.read_windows(spark, str(tmp_path))).collect()} == {("a", 4, "gap"), ("b", 0, "no_last"), ("c", 4, "behind_last")}


@pytest.mark.parametrize(("change", "fault"), [
    ({"start": 1}, "start"), ({"limit": 0}, "limit"), ({"size": 1}, "size"), ({"limit": 1}, "size"), ({"totalSize": 1}, "total"), ({"size": 0, "results": []}, "advance"), ({"size": "2"}, "malformed"), ({"results": None}, "malformed"), ({"totalSize": True}, "malformed"),
])
def test_windows_that_contradict_themselves(change, fault):
    good = {"start": 0, "limit": 2, "size": 2, "totalSize": 2, "results": [1, 2]}
    assert windows.checked(good, "r", 0)["next_start"] is None and windows.checked(good | {"totalSize": 3}, "r", 0)["next_start"] == 2
    assert windows.checked(good | {"size": 0, "results": [], "totalSize": 0}, "r", 0)["next_start"] is None
    with pytest.raises(ValueError, match=fault):
        windows.checked(good | change, "r", 0)


def test_written_windows_are_read_again(spark, tmp_path):
    pages = spark.range(23).select((F.col("id") % 2).alias("root"), F.col("id").alias("page_id"), F.lit(None).cast("string").alias("title"), F.lit("S").alias("space_key"), F.lit(3).alias("source_version"), F.array(F.col("id") + 1).alias("ancestor_ids"))
    windows.write_windows(pages, str(tmp_path / "w"), 5)
    got = {(r.root, r.start + r.ordinal, r.page_id, r.title, r.space_key, r.source_version, tuple(r.ancestor_ids)) for r in windows.read_windows(spark, str(tmp_path / "w")).collect()}
    assert got == {(str(i % 2), i // 2, str(i), None, "S", "3", (str(i + 1),)) for i in range(23)}


SCHEMA = "run_id string, page_id string, at timestamp, kind string, source_version string, http_status int, sha256 string"


def minute(m: float) -> dt.datetime:
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)


def push(spark, tmp_path, rows: list[tuple], **options) -> list[tuple]:
    """One more batch; all decisions so far."""
    spark.createDataFrame([("r", p, minute(m), *rest) for p, m, *rest in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = capture.page_decisions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), **options)
    made.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(path=str(tmp_path / "out"), format="parquet").awaitTermination()
    return [(r.page_id, r.decision) for r in spark.read.schema(capture.DECISIONS).parquet(str(tmp_path / "out")).orderBy("at", "page_id", "decision").collect()]


def test_replays_conflicts_and_the_timer(spark, tmp_path):
    more = {"patience": "1 hour", "late": "1 minute"}
    assert push(spark, tmp_path, [("p", 0, "inventory", "1", None, None), ("q", 0, "inventory", "1", None, None), ("o", 0, "odd", "1", None, None)], **more) == []
    assert push(spark, tmp_path, [("p", 1, "page", "1", 200, "a"), ("z", 1, "page", "1", 200, "a")], **more) == [("p", "committed"), ("z", "unknown_inventory")]
    out = push(spark, tmp_path, [("p", 2, "page", "1", 200, "a"), ("p", 3, "page", "1", 200, "b"), ("p", 3.5, "page", "2", 200, "b"), ("p", 4, "stored", "1", 200, "a"), ("q", 4, "stored", "1", 200, "a")], **more)
    assert out[2:] == [("p", "replayed"), ("p", "conflict"), ("p", "identity_conflict"), ("p", "acknowledged"), ("q", "not_committed")]
    out = push(spark, tmp_path, [("n", 200, "inventory", "1", None, None)], **more)
    assert out[7:] == [("q", "overdue")]  # and nothing on p, which is stored
    assert push(spark, tmp_path, [("n", 201, "page", "1", 200, "c"), ("n", 202, "inventory", "2", None, None), ("n", 203, "page", "1", 200, "c")], **more)[8:] == [("n", "committed"), ("n", "identity_conflict")]


def test_decisions_do_not_depend_on_batches(spark, tmp_path):
    """Random events in one batch, and the same in four, against a plain loop."""
    rng = random.Random(5)
    rows = sorted([(f"p{rng.randint(0, 6)}", m, rng.choice(["inventory", "page", "page", "page", "stored"]), str(rng.choice([1, 1, 1, 2])), 200, rng.choice("ab")) for m in range(120)], key=lambda r: r[1])
    versions, held, want = {}, {}, []
    for p, _, kind, version, status, sha in rows:
        if kind == "inventory":
            versions.setdefault(p, set()).add(version)
        elif kind == "stored":
            want.append((p, "acknowledged" if p in held and held[p][2] == sha else "not_committed"))
        elif p not in versions:
            want.append((p, "unknown_inventory"))
        elif versions[p] != {version}:
            want.append((p, "identity_conflict"))
        else:
            want.append((p, "committed" if p not in held else "replayed" if held[p] == (version, status, sha) else "conflict"))
            held.setdefault(p, (version, status, sha))
    more = {"patience": "10 days", "late": "10 days"}
    assert push(spark, tmp_path / "one", rows, **more) == want
    for i in range(0, 120, 30):
        out = push(spark, tmp_path / "four", rows[i : i + 30], **more)
    assert out == want


def test_pages_share_a_group_but_no_timer(spark, tmp_path):
    """Random events with timers that end between batches: all pages in one group, and nearly each in its own."""
    rng = random.Random(6)
    parts = [[(f"p{rng.randint(0, 15)}", 100 * i + m, rng.choice(["inventory", "inventory", "page", "stored"]), "1", rng.choice([200, None]), rng.choice("ab")) for m in range(0, 60, 2)] for i in range(4)]
    made = {}
    for buckets in (1, 4096):
        for part in parts:
            made[buckets] = push(spark, tmp_path / str(buckets), part, patience="90 minutes", late="1 minute", buckets=buckets)
    assert made[1] == made[4096] and {"overdue", "committed", "acknowledged", "conflict"} <= {said for _, said in made[1]}
    state = spark.read.format("statestore").load(str(tmp_path / "1" / "c"))
    assert state.count() == 1


def test_many_windows_are_few_tasks_of_one_stream(spark, tmp_path):
    for i in range(60):
        put(tmp_path / "in", "a", i, 1, 1, 60)
    args = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cursor")
    assert windows.follow_windows(*args, per_batch=50) == 2
    assert spark.read.parquet(str(tmp_path / "out")).select("start").distinct().count() == 60
    assert len(list((tmp_path / "out").glob("part-*"))) == 3
