"""Continuous capture of pages and continuous job states, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def capture(pages: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("run_id", "page_id")) -> StreamingQuery:
    """Append each page once to the Parquet table ``target``: a key that is there already is left as it is.

    Batches that are run again after a failure add nothing twice. The query takes all there is and stops.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        new = batch.dropDuplicates(list(keys))
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.schema(batch.schema).parquet(target).select(*keys), list(keys), "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(target)

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a crawl tells of a page, in the order in which events of one time are taken: it is in the inventory, its answer has
#: come, the answer is stored.
KINDS = ("inventory", "page", "stored")
DECISIONS = "run_id string, page_id string, at timestamp, decision string, source_version string, http_status int, sha256 string"
#: Pages are dealt into so many groups, as Spark's work for each group in Python costs far more than that for a page.
BUCKETS = 4096
_EVENT = ("run_id", "page_id", "us", "kind", "source_version", "http_status", "sha256")
_MADE = DECISIONS.replace("at timestamp", "us bigint")
_STATE = "run array<string>, page array<string>, versions array<string>, version array<string>, status array<int>, sha array<string>, stored array<boolean>, since array<bigint>, due array<bigint>"
#: Rows of a frame that is given back.
_ROWS = 10_000


def page_decisions(events: DataFrame, patience: str = "1 hour", late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """A stream (run_id, page_id, at, kind, source_version, http_status, sha256) -> what becomes of each answer.

    ``committed``: the first answer of a page in the inventory, of the version that stands there; ``replayed``: the same
    again; ``conflict``: another one after it; ``identity_conflict``: of another version, or the inventory has two;
    ``unknown_inventory``: the page is not there yet. ``stored`` answers ``acknowledged``, or ``not_committed`` if there is
    nothing, or something else, to store. A page that is in the inventory without a committed answer when the watermark,
    ``late`` behind the newest event, has passed ``patience``, is ``overdue``, once. Events without a run, page or time are
    left out; those of other kinds say nothing.

    What is kept of a page is a few numbers and hashes, and goes when it was acknowledged for as long as ``patience``. Pages
    are kept in ``buckets`` groups by a hash of run and page, each read and written whole when one of its pages has an event;
    the number must stay the same for as long as a checkpoint is used.
    """
    wait = pd.Timedelta(patience).value // 1_000_000

    def decide(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(run, page): rest for run, page, *rest in zip(*state.get, strict=True)} if state.exists else {}
        now, out = state.getCurrentWatermarkMs(), []
        told: dict[tuple, list[tuple]] = {}
        if not state.hasTimedOut:
            for f in frames:
                for run, page, *r in zip(*(f[c].tolist() for c in _EVENT), strict=True):
                    told.setdefault((run, page), []).append(r)
        # a page with events has its timer set anew by them
        for page in [p for p, x in held.items() if x[-1] is not None and x[-1] < now and p not in told]:
            versions, _, _, sha, stored, since, _ = held[page]
            if sha is None and since is not None:
                out.append((*page, (since + wait) * 1000, "overdue", versions or None, None, None))
                held[page] = [versions, None, None, None, False, None, None]
            elif stored:
                del held[page]
        for page, rows in told.items():
            said, held[page] = _decided(rows, held.get(page, ("", None, None, None, False, None, None)), wait, now)
            out += [(*page, *r) for r in said]
        if held:
            state.update(tuple(zip(*((*page, *x) for page, x in held.items()), strict=True)))
            timers = [x[-1] for x in held.values() if x[-1] is not None]
            if timers:
                state.setTimeoutTimestamp(max(min(timers), now + 1))
        elif state.exists:
            state.remove()
        for i in range(0, len(out), _ROWS):
            yield _frame(out[i : i + _ROWS])

    known = events.where("run_id IS NOT NULL AND page_id IS NOT NULL AND at IS NOT NULL").select(
        F.col("run_id").cast("string"), F.col("page_id").cast("string"), F.col("at").cast("timestamp"), "kind", F.col("source_version").cast("string"), F.col("http_status").cast("int"), "sha256"
    )
    dealt = known.withColumn("us", F.unix_micros("at")).withColumn("bucket", F.pmod(F.xxhash64("run_id", "page_id"), F.lit(buckets)))
    made = dealt.withWatermark("at", late).groupBy("bucket").applyInPandasWithState(decide, _MADE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(*[F.timestamp_micros("us").alias("at") if c.split()[0] == "at" else c.split()[0] for c in DECISIONS.split(", ")])


def _decided(rows: list[tuple], before: Sequence, wait: int, now: int) -> tuple[list[tuple], tuple]:
    """Events (us, kind, source_version, http_status, sha256) of a page -> what is said of them, and what is kept of the page:
    versions, the committed version, status and hash, whether it is stored, since when it is waited for, when its timer ends."""
    versions, version, status, sha, stored, since, _ = before
    out = []
    if len(rows) > 1:
        rows.sort(key=lambda r: (r[0], KINDS.index(r[1]) if r[1] in KINDS else len(KINDS), str(r[4])))
    for at, kind, of, code, body in rows:
        answer = of, None if code is None or code != code else int(code), body
        if kind == "inventory" and of is not None:
            # two versions contradict each other for good; a bar stands for that
            versions = of if versions in ("", of) else "|"
            since = at // 1000 if sha is None and since is None else since
        elif kind == "page":
            if not versions:
                said = "unknown_inventory"
            elif versions != of:
                said = "identity_conflict"
            elif sha is None:
                said, (version, status, sha) = "committed", answer
            else:
                said = "replayed" if answer == (version, status, sha) else "conflict"
            out.append((at, said, *answer))
        elif kind == "stored":
            same = sha is not None and body == sha
            stored = stored or same
            out.append((at, "acknowledged" if same else "not_committed", *answer))
    due = None
    if stored or sha is None and since is not None:
        due = max((rows[-1][0] // 1000 if stored else since) + wait, now + 1)
    return out, (versions, version, status, sha, stored, since, due)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Each column is made in its own type."""
    run, page, at, said, version, status, sha = zip(*rows, strict=True)
    text = {"run_id": run, "page_id": page, "decision": said, "source_version": version, "sha256": sha}
    made = {k: np.array(v, object) for k, v in text.items()} | {"us": np.array(at, np.int64), "http_status": pd.array(status, "Int32")}
    return pd.DataFrame({c.split()[0]: made[c.split()[0]] for c in _MADE.split(", ")}, copy=False)


def window_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events per kind and window of time; those later than ``late`` behind the newest one are not waited for."""
    return events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), kind).count().select(F.col("w.start").alias("start"), kind, "count")


def first_submissions(requests: DataFrame, key: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Requests without those whose key came before, within the time that is looked back."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
