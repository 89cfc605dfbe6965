"""Windows of a wiki's inventory as a Spark source, batch and stream: one partition per window, the cursor as offset.

A crawl leaves each answer in a folder of its own, ``root=<page>/start=<number>``, one JSON text. A stream follows each root
from window to window: the next one begins where the last one ended, until one reaches the total. A window that is not there yet
is waited for; where a stream was stopped, the next one goes on, as Spark keeps the cursor in its checkpoint.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from tessera.functions.checkpoints import spread
from tessera.sources.files import _path

SCHEMA = "root string, start bigint, ordinal int, page_id string, title string, space_key string, source_version string, ancestor_ids array<string>, next_start bigint, terminal boolean"
NAME = "wiki_windows"


#: Windows that a task reads, one after the other: one each would be a task and a file for every few rows.
PER_TASK = 25


@dataclass
class SomeWindows(InputPartition):
    windows: list[tuple[str, int]]


def _dealt(windows: list[tuple[str, int]]) -> list[SomeWindows]:
    return [SomeWindows(list(x)) for x in batched(windows, PER_TASK)]


class Folder:
    """The windows under a path of any file system that pyarrow reads; a plain path is a shared folder."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)

    def roots(self) -> list[str]:
        return sorted(m[1] for x in self._names(self.path) if (m := re.fullmatch(r"root=(.+)", x)))

    def starts(self, root: str) -> list[int]:
        return sorted(int(m[1]) for x in self._names(f"{self.path}/root={root}") if (m := re.fullmatch(r"start=(\d+)", x)))

    def _names(self, path: str) -> list[str]:
        from pyarrow import fs

        return [x.base_name for x in self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True))]

    def window(self, root: str, start: int) -> dict | None:
        """The window, checked; None if it is not there."""
        from pyarrow import fs

        found = [x for x in self.fs.get_file_info(fs.FileSelector(f"{self.path}/root={root}/start={start}", allow_not_found=True)) if x.is_file and x.size and x.base_name[0] not in "._"]
        if not found:
            return None
        if len(found) > 1:
            raise ValueError(f"window {root}/{start} has {len(found)} files")
        with self.fs.open_input_file(found[0].path) as f:
            return checked(json.loads(f.read()), root, start)


def checked(body: dict, root: str, start: int) -> dict:
    """A window whose numbers agree: it begins where it should, holds as many results as it says and no more than its limit,
    lies within the total, and goes on unless it is the last. ``next_start`` is None for the last one."""
    numbers = [body.get(k) for k in ("start", "limit", "size", "totalSize")]
    if any(type(n) is not int for n in numbers) or not isinstance(body.get("results"), list):
        raise ValueError(f"window {root}/{start} is malformed")
    at, limit, size, total = numbers
    faults = {"start": at != start, "limit": limit <= 0, "size": not size == len(body["results"]) <= limit, "total": total < at + size, "advance": at < total and size == 0}
    if any(faults.values()):
        raise ValueError(f"window {root}/{start} contradicts itself: {[k for k, bad in faults.items() if bad]}")
    return body | {"next_start": None if at + size >= total else at + size}


def rows_of(window: dict, root: str) -> Iterator[tuple]:
    for i, r in enumerate(window["results"]):
        c = r["content"]
        above = [str(a["id"]) for a in c.get("ancestors") or ()]
        version = (c.get("version") or {}).get("number")
        yield root, window["start"], i, str(c["id"]), c.get("title"), (c.get("space") or {}).get("key"), None if version is None else str(version), above, window["next_start"], window["next_start"] is None


class _Reader:
    def __init__(self, path: str):
        self.path = path

    def read(self, part: SomeWindows) -> Iterator[tuple]:
        folder = Folder(self.path)
        for root, start in part.windows:
            window = folder.window(root, start)
            if window is None:
                raise ValueError(f"window {root}/{start} is gone")
            yield from rows_of(window, root)


class WindowReader(_Reader, DataSourceReader):
    def partitions(self) -> list[SomeWindows]:
        folder = Folder(self.path)
        return _dealt([(root, start) for root in folder.roots() for start in folder.starts(root)])


class WindowStream(_Reader, DataSourceStreamReader):
    """Offsets are {root: where its next window begins, or -1 behind the last one}. A batch takes at most ``most`` windows."""

    def __init__(self, path: str, most: int):
        super().__init__(path)
        self.most = most
        self.at: dict[str, int] = {}
        self.followed: dict[tuple[str, int], int] = {}  # where windows that were looked at for the next batch lead to

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # the engine asks for the end of the next batch; it goes on from the end of the last one that was planned, which
        # after a restart is the one that the engine plans (again, or as empty) before it asks
        self.at, _ = self._follow(self.at, None, self.most)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[SomeWindows]:
        self.at = {**end}
        taken = self._follow(start, end, None)[1]
        self.followed = {w: self.followed[w] for w in taken}
        return _dealt(taken)

    def _follow(self, at: dict[str, int], end: dict[str, int] | None, most: int | None) -> tuple[dict[str, int], list[tuple[str, int]]]:
        """From a cursor along the windows, root by root, up to another cursor or as many windows as allowed."""
        folder, out, taken = Folder(self.path), dict(at), []
        for root in sorted(end) if end is not None else folder.roots():
            cursor = out.get(root, 0)
            while cursor >= 0 and (most is None or len(taken) < most) and (end is None or cursor != end[root]):
                if (root, cursor) not in self.followed:
                    window = folder.window(root, cursor)
                    if window is None:
                        break
                    self.followed[root, cursor] = -1 if window["next_start"] is None else window["next_start"]
                taken.append((root, cursor))
                cursor = self.followed[root, cursor]
            if cursor or root in at:
                out[root] = cursor
        return out, taken


class InventoryWindows(DataSource):
    """``spark.read.format("wiki_windows").load(path)``; a stream takes ``windowsPerBatch`` (100) windows at a time."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WindowReader:
        return WindowReader(self.options["path"])

    def streamReader(self, schema) -> WindowStream:
        return WindowStream(self.options["path"], int(self.options.get("windowsPerBatch", 100)))


def write_windows(occurrences: DataFrame, path: str, limit: int = 50) -> None:
    """(root, page_id, title, space_key, source_version, ancestor_ids) -> windows of ``limit`` pages, in order of page ids."""
    order = Window.partitionBy("root").orderBy("page_id")
    placed = occurrences.withColumn("place", F.row_number().over(order) - 1)
    total = occurrences.groupBy("root").agg(F.count("*").cast("int").alias("totalSize"))
    content = F.struct(
        F.col("page_id").cast("string").alias("id"), "title", F.struct(F.col("space_key").alias("key")).alias("space"), F.struct(F.col("source_version").cast("int").alias("number")).alias("version"),
        F.transform("ancestor_ids", lambda a: F.struct(a.cast("string").alias("id"))).alias("ancestors"),
    )
    start = (F.col("place") - F.col("place") % limit).alias("start")
    windows = placed.groupBy("root", start).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(content.alias("content")).alias("r")))), lambda x: x.r).alias("results")).join(total, "root")
    body = F.to_json(F.struct("start", F.lit(limit).alias("limit"), F.size("results").alias("size"), "totalSize", "results"))
    spread(windows.select("root", "start", body.alias("value")), "root", "start").write.partitionBy("root", "start").text(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """All windows that are there, a row per result."""
    spark.dataSource.register(InventoryWindows)
    return spark.read.format(NAME).load(path)


def _committed(spark: SparkSession, checkpoint: str) -> int:
    """How many batches a stream has committed, by its checkpoint: they are numbered from 0."""
    home, fs = _path(spark, f"{checkpoint}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
    return max((int(n) + 1 for n in names if n.isdigit()), default=0)


def follow_windows(spark: SparkSession, path: str, target: str, checkpoint: str, per_batch: int = 100, stop_after: int | None = None) -> int:
    """Append the windows that were not read before to the Parquet table ``target``; the number of batches it took.

    Goes on until no window is left to read, or for ``stop_after`` batches. A batch that fails is read again by the next
    call, and is in ``target`` once.
    """
    spark.dataSource.register(InventoryWindows)
    stream = spark.readStream.format(NAME).option("windowsPerBatch", per_batch).load(path)
    out = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    done = 0
    if stop_after is None:  # one stream for all batches
        before = _committed(spark, checkpoint)
        run = out.trigger(processingTime="0 seconds").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
        return _committed(spark, checkpoint) - before
    while done < stop_after:
        run = out.trigger(availableNow=True).start()
        run.awaitTermination()
        if not sum(p["numInputRows"] for p in run.recentProgress):
            break
        done += 1
    return done


def window_gaps(rows: DataFrame) -> DataFrame:
    """(root, start, fault) of windows that do not follow the one before: ``gap``, or ``behind_last``; or ``no_last`` of a
    root whose last window is not there. Empty for a whole inventory."""
    windows = rows.groupBy("root", "start").agg(F.first("next_start").alias("next_start"))
    order = Window.partitionBy("root").orderBy("start")
    before, behind = F.lag("next_start").over(order), F.lag("start").over(order).isNotNull()
    fault = F.when(F.when(behind, before).otherwise(F.lit(0)) == F.col("start"), None).when(behind & before.isNull(), "behind_last").otherwise("gap")
    last = F.when(F.lead("start").over(order).isNull() & F.col("next_start").isNotNull(), "no_last")
    return windows.select("root", "start", F.coalesce(fault, last).alias("fault")).where("fault IS NOT NULL")
