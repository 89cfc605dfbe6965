"""Keyed tables kept in cells on disk: a change writes the cells that it touches anew and leaves all others where they are.

A version of a store is a small table (cell, folder, rows) that says where each cell lies, be it in an older version's folder. Several
stores of one version are turned to by one pointer, so that readers see all of them before a change or all of them
after it. Nothing is written over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.checkpoints import cut
from tessera.functions.joins import few
from tessera.sources.files import _path, _point, latest_version

#: Cells of a store; what is known of them is small enough for the driver.
MOST_CELLS = 4096


@dataclass(frozen=True)
class Change:
    """What becomes of a store: rows put in by key, keys that go, and the cell of each row as a function of its columns."""

    rows: DataFrame
    keys: Sequence[str]
    cell: Column
    gone: DataFrame | None = None


def hash_cell(keys: Sequence[str], cells: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(cells)).cast("int")


def _placed(rows: DataFrame, cell: Column) -> DataFrame:
    return rows.withColumn("__cell", cell)


def _write(rows: DataFrame, folder: str) -> None:
    """A folder per cell. Rows of a cell meet in a few tasks, not one: a cell may hold very many."""
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "__cell" and not rows.schema[c].dataType.simpleString().startswith("map")]), F.lit(4))
    rows.repartition(F.col("__cell"), spread).withColumnRenamed("__cell", "cell").write.partitionBy("cell").parquet(folder)


def _map(spark: SparkSession, root: str, version: str, store: str) -> DataFrame:
    return spark.read.schema("cell int, folder string, rows bigint").parquet(f"{root}/{version}/{store}.cells")


def read_store(spark: SparkSession, root: str, store: str, schema, version: str | None = None, cells: Sequence[int] | None = None) -> DataFrame:
    """Rows of a store in a version, the latest if none is named, with their cell; of some cells only, if these are given."""
    at = version or latest_version(spark, root)
    known = _map(spark, root, at, store)
    wanted = known if cells is None else known.where(F.col("cell").isin([int(c) for c in cells]))
    found = wanted.orderBy("cell").collect()  # at most MOST_CELLS rows
    if not found:
        return spark.createDataFrame([], schema).withColumn("cell", F.lit(None).cast("int"))
    # folders as they are: paths below a cell's folder, the cell taken from the path
    paths = [f"{root}/{r.folder}/cell={r.cell}" for r in found]
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.withColumn("cell", F.regexp_extract(F.col("_metadata.file_path"), r"/cell=(\d+)/", 1).cast("int"))


def save(spark: SparkSession, root: str, version: str, changes: Mapping[str, Change], base: str | None = None) -> dict[str, list[int]]:
    """Write a version of all stores over ``base`` (none: the first version), then turn the pointer; the cells written of each.

    Of a store that is not named nothing changes. Rows that are put in replace those of their keys, wherever these lie; their
    keys are one each. Keys without a value belong to nothing: rows with one are refused.
    """
    home, fs = _path(spark, f"{root}/{version}")
    if fs.exists(home):
        raise FileExistsError(version)
    written: dict[str, list[int]] = {}
    stores = set(changes) if base is None else {s.getPath().getName().removesuffix(".cells") for s in fs.listStatus(_path(spark, f"{root}/{base}")[0]) if s.getPath().getName().endswith(".cells")} | set(changes)
    for store in sorted(stores):
        known = None if base is None or not fs.exists(_path(spark, f"{root}/{base}/{store}.cells")[0]) else _map(spark, root, base, store)
        if store not in changes:
            known.coalesce(1).write.parquet(f"{root}/{version}/{store}.cells")
            continue
        c = changes[store]
        keys = list(c.keys)
        new = cut(_placed(c.rows, c.cell))
        if new.where(" OR ".join(f"`{k}` IS NULL" for k in keys) + " OR __cell IS NULL").limit(1).count():
            raise ValueError(f"a row of {store} has no key or no cell")
        if new.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"two rows of {store} share a key")
        changed = new.select(*keys) if c.gone is None else new.select(*keys).unionByName(c.gone.select(*keys)).distinct()
        touched = {r[0] for r in new.select("__cell").distinct().collect()}
        if known is not None:
            side = F.broadcast(changed) if few(changed) else changed
            old = read_store(spark, root, store, c.rows.schema, base)
            touched |= {r[0] for r in old.join(side, keys, "left_semi").select("cell").distinct().collect()}  # reads keys only
            left = read_store(spark, root, store, c.rows.schema, base, sorted(touched)).withColumnRenamed("cell", "__cell")
            new = new.unionByName(left.join(side, keys, "left_anti"))
        if len(touched) > MOST_CELLS:
            raise ValueError(f"{store} has over {MOST_CELLS} cells")
        folder = f"{version}/{store}"
        _write(new, f"{root}/{folder}")
        # counted as written; a cell that lost all its rows is gone
        counts = spark.read.parquet(f"{root}/{folder}").groupBy("cell").agg(F.count("*").alias("rows")) if touched and new.limit(1).count() else spark.createDataFrame([], "cell int, rows bigint")
        map_ = counts.select(F.col("cell").cast("int"), F.lit(folder).alias("folder"), "rows")
        if known is not None:
            map_ = map_.unionByName(known.where(~F.col("cell").isin(sorted(touched))) if touched else known)
        map_.coalesce(1).write.parquet(f"{root}/{version}/{store}.cells")
        written[store] = sorted(touched)
    _point(spark, root, version)
    return written
