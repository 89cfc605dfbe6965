"""Readers and writers of record streams: JSON lines, packets, source trees, text corpora, published versions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tessera.functions.canonical import rows_digest
from tessera.operators.delta import overlay
from tessera.operators.integrity import require_none, tombstone_violations

STREAMS = ("documents", "chunks", "relations", "acl", "media_assets", "symbols", "sync_state", "tombstones")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped and a line that is no such object fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


@F.pandas_udf(StringType())
def _fault(lines: pd.Series) -> pd.Series:
    def no_twice(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("duplicate key")
        return dict(pairs)

    def no_constant(name):
        raise ValueError(f"{name} is no JSON")

    def one(line: str) -> str | None:
        try:
            found = json.loads(line, object_pairs_hook=no_twice, parse_constant=no_constant)
        except ValueError as e:
            return "duplicate_key" if "duplicate" in str(e) else "malformed"
        return None if isinstance(found, dict) else "not_an_object"

    return lines.map(one)


def json_faults(spark: SparkSession, path: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """(line, fault) of lines that the strict form forbids: blank, malformed, no object, a key twice, an unknown key."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    fault = F.when(F.trim("line") == "", "blank").otherwise(_fault("line"))
    rows = lines.withColumn("fault", fault)
    if allowed is not None:
        unknown = F.size(F.array_except(F.json_object_keys("line"), F.lit(list(allowed)))) > 0
        rows = rows.withColumn("fault", F.coalesce("fault", F.when(unknown, "unknown_key")))
    return rows.where("fault IS NOT NULL")


def write_json_lines(rows: DataFrame, path: str, key: str, nulls: bool = True) -> None:
    """Records by ascending key, with sorted field names; ``nulls`` keeps fields without a value.

    Files follow each other in the order of keys, so that their concatenation is the stream.
    """
    fields = F.struct(*[F.col(c) for c in sorted(rows.columns)])
    text = F.to_json(fields, {"ignoreNullFields": str(not nulls).lower()})
    rows.repartitionByRange(key).sortWithinPartitions(key).select(text.alias("value")).write.text(path)


#: Versions that a chain of deltas may have.
LONGEST_CHAIN = 32


def _path(spark: SparkSession, name: str):
    """A path of Hadoop's and its file system: the only way to rename and to list that any store has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Turn the pointer: it is written aside and moved over the old one, so that readers see one or the other, whole."""
    jvm = spark._jvm
    aside, fs = _path(spark, f"{root}/.LATEST-{version}")
    out = fs.create(aside, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, _path(spark, f"{root}/LATEST")[0], over)


def write_version(streams: Mapping[str, DataFrame], root: str, version: str, manifest: Mapping[str, object], check: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None) -> None:
    """Write all streams of a version, then its manifest with their counts and digests, then the pointer to it.

    A version that is there already is never written over, and readers see a new one only by the pointer. ``check`` gives a
    row per violation of the streams as written; with any the version is not published and what was written goes again.
    """
    spark = next(iter(streams.values())).sparkSession
    home, fs = _path(spark, f"{root}/{version}")
    if fs.exists(home):
        raise FileExistsError(version)
    aside = f"{root}/.staging-{version}"
    for name, rows in streams.items():
        rows.write.mode("overwrite").parquet(f"{aside}/{name}")
    written = {name: spark.read.schema(rows.schema).parquet(f"{aside}/{name}") for name, rows in streams.items()}
    try:
        if check is not None:
            require_none(check(written))
        found = {name: rows_digest(rows).first() for name, rows in written.items()}  # a row per stream: rows and digest
        digests = {name: r.digest for name, r in found.items()}
        full = dict(manifest) | {"dataset_version": version, "counts": {name: r.rows for name, r in found.items()}, "digests": digests, "digest": tree_digest(digests)}
        spark.createDataFrame([(json.dumps(full, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{aside}/manifest")
    except Exception:
        fs.delete(_path(spark, aside)[0], True)
        raise
    fs.rename(_path(spark, aside)[0], home)
    _point(spark, root, version)


def rollback(spark: SparkSession, root: str, version: str) -> None:
    """Turn the pointer back to a version that is there. Versions themselves are never changed."""
    home, fs = _path(spark, f"{root}/{version}")
    if not fs.exists(home):
        raise FileNotFoundError(version)
    _point(spark, root, version)


def tree_digest(digests: Mapping[str, str]) -> str:
    """One digest over those of all streams, by their names; ``canonical.streams_digest`` gives the same as a plan."""
    return hashlib.sha256("\x00".join(f"{name}={digests[name]}" for name in sorted(digests)).encode()).hexdigest()


def _folder(spark: SparkSession, root: str, version: str, verify: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{root}/{version}/manifest").first()[0])
    home, fs = _path(spark, f"{root}/{version}")
    found = {s.getPath().getName() for s in fs.listStatus(home)} - {"manifest"}
    if found != set(manifest["counts"]):
        raise ValueError(f"a version holds exactly the streams of its manifest: {sorted(found ^ set(manifest['counts']))}")
    streams = {name: spark.read.parquet(f"{root}/{version}/{name}") for name in manifest["counts"]}
    digests = manifest.get("digests")
    if digests is not None and (set(digests) != set(streams) or tree_digest(digests) != manifest.get("digest")):
        raise ValueError("the manifest contradicts itself")
    if verify == "digests" and digests is not None:
        found = {name: rows_digest(rows).first() for name, rows in streams.items()}
        wrong = [name for name, r in found.items() if (r.rows, r.digest) != (manifest["counts"][name], digests[name])]
    else:
        wrong = [] if verify == "none" else [name for name, n in manifest["counts"].items() if streams[name].count() != n]
    if wrong:
        raise ValueError(f"streams differ from the manifest: {wrong}")
    return streams, manifest


def latest_version(spark: SparkSession, root: str) -> str:
    return spark.read.text(f"{root}/LATEST").first()[0]


def read_version(spark: SparkSession, root: str, version: str | None = None, keys: Mapping[str, tuple[str, str]] | None = None, verify: str = "digests") -> tuple[dict[str, DataFrame], dict]:
    """The streams and the manifest of a version, the latest if none is named; they must agree.

    ``verify`` says how far that is looked at, which takes a pass over each version: ``digests`` of all rows, so that no
    changed byte of a value goes unseen, ``counts`` only, or ``none``.

    A delta is laid over the version that its manifest names as base, and so on down to a whole one: at most
    ``LONGEST_CHAIN`` versions, none twice. ``keys`` maps streams to (key, entity type) for that; tombstones of a delta must
    name entities of its base, and take them away.
    """
    chain: list[tuple[dict[str, DataFrame], dict]] = []
    seen: list[str] = []
    name: str | None = version or latest_version(spark, root)
    while name is not None:
        if name in seen or len(seen) >= LONGEST_CHAIN:
            raise ValueError("the chain of versions has a circle or is too long")
        seen.append(name)
        chain.append(_folder(spark, root, name, verify))
        name = chain[-1][1].get("base_dataset_version") if chain[-1][1].get("export_mode") == "delta" else None
    streams = chain[-1][0]
    for part, _ in reversed(chain[:-1]):
        keys = keys or KEYS
        tombs = part["tombstones"]
        prior = {kind: streams[s].select(key) for s, (key, kind) in keys.items() if s in streams}
        require_none(tombstone_violations(tombs, prior))
        streams = {s: overlay(rows, part[s], tombs, *keys[s]) if s in keys and s in part else part.get(s, rows) for s, rows in streams.items()}
    return streams, chain[0][1]


#: Fixed by the record format: the key of each stream, and the type that its rows have in tombstones.
KEYS = {
    "documents": ("document_id", "document"), "chunks": ("chunk_id", "chunk"), "relations": ("relation_id", "relation"),
    "acl": ("acl_id", "acl"), "media_assets": ("media_id", "media"), "symbols": ("symbol_id", "symbol"), "sync_state": ("entity_id", "sync"),
}


def write_delta(streams: Mapping[str, DataFrame], root: str, version: str, base: str, manifest: Mapping[str, object], keys: Mapping[str, tuple[str, str]] | None = None) -> None:
    """Publish the sparse streams of a delta over the version ``base``, which must be there.

    Tombstones must name entities that the base holds, its own base's included.
    """
    if base == version:
        raise ValueError("a delta needs another version as its base")
    spark = next(iter(streams.values())).sparkSession
    below, _ = read_version(spark, root, base, keys, "counts")
    prior = {kind: below[s].select(key) for s, (key, kind) in (keys or KEYS).items() if s in below}
    write_version(streams, root, version, dict(manifest) | {"export_mode": "delta", "base_dataset_version": base}, lambda s: tombstone_violations(s["tombstones"], prior))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs, a JSON file each, by age: (run_id, label, created_at, layer1, layer2). Files that are no run are skipped."""
    layer = "struct<hit_at_10:double,mrr:double,n_cases:bigint>"
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", f"run_id string, label string, created_at string, layer1 {layer}, layer2 {layer}").alias("r"))
    return files.select("r.*").where("run_id IS NOT NULL").orderBy(F.coalesce("created_at", F.lit("")), "run_id")


def write_packet(streams: Mapping[str, DataFrame], path: str, keys: Mapping[str, str], facts: Mapping[str, object]) -> None:
    """Streams as JSON lines in the order of their keys, and a summary with the number of records of each."""
    spark = next(iter(streams.values())).sparkSession
    for name, rows in streams.items():
        write_json_lines(rows, f"{path}/{name}.jsonl", keys[name])
    summary = dict(facts) | {"counts": {name: spark.read.text(f"{path}/{name}.jsonl").count() for name in streams}}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/packet_summary.json")


def write_diagrams(diagrams: DataFrame, path: str) -> None:
    """(media_id, mermaid) -> a text file ``<media_id>.mmd`` for each diagram, in a folder that is not there yet.

    Tasks write through Spark's own folder for each id; the files are then moved to their names, so that a task that runs
    again leaves nothing behind.
    """
    spark = diagrams.sparkSession
    aside = f"{path}.staging"
    diagrams.where("mermaid IS NOT NULL").select(F.col("media_id").alias("file"), F.col("mermaid").alias("value")).repartition("file").write.partitionBy("file").text(aside)
    home, fs = _path(spark, aside)
    target, _ = _path(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    fs.mkdirs(target)
    for folder in fs.listStatus(home):
        name = folder.getPath().getName().removeprefix("file=")
        for part in fs.listStatus(folder.getPath()) if folder.isDirectory() else ():
            fs.rename(part.getPath(), _path(spark, f"{path}/{name}.mmd")[0])
    fs.delete(home, True)


def read_tree(spark: SparkSession, path: str, repo: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Files of a source tree -> (repo, path, size, content, excluded, fault, text, language, symbols).

    Excluded files have no text, nor have those with a fault: a path that cannot be stored anywhere, bytes that are no
    UTF-8, or control characters. ``most_bytes`` is a budget: a tree with a larger file that is not excluded is refused
    when it is read, as leaving the file out would go unseen.
    """
    from tessera.functions.text import language_of
    from tessera.operators.crawl import exclusion, symbol_authority, text_fault, valid_path

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace("path", r"^.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root) + "/", "")
    rows = files.select(F.lit(repo).alias("repo"), relative.alias("path"), F.col("length").alias("size"), "content")
    refused = F.raise_error(F.concat(F.lit(f"a file is over the budget of {most_bytes} bytes: "), "path")).cast("string")
    reason = F.coalesce(exclusion(F.col("path"), F.col("content")), F.when(F.col("size") > most_bytes, refused))
    out = rows.withColumn("excluded", reason).withColumn("fault", F.when(F.col("excluded").isNull(), F.when(~valid_path(F.col("path")), "path_invalid").otherwise(text_fault(F.col("content")))))
    good = F.col("excluded").isNull() & F.col("fault").isNull()
    return out.withColumns({"text": F.when(good, F.decode("content", "UTF-8")), "language": language_of(F.col("path")), "symbols": good & symbol_authority(F.col("path"))})


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON object per line; blank lines and those that open with # are skipped.

    A case has an id and both questions, and names at least one relevant chunk, document or source; others fail the job.
    """
    schema = "id string, user_question string, search_query string, relevant_chunk_ids array<string>, relevant_document_ids array<string>, relevant_source_ids array<string>, tags array<string>, filters map<string,string>"
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT ltrim(value) LIKE '#%'")
    cases = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("c")).select("c.*")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    nothing = F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) + F.coalesce(F.size("relevant_document_ids"), F.lit(0)) + F.coalesce(F.size("relevant_source_ids"), F.lit(0)) <= 0
    fault = F.coalesce(*[F.when(blank(F.col(c)), F.lit(f"{c} is missing")) for c in ("id", "user_question", "search_query")], F.when(nothing, F.lit("nothing is relevant")))
    return cases.withColumn("id", F.when(fault.isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("a case is no case: "), fault, F.lit(": "), F.coalesce("id", F.lit("")))).cast("string")))


def read_packet(spark: SparkSession, path: str, schemas: Mapping[str, StructType | str]) -> dict[str, DataFrame]:
    """The streams of a packet folder; its summary names the number of records of each, which must agree."""
    summary = json.loads("".join(r[0] for r in spark.read.text(f"{path}/packet_summary.json").collect()))  # one small file
    home, fs = _path(spark, path)
    found = {s.getPath().getName() for s in fs.listStatus(home)}
    if found != {"packet_summary.json", *(f"{name}.jsonl" for name in schemas)}:
        raise ValueError(f"a packet holds its streams and its summary, and nothing else: {sorted(found)}")
    streams = {name: read_json_lines(spark, f"{path}/{name}.jsonl", s) for name, s in schemas.items()}
    wrong = [name for name, rows in streams.items() if rows.count() != summary["counts"].get(name)]
    if wrong:
        raise ValueError(f"counts differ from the summary: {wrong}")
    return streams
