"""Decisions of a crawl as columns and joins: scope, inventory, retries, batches, jobs and file selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BACKOFF_BASE, BACKOFF_MOST, PACING = 2.0, 60.0, 3.0


def scope(page_id: Column, ancestors: Column, roots: Column, excluded: Column, excluded_trees: Column) -> Column:
    """Why a page is in or out: a struct (included, reason, by).

    An excluded page is out; then the nearest excluded ancestor decides; then an included root, or the nearest one above.
    ``ancestors`` runs from the top down; the three sets are arrays.
    """
    def nearest(wanted: Column) -> Column:
        return F.try_element_at(F.filter(ancestors, lambda a: F.array_contains(wanted, a)), F.lit(-1))

    def made(included: bool, reason: str, by: Column) -> Column:
        return F.struct(F.lit(included).alias("included"), F.lit(reason).alias("reason"), by.cast("string").alias("by"))

    return (
        F.when(F.array_contains(excluded, page_id), made(False, "page_excluded", page_id))
        .when(F.array_contains(excluded_trees, page_id), made(False, "tree_excluded", page_id))
        .when(nearest(excluded_trees).isNotNull(), made(False, "ancestor_excluded", nearest(excluded_trees)))
        .when(F.array_contains(roots, page_id), made(True, "included_root", page_id))
        .when(nearest(roots).isNotNull(), made(True, "included_descendant", nearest(roots)))
        .otherwise(made(False, "outside_roots", F.lit(None)))
    )


def resolve_inventory(occurrences: DataFrame, stable: Sequence[str] = ("space_key", "title")) -> DataFrame:
    """Sightings (page_id, ancestor_ids, stable fields) of pages under several roots -> one row per page.

    The longest path of ancestors wins, ties to the greater one. ``conflicts`` counts stable fields that sightings
    disagree on, and paths that are no suffix of the longest: a crawl must have none. Groups are combined as they are
    read; no group is gathered.
    """
    best = F.max(F.struct(F.size("ancestor_ids").alias("n"), F.col("ancestor_ids").alias("path"))).alias("best")
    pages = occurrences.groupBy("page_id").agg(best, *[F.min(c).alias(c) for c in stable], *[(F.min(c) != F.max(c)).cast("int").alias(f"__{c}") for c in stable], F.count("*").alias("sightings"))
    longest = pages.select("page_id", F.col("best.path").alias("__path"))
    paths = occurrences.select("page_id", "ancestor_ids").distinct().join(longest, "page_id")
    tail = F.when(F.size("ancestor_ids") == 0, F.array().cast(occurrences.schema["ancestor_ids"].dataType)).otherwise(F.slice("__path", -F.size("ancestor_ids"), F.size("ancestor_ids")))
    bad = paths.where(tail != F.col("ancestor_ids")).groupBy("page_id").agg(F.count("*").alias("__bad"))
    clash = sum((F.coalesce(f"__{c}", F.lit(0)) for c in stable), F.lit(0))
    return pages.join(bad, "page_id", "left").select("page_id", F.col("best.path").alias("ancestor_ids"), *stable, "sightings", (clash + F.coalesce("__bad", F.lit(0))).cast("bigint").alias("conflicts"))


#: Classes of answers and whether another try may help.
FAILURES = {401: ("authentication", False), 403: ("permission", False), 404: ("missing", False), 408: ("timeout", True), 425: ("early", True), 429: ("rate_limited", True)}


def failure(status: Column) -> Column:
    """Struct (kind, retry) for an HTTP status; null status: a broken connection, worth another try."""
    def made(kind: str, retry: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(retry).alias("retry"))

    out = F.when(status.isNull(), made("transport", True)).when(status < 400, made("none", False))
    for code, answer in FAILURES.items():
        out = out.when(status == code, made(*answer))
    return out.when(status >= 500, made("server", True)).otherwise(made("client", False))


def backoff(attempt: Column, base: float = 1.0, most: float = BACKOFF_MOST) -> Column:
    """Seconds before the next try: base * 2 ** (attempt - 1), at most ``most``."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(1000)) - 1))


def retry_delay(attempt: Column, retry_after: Column, base: float = 1.0, most: float = BACKOFF_MOST, pacing: float = PACING) -> Column:
    """The longest of the backoff, what the server asks for, and the pace of the crawl."""
    return F.greatest(backoff(attempt, base, most), F.coalesce(retry_after.cast("double"), F.lit(0.0)), F.lit(pacing))


def batches(rows: DataFrame, key: str, size: int = 100, shards: int | None = None) -> DataFrame:
    """``rows`` with a batch number: contiguous batches of ``size`` in the order of ``key``, nulls first.

    Places come from counts per range of keys and a place within the range, so that no task orders the whole table. There
    are as many ranges as the session has shuffle partitions, unless ``shards`` names a number.
    """
    shards = shards or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = rows.agg(F.percentile_approx(key, [i / shards for i in range(1, shards)], max(10_000, 100 * shards))).first()[0] if shards > 1 else []
    part = F.lit(0)
    bounds = F.lit(sorted(set(cuts or [])))
    if cuts:
        part = F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.size(F.filter(bounds, lambda c: F.col(key) > c)))
    keyed = rows.withColumn("__part", part)
    sizes = keyed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row per range
    placed = keyed.withColumn("__place", F.row_number().over(Window.partitionBy("__part").orderBy(F.asc_nulls_first(key))) - 1)
    out = placed.join(F.broadcast(before), "__part")  # ``shards`` rows
    return out.withColumn("batch", F.floor((F.col("__before") + F.col("__place")) / size)).drop("__part", "__place", "__before")


TERMINAL = ("completed", "failed", "cancelled")


def job_states(events: DataFrame, job: str = "job_id", at: Sequence[str] = ("ts", "event_id"), state: str = "state") -> DataFrame:
    """Events of jobs -> (job, state, events, resumable): the state each job is in.

    completed, failed and cancelled end a job: the first of them stays. Otherwise the latest event counts. A job can be
    resumed if it was paused, or failed after it had been running. All is combined as it is read, so that a job with very
    many events is no burden.
    """
    when = F.struct(*at)
    ended = F.col(state).isin(*TERMINAL)
    out = events.groupBy(job).agg(
        F.min_by(F.when(ended, F.col(state)), F.when(ended, when)).alias("__end"),
        F.max_by(state, when).alias("__last"),
        F.min(F.when(F.col(state) == "running", when)).alias("__ran"),
        F.min(F.when(ended, when)).alias("__ended"),
        F.count("*").alias("events"),
    )
    final = F.coalesce("__end", "__last")
    resumable = (final == "paused") | ((final == "failed") & F.coalesce(F.col("__ran") < F.col("__ended"), F.lit(False)))
    return out.select(job, final.alias("state"), "events", resumable.alias("resumable"))


def submissions(requests: DataFrame, key: str, at: Sequence[str] = ("ts", "event_id"), job: str = "event_id") -> DataFrame:
    """Requests with an active key -> (key, job, requests): the first request made the job; later ones get it back."""
    return requests.groupBy(key).agg(F.min_by(job, F.struct(*at)).alias(job), F.count("*").alias("requests"))


#: Path parts and file endings that a source scan leaves out, and endings of files that symbols are read from.
GENERATED = ("generated", "gen", "build", "dist", "out", "target", "node_modules")
VENDOR = ("vendor", "third_party", "external", "pods")
BINARY = (
    "7z", "a", "apk", "avi", "bin", "bmp", "class", "dll", "dylib", "eot", "exe", "gif", "gz", "ico", "jar", "jpeg", "jpg",
    "lib", "mp3", "mp4", "o", "obj", "otf", "pdf", "png", "so", "tar", "ttf", "wav", "webp", "woff", "woff2", "xz", "zip",
)
AUTHORITY = ("cc", "cpp", "cxx", "hh", "hpp", "hxx", "inl", "java")
RESERVED = ("con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)))


def extension(path: Column) -> Column:
    """The ending of a path's last part, in lower case; empty without one, and for names that are an ending only."""
    return F.regexp_extract(F.lower(path), r"[^/]\.([^./]+)$", 1)


def exclusion(path: Column, content: Column | None = None) -> Column:
    """Why a file is left out: generated, vendor or binary (by its ending, or a NUL anywhere); null if it stays."""
    parts = F.split(F.lower(path), "/")
    binary = extension(path).isin(*BINARY)
    if content is not None:
        binary = binary | F.coalesce(F.contains(content, F.lit(b"\x00")), F.lit(False))
    return F.when(F.arrays_overlap(parts, F.lit(list(GENERATED))), "generated").when(F.arrays_overlap(parts, F.lit(list(VENDOR))), "vendor").when(binary, "binary")


def symbol_authority(path: Column) -> Column:
    """Whether symbols are read from files with this ending."""
    return extension(path).isin(*AUTHORITY)


def valid_path(path: Column) -> Column:
    """Whether every part of a path can be stored anywhere: no empty, dot or reserved part, none that ends in a dot or a
    space, no control character."""
    bad = F.exists(F.split(path, "/"), lambda x: (x == "") | x.isin(".", "..") | F.lower(x).isin(*RESERVED) | x.endswith(".") | x.endswith(" ") | x.rlike(r"[\x00-\x1F\x7F-\x9F]"))
    return F.coalesce(~bad, F.lit(False))


def text_fault(content: Column) -> Column:
    """What keeps a file's bytes from being text: invalid_utf8 or unsupported_control; null if nothing does."""
    text = F.decode(F.when(F.is_valid_utf8(content.cast("string")), content), "UTF-8")
    return F.when(text.isNull() & content.isNotNull(), "invalid_utf8").when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), "unsupported_control")


def scan_metrics(files: DataFrame, reason: str = "excluded") -> DataFrame:
    """(excluded, size) -> (reason, files, bytes), ``included`` for the files that stay."""
    return files.groupBy(F.coalesce(reason, F.lit("included")).alias("reason")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def inspect_store(expected: DataFrame, stored: DataFrame, keys: Sequence[str] = ("run_id", "page_id")) -> DataFrame:
    """Expected pages (keys, sha256) against stored ones (keys, sha256, body) -> (keys, status).

    MISSING: nothing stored. INVALID: the body does not have the hash it was stored under. IDENTITY_CONFLICT: it is
    another body than the one expected. REPLAYABLE: all agree.
    """
    s = stored.select(*keys, F.col("sha256").alias("__stored"), F.sha2("body", 256).alias("__real"))
    status = F.when(F.col("__stored").isNull(), "MISSING").when(~F.col("__stored").eqNullSafe(F.col("__real")), "INVALID").when(F.col("__stored") != F.col("sha256"), "IDENTITY_CONFLICT").otherwise("REPLAYABLE")
    return expected.join(s, list(keys), "left").select(*keys, status.alias("status"))


def within_budget(new: DataFrame, stored: DataFrame, most_bytes: int, body: str = "body", keys: Sequence[str] = ("run_id", "page_id")) -> bool:
    """Whether the stored and the new bodies together stay within the budget; what is stored already costs nothing again."""
    added = new.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    sizes = added.select(F.octet_length(body).alias("n")).unionByName(stored.select(F.octet_length(body).alias("n")))
    return (sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) <= most_bytes
