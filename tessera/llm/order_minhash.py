"""Order MinHash document fingerprints, in DataFrame operations only.

A text is a sequence of words; its k-mers are pairs of neighbouring words (the last word pairs with the end), each with
the number of its occurrence, so that repeats count. One hash order keeps the ``KEPT`` minimal k-mers of a text. Each of
``SKETCHES`` further orders selects the ``TUPLE`` minimal ones of these; they keep the order they have in the text, and the
ordered tuple is hashed. Two texts share a value about as often as they share k-mers in the same order, which follows edit
distance more closely than sets of k-mers do.

All this happens in the row of the text: the one shuffle of the plan brings each document to its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

SKETCHES, TUPLE, KEPT = 32, 2, 64
#: Bits of a packed value that hold a place in the text: no string of Spark's has more words than that.
SHIFT = 30
PLACE = (1 << SHIFT) - 1
BLANK = r"[\x20\x09-\x0D]+"
FIRST = -(2**63)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The last i with bounds[i] <= key, by bisection in a literal array."""
    array = F.lit(bounds)
    bits = [1 << b for b in range(max(len(bounds) - 1, 1).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.lit(bits), F.lit(0),
        lambda at, bit: F.when((at + bit < len(bounds)) & (F.get(array, F.least(at + bit, F.lit(len(bounds) - 1))) <= key), at + bit).otherwise(at),
    )


def _hashes(text: Column) -> Column:
    """A hash of each word, and of the empty word that marks the end."""
    return F.transform(F.concat(F.array_remove(F.split(text, BLANK), ""), F.array(F.lit(""))), lambda w: F.xxhash64(w))


def _packed(h: Column) -> Column:
    """k-mers as sorted numbers, 34 bits of hash above 30 bits of place."""
    pairs = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
    return F.sort_array(F.transform(pairs, lambda x, i: x.bitwiseAND(~PLACE).bitwiseOR(i.cast("bigint"))))


def _numbered(s: Column) -> Column:
    """Each k-mer hashed with the number of its occurrence: how far it stands in its run of equal hashes.

    The run's start is found by bisection. Numbers are sorted, so that an earlier one is of the run if it is not below
    the hash; before the array's start there is none.
    """

    def steps(bits: int) -> Column:
        return F.lit([1 << b for b in range(bits - 1, -1, -1)])

    def one(x: Column, i: Column) -> Column:
        h = x.bitwiseAND(~PLACE)
        known = F.when(i < 16, steps(4)).when(i < 256, steps(8)).when(i < 4096, steps(12)).otherwise(steps(31))
        number = F.aggregate(known, F.lit(0), lambda at, bit: F.when(F.get(s, i - at - bit) >= h, at + bit).otherwise(at))
        return F.xxhash64(h, F.when(F.get(s, i - 1) >= h, number).otherwise(0)).bitwiseAND(~PLACE).bitwiseOR(x.bitwiseAND(PLACE))

    return F.transform(s, one)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (bucket, place, guard, doc_id, text, next_text): documents in ascending doc_id.

    Ids are cut into many ranges by their quantiles; the first documents of a range are also sent, as guards, to the
    range before it (those of the first range to the last), so that no order over the whole table is needed.
    """
    n = 8 * partitions(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(FIRST)))
    low, cuts = keyed.agg(F.min("key"), F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n)).first()
    bounds = sorted({low if low is not None else 0, *(cuts or [])})
    bucket = keyed.withColumn("bucket", _bucket(F.col("key"), bounds))
    head = F.col("key") == F.get(F.lit(bounds), F.col("bucket"))
    before = F.when(F.col("bucket") == 0, len(bounds) - 1).otherwise(F.col("bucket") - 1)
    own = F.struct("bucket", F.lit(False).alias("guard"), F.lit(False).alias("wraps"))
    guard = F.struct(before.alias("bucket"), F.lit(True).alias("guard"), (F.col("bucket") == 0).alias("wraps"))
    dealt = bucket.select("doc_id", "key", "text", F.explode(F.when(head, F.array(own, guard)).otherwise(F.array(own))).alias("to")).select("doc_id", "key", "text", "to.*")
    order = Window.partitionBy("bucket").orderBy("wraps", "key", "guard", "text")
    return dealt.select("bucket", "guard", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys and ``text`` -> keys and ``sketch`` (array of bigints), a row per row."""
    # the generators keep each array from being computed again for each of its elements
    hashed = rows.select(*keys, F.explode(F.array(_hashes(F.col("text")))).alias("h"))
    packed = hashed.select(*keys, F.explode(F.array(_packed(F.col("h")))).alias("s"))
    # an order over all k-mers: numbered hashes, the least first
    kept = packed.select(*keys, F.explode(F.array(F.slice(F.sort_array(_numbered(F.col("s"))), 1, KEPT))).alias("v"))

    def value(j: int) -> Column:
        order = F.transform("v", lambda x: F.xxhash64(F.shiftright(x, SHIFT), F.lit(j)).bitwiseAND(~PLACE).bitwiseOR(x.bitwiseAND(PLACE)))
        least = F.slice(F.sort_array(order), 1, TUPLE)
        # the place goes on top to bring the tuple into the order of the text, then only hashes count
        turned = F.sort_array(F.transform(least, lambda x: F.shiftleft(x.bitwiseAND(PLACE), 64 - SHIFT).bitwiseOR(F.shiftrightunsigned(x, SHIFT))))
        return F.xxhash64(F.transform(turned, lambda x: x.bitwiseAND((1 << (64 - SHIFT)) - 1))).bitwiseAND((1 << 32) - 1)

    return kept.select(*keys, F.array(*[value(j) for j in range(SKETCHES)]).alias("sketch"))


def likeness(a: Column, b: Column) -> Column:
    """An estimate of the part of k-mers that two texts have in common and in order, from 0 to 1.

    A value is equal if all ``TUPLE`` k-mers of its tuple are, so the root of that degree is taken of the part of equal values.
    """
    return F.pow(F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SKETCHES)), F.lit(1.0 / TUPLE))


def written(sketch: Column) -> Column:
    return F.concat_ws("", F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the fingerprints of each text and of its edited text, one row per row of ``docs``.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document in ascending doc_id; after the last comes the first, so that a single document follows itself.
    Rows with one doc_id follow each other in the order of their texts; a null doc_id comes first. Null texts count as
    empty; texts without a word share one fingerprint.
    """
    rows = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"), F.expr("substring(next_text, 1, int(floor(char_length(text) / 2)))"))
    edited = F.when(half > 0, edited).otherwise(F.col("text"))
    made = rows.select("bucket", "place", "guard", "doc_id", n.cast("bigint").alias("n_chars"), "text", F.when(~F.col("guard"), edited).alias("edited"))
    two = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.lit("").alias("sha")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("sha")))
    kinds = made.select("bucket", "place", "guard", "doc_id", "n_chars", F.explode(two).alias("k")).select("bucket", "place", "guard", "doc_id", "n_chars", "k.*").where("text IS NOT NULL")
    each = sketches(kinds, ["bucket", "place", "guard", "doc_id", "n_chars", "kind", "sha"])
    order = Window.partitionBy("bucket").orderBy("place", "kind")
    # of each document come first its own sketch, then the edited one, then the next document's
    lined = each.select("*", F.lead("sketch").over(order).alias("edited"), F.lead("sha").over(order).alias("edited_sha256"), F.lead("sketch", 2).over(order).alias("following"))
    return lined.where("kind = 0 AND NOT guard").select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"), written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited")).alias("near_edited"), likeness(F.col("sketch"), F.col("following")).alias("near_next"),
    )
