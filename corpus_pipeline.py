"""From raw documents to packed training sequences: a list of stages, each on all that the one before has kept."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.checkpoints import ensure_checkpoint_dir
from tessera.llm import langid, packing, simhash, suffixes, toxicity
from tessera.llm.common import table

#: Rows of an Arrow batch. Spark's 10,000 are tens of MB of text, in buffers of the executor and of each Python worker.
BATCH = 1024


def small_batches(spark: SparkSession) -> None:
    """Send workers at most ``BATCH`` rows at a time from now on, or fewer, if the session says so. No result depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:  # 0 and less: no limit
        spark.conf.set(name, BATCH)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic verdict. The model is fitted on ``docs`` and the labels beside it.

    Null and empty texts are judged as texts without a word, repeated rows alike; other columns are kept.
    """
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; null texts, those without a letter, or like none of them, go."""
    small_batches(spark)
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a similarity of 0.8 or more: that of least doc_id.

    Texts without a word are like no other and stay, and so do rows without a doc_id; of rows that share one, one stays.
    """
    small_batches(spark)
    return simhash.keep_first(docs)


def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of any 200-byte string that occurs again. No row goes; null texts stay null."""
    small_batches(spark)
    return suffixes.strip_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. Null and empty texts are one token, repeated rows packed each."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_unknown_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", strip_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests/llm holds each on a small corpus against a plainer version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again.

    The last result stays there, for whoever reads the returned rows.
    """
    ensure_checkpoint_dir(spark)
    jvm, sc = spark._jvm, spark.sparkContext
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:  # a stage's input is not needed once its result is written
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return docs
