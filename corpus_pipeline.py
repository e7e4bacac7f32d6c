"""A training corpus from raw documents: five stages, each over all that the stage before it kept.

Toxic documents go, near-duplicates shrink to one document a group, documents with benchmark passages go, sources are
mixed to their target weights, and the mix is written as token files and read back. Every stage takes (spark, docs,
sf_dir) and returns a DataFrame; its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fluxfield.llm import decontamination, mixing, simhash, token_files, toxicity
from fluxfield.llm.common import new_path, table
from fluxfield.llm.queries import WORD_VOCABULARY


#: Rows that go to Python and back at once, whole texts among them: a task holds a few such batches outside the heap.
BATCH_ROWS = 1_000


def in_batches(spark: SparkSession) -> None:
    """For this session; every stage calls for it that has Python in it, so that each can run by itself."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_batches(spark)
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_batches(spark)
    return token_files.token_files(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: A trained classifier, fingerprints and byte-pair codes are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
