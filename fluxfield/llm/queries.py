"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tools, decontamination, merkle, mixing, quality_rules, resampling, secret_scan, sentence_pieces, sharding, simhash, token_counts, token_files, toxicity
from .common import new_path, stored, table

#: The tokenizer of token files, by the name its package knows.
WORD_VOCABULARY = "word_bpe_49k.json"
#: Vocabularies of the secret scan and of token counts, the latter before and after a change of tokenizer.
BYTE_VOCABULARY, MULTI_VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
#: The model of SentencePiece encoding.
PIECE_MODEL = "piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: every document comes in under the first tokenizer; all but the first of equal
    texts go; those left that are not English are revised to a tokenizer for many languages. A batch is sent twice.

    The first of equal texts is the one of the least id, a null id last; null texts equal each other, and a null
    language is not English."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    text_hash = F.sha2(F.coalesce(F.concat(F.lit("text:"), "text"), F.lit("none")), 256)
    docs = docs.withColumns({"text_hash": text_hash, "row": F.monotonically_increasing_id()})
    first, second = (public_tokenizers.path(v) for v in (BYTE_VOCABULARY, MULTI_VOCABULARY))
    keep = ["doc_id", "text_hash", "row", "lang", "source", "n_chars"]
    foreign = ~F.col("lang").eqNullSafe("en")
    counted = stored(token_counts.with_tokens(docs, first, public_tokenizers.PATTERN, keep, other={"n_tokens_2": (second, foreign)}), "counts")
    # What is left of equal texts is one row, found in one grouping; the copies are all rows less these.
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "lang", "source", "n_chars", "n_tokens", "n_tokens_2"))
    firsts = stored(counted.groupBy("text_hash").agg(kept.alias("first")).select("first.*"), "firsts")
    rollup = token_counts.Rollup(spark, new_path(spark, "rollup"))
    v1, v2 = BYTE_VOCABULARY, MULTI_VOCABULARY
    rollup.commit("1-insert", token_counts.delta(counted, 1, v1))
    gone = [token_counts.delta(counted, -1, v1), token_counts.delta(firsts, 1, v1)]
    rollup.commit("2-copies", *gone)
    old = firsts.where(foreign)
    rollup.commit("3-revise", token_counts.delta(old, -1, v1), token_counts.delta(old.withColumn("n_tokens", F.col("n_tokens_2")), 1, v2))
    rollup.commit("2-copies", *gone)
    return rollup.totals()


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN)


def op5_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.link_tool_calls(*chat_tools.calls_of_conversations(table(spark, sf_dir, "conversations")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_benchmark_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document, by a hash of its id, is presented with one character more than it has."""
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = F.when(seventh, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(table(spark, sf_dir, "documents"), claims={"n_chars": claimed})


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_token_counts": op2_token_counts,
        "op3_sharding": op3_sharding,
        "op4_secret_scan": op4_secret_scan,
        "op5_chat_tools": op5_chat_tools,
        "op6_toxicity": op6_toxicity,
        "op7_simhash": op7_simhash,
        "op8_mixing": op8_mixing,
        "op9_decontamination": op9_decontamination,
        "op10_token_files": op10_token_files,
        "op11_resampling": op11_resampling,
        "op12_sentence_pieces": op12_sentence_pieces,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_tools": chat_tools.ORACLE_SQL,
        "op8_mixing": mixing.ORACLE_SQL,
        "op9_decontamination": decontamination.ORACLE_SQL,
        "op11_resampling": resampling.ORACLE_SQL,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
