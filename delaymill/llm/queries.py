"""The queries of this folder, each an operator applied to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymill.llm import chat, decontaminate, divergence, fingerprints, language_id, line_dedup, manifest, mixing, ngram_join, quality, sharding, token_counts, warc
from delaymill.llm.support import table
from delaymill.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The sample with the number of copies of each document; copies counted, it has the raked marginals."""
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.round("_share", 6).alias("share"),
        F.round("_probability", 6).alias("probability"),
        F.col("_copies").alias("copies"),
    )


QUERIES["op1_mixing_copies"] = op1_mixing  # its name before the sample had its copies everywhere


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", counts.n_tokens > 4096)


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_dedup.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


@query
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    index = warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.read_records(index, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(chat.windows(turns.unionByName(extra)))


@query
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@query
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


@query
def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(chosen, lowered).otherwise(F.col("text"))
    docs = table(spark, folder, "documents")
    leaves = docs.select("doc_id", "lang", manifest.leaf().alias("leaf"), manifest.leaf(text=text).alias("tampered"))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    proved = manifest.proofs(leaves, ("tampered",)).select("*", manifest.fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", manifest.digest(siblings).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


ORACLES["op1_mixing"] = ORACLES["op1_mixing_copies"] = mixing.oracle(copies=True)
ORACLES["op6_warc"] = warc.ORACLE
ORACLES["op8_ngram_join"] = ngram_join.ORACLE
ORACLES["op4_line_dedup"] = line_dedup.ORACLE
ORACLES["op13_divergence"] = divergence.ORACLE
ORACLES["op11_manifest"] = manifest.ORACLE
