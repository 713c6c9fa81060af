"""One query for each training-data operator, over its whole table, and the SQL for those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import byte_bpe, decontamination, flac, hidden_markov, jaccard_join, license_scan, merkle, packed_ids, scratch, spelling, suffix_array, suffix_automaton, toxicity, warc
from quillspark.llm.oracle import ORACLE_SQL  # noqa: F401

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"), scratch.folder(spark, "warc"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automaton.digests(table(spark, sf_dir, "documents"))


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.read(packed_ids.write(table(spark, sf_dir, "documents"), scratch.folder(spark, "ids"), WORD_BPE))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digests(table(spark, sf_dir, "documents"))


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.damaged_variants(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_flac": op1_flac,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_suffix_automaton": op6_suffix_automaton,
    "op7_packed_ids": op7_packed_ids,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_array": op9_suffix_array,
    "op10_hidden_markov": op10_hidden_markov,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_license_scan": op12_license_scan,
    "op13_merkle_manifest": op13_merkle_manifest,
}
