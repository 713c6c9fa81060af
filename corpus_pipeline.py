"""The corpus pipeline: toxic documents go, near duplicates go, repeated passages go, leaked test items go, the rest is encoded.

Each stage takes what its predecessor kept, whole, and all but the last return the columns of documents, and
any further ones, of whatever name. n_chars follows the text.

Defined cases: rows with null ids stay (they are never near duplicates, and lose the passages that rows with ids
hold); null and empty texts stay as they are and encode to no ids; very long texts are taken whole; of repeated
rows one stays, as of all near duplicates; ties go to the smallest id; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, decontamination, jaccard_join, scratch, suffix_automaton, toxicity

#: Words of a passage that may stand in one document only: below the 50 words that mark a repeated passage.
PASSAGE = 40
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't mark as toxic."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group linked by a Jaccard similarity of 0.8 of 5-word shingles."""
    return jaccard_join.representatives(docs, 5, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids hold."""
    return suffix_automaton.remove(docs, PASSAGE).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of the bytes that they decode to."""
    both = byte_bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Neighbour votes, suffix automata and byte-pair merges have no form in plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's rows stored before the next reads them."""
    docs, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.mark()
    for name, stage in STAGES[:-1]:
        docs = scratch.saved(stage(spark, docs, sf_dir), name)
        scratch.cleared(spark, began, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
