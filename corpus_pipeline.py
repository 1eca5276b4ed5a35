"""Documents to packed training sequences: toxic ones go, near copies go, repeated passages go, the rest is packed.

Defined cases: null and empty texts pass the first three stages as they are and are packed as the end id alone; very long texts are
worked on whole; rows that repeat a doc_id and text stay together, and are packed each for itself; rows without a doc_id are
scored and packed, and are neither near copies nor hold repeated passages of others; an empty table gives no sequences; other columns
go through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import ngram_join, packing, suffix_dedup, toxicity
from lodestream.llm._spark import durable, release

#: SQL can't express the learned scores, so the pipeline is tested against a brute-force version of its stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the classifier, fitted on the labels that are not held out, finds not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by 0.8 or more of their five-word shingles."""
    return ngram_join.keep_one(docs, width=5, threshold="0.8")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a string of 100 bytes covers which starts earlier too."""
    return suffix_dedup.without_repeats(docs, length=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 1024."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_of_near_copies), ("suffix_array_dedup", cut_repeats), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on a table that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
