"""The corpus pipeline: documents to encoded, clean, distinct documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. The stages keep the columns of documents; the last adds nothing but the ids of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontaminate, near_dups, quality, secrets
from tessella.llm.common import delete_folder, materialise, shared_folder, table

#: SQL cannot express zstandard ratios, trained models or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the compression bands; null and empty texts go."""
    return quality.keep_good(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dups.keep_one(docs, near_dups.Params(shingle=5))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark within its error budget."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secrets.redact(docs, secrets.fit(secrets.samples(spark)))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text that they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("encode", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what the next has read goes.

    The last table stays under spark.checkpoint.dir for as long as the result is used.
    """
    folder = shared_folder(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), folder, f"{i}-{name}")
        if before:
            delete_folder(spark, f"{folder}/{before}")
        before = f"{i}-{name}"
    return docs
