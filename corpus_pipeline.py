"""A corpus from raw documents to packed training sequences, in four stages.

Each stage takes the documents that its predecessor kept and returns documents with the same
columns; the last returns the pieces of the sequences. Between stages, ``run`` writes the
documents as Parquet into the shared folder and reads them again, so that no stage's work is
done twice and a lost executor costs the work of its tasks only. A folder goes when the next
one is written; the last stays for whoever reads the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from promptsift.llm import packing, quality, secret_scan, simhash
from promptsift.llm.common import dropped, shared_dir, table
from promptsift.llm.registry import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.kept_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay."""
    return secret_scan.redacted(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scans", secret_scans), ("packing", packed_sequences)]

#: SQL can't run the tokenizer of the last stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
            if before:
                dropped(spark, before)
            before = folder
    return docs
