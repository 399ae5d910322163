"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, as written and read again, and all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import decontaminate, minhash_join, quality_mcd, secret_scan, sos_packing
from spandrel.llm.base import read, remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or lie far from the robust centre of their language and source, go."""
    return quality_mcd.keep_inliers(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 80 % of their five-word shingles, the one with the smallest doc_id stays."""
    return minhash_join.drop_near_duplicates(docs, "doc_id")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; the characters of their secrets are masked, and n_chars follows."""
    ledger = secret_scan.scan(docs, secret_scan.new_folder(spark))
    return secret_scan.redact(docs, ledger).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of 2048: one row a piece."""
    return sos_packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("benchmark decontamination", benchmark), ("secret scan", secrets), ("packing", packing)]

#: Tokenising and packing have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; each stage is written below the session's checkpoint folder, and removed once the next one is."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
