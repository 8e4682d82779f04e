"""From raw documents to encoded ones: the operators of quillon.llm as stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents. Tables beside documents (labels, benchmark) are read from sf_dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.bpe import encode_documents
from quillon.llm.common import read, shared_folder
from quillon.llm.decontam import drop_contaminated
from quillon.llm.quality import keep_good
from quillon.llm.secrets import drop_secrets
from quillon.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of near-duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without secrets."""
    return drop_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with digests that a decoder can be held against."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: Fingerprints, generative models and merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder for the stages' tables, in the folder that the cluster shares."""
    return f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs, folder = read(spark, sf_dir, "documents"), _folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
