"""A training-data pipeline over ``documents``: quality rules, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the last return the
columns of ``documents``; the last one returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import quality
from veilmark.llm._common import prepare, written
from veilmark.llm.decontaminate import clean_documents
from veilmark.llm.packing import pack
from veilmark.llm.private import mask_private
from veilmark.llm.similar import one_of_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    lexicon = quality.learn_lexicon(prepare(spark) and docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept_documents(docs, lexicon, quality.CURRENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that with the smallest id."""
    return one_of_similar(docs, similarity=0.8, words_in_shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rate=0.1)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    masked = mask_private(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(masked.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in masked.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", packing),
]

#: SQL can't express tokenisation, fingerprints or edit matching; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of ``documents``; what a stage returns is written and read again for the next."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
