"""The registered queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ngram, private, quality, warc
from ._common import table
from .decontaminate import contaminated
from .html_text import main_text
from .packing import pack
from .simhash import near_duplicates
from .substrings import dedup_substrings
from .token_counts import token_counts

TOKENIZER = "byte_bpe_50k.json"


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), span=100)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return warc.read_warc(manifest, with_html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.apply_policy(quality.ledger(docs, quality.learn_lexicon(docs, table(spark, sf_dir, "labels"))))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.ablations(quality.ledger(docs, quality.learn_lexicon(docs, table(spark, sf_dir, "labels"))))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=512)


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest(private.find_private(table(spark, sf_dir, "documents")))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.train_and_score(table(spark, sf_dir, "documents"), modulus=7, remainder=2)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), max_bits=2, words_in_shingle=3, seed=42)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), window=2048, end_id=1)


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_warc, op3_quality_rules, op4_html_text, op5_token_counts, op6_private_data, op7_kneser_ney, op8_simhash, op9_decontamination, op10_packing, quality_ablations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.oracle_sql(0), "op3_quality_rules": quality.oracle_sql(), "quality_ablations": quality.ablations_sql()}
