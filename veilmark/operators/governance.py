"""Governance without a catalogue: a registry of column policies, secured views, and masked text.

The registry is a DataFrame (table_name, column_name, category, risk, mask).  Views enforce it; whoever reads the
files themselves goes round it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import apply_mask, mask_for, mask_of, risk
from ..functions.patterns import MASK_TOKENS
from ..functions.spans import mask_spans

#: Columns of free text, which are masked by span.
FREE_TEXT = ("memo", "consult_note", "complaint_body", "review_text")


def policies(verdicts: DataFrame, free_text: tuple[str, ...] = FREE_TEXT) -> DataFrame:
    """The registry that verdicts (table_name, column_name, pred_is_pii, pred_category) call for; free text is masked by span."""
    hit = verdicts.filter(F.col("pred_is_pii") & ~F.col("column_name").isin(*free_text))
    return hit.select("table_name", "column_name", F.col("pred_category").alias("category"), risk(F.col("pred_category")).alias("risk"), mask_of(F.col("column_name")).alias("mask"))


def unapplied(registry: DataFrame, table: str | None = None) -> DataFrame:
    """The registry without a table's policies, or without any."""
    return registry.filter(F.lit(False)) if table is None else registry.filter(F.col("table_name") != table)


def secured(df: DataFrame, columns: list[str], privileged: bool = False) -> DataFrame:
    """``df`` with these columns masked, each by the mask that its name calls for."""
    return df.select(*(apply_mask(mask_for(c), F.col(c).cast("string"), privileged).alias(c) if c in columns else F.col(c) for c in df.columns))


def assert_unmasked(registry: DataFrame, tables: list[str], privileged: bool) -> None:
    """Refuse to sample tables that are masked for the caller: the samples would be of masks."""
    if not privileged and not registry.filter(F.col("table_name").isin(*tables)).isEmpty():
        raise PermissionError("columns of these tables are masked; unapply the policies or use a privileged caller")


def masked_corpus(found: DataFrame) -> DataFrame:
    """doc_id, original, masked of documents with disjoint spans (doc_id, text, spans)."""
    return found.select("doc_id", F.col("text").alias("original"), mask_spans(F.col("text"), F.col("spans"), MASK_TOKENS).alias("masked"))


def mask_audit(found: DataFrame) -> DataFrame:
    """A row per masked span."""
    token = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MASK_TOKENS.items() for x in kv)), F.col("s.entity_type")), F.lit("[PII]"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start_char", "s.end_char", "s.entity_type", token.alias("masked_token"))


def residual_leaks(masked: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold values that can still be read; two characters are enough for names and places, else four."""
    readable = F.expr("locate(pii_value, masked) > 0")
    long = (F.length("pii_value") >= 4) | (F.col("entity_type").isin("PERSON", "ADDRESS") & (F.length("pii_value") >= 2))
    return masked.join(gold.hint("merge"), "doc_id").filter(readable & long).select("doc_id", "start_char", "end_char", "entity_type", "pii_value")


def require(condition: bool, message: str) -> None:
    """Fail before anything is published."""
    if not condition:
        raise ValueError(message)


def fail_closed(df: DataFrame, bad: Column, limit: float, message: str) -> DataFrame:
    """``df``, after making sure that at most a share ``limit`` of its rows is bad."""
    n = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    require(n.bad <= n.n * limit, f"{message}: {n.bad} of {n.n}")
    return df
