"""Routing by confidence: sure entity spans are taken, unsure ones go to a language model, patterns always win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import keep
from ..functions.spans import SPANS, context, merge_spans, none, once, regex_spans
from .providers import LlmProvider, complete_or_fail

TAU = 0.70
ENTITY = "array<struct<start_char:int,end_char:int,entity_type:string,score:double>>"


def route_rate(entities: DataFrame, tau: float = TAU) -> DataFrame:
    """model, n_spans, n_routed: how many spans stand below the threshold."""
    return entities.groupBy("model").agg(F.count("*").alias("n_spans"), F.count_if(F.col("score") < tau).alias("n_routed"))


def keyed(entities: DataFrame) -> DataFrame:
    """Entity spans with a key of document and ordinal, in order of (start, end, type): the same on every run."""
    item = F.struct("start_char", "end_char", "entity_type", "score")
    per = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    rows = per.select("doc_id", F.posexplode("spans").alias("i", "s"))
    return rows.select(F.concat_ws("#", "doc_id", F.col("i").cast("string")).alias("k"), "doc_id", "i", "s.*")


def prompts(entities: DataFrame, docs: DataFrame, tau: float = TAU, width: int = 40) -> DataFrame:
    """k, prompt: a question for each span below the threshold; the text is joined after the filter."""
    low = keyed(entities).filter(F.col("score") < tau)
    rows = low.join(docs.select("doc_id", "text"), "doc_id")
    value = F.expr("substring(text, start_char + 1, end_char - start_char)")
    near = context(F.col("text"), F.col("start_char"), F.col("end_char"), width)
    ask = F.concat(F.lit('Is "'), value, F.lit('" ('), F.col("entity_type"), F.lit(") personal data here: ..."), near, F.lit('... Answer with JSON only: {"keep": true or false}'))
    return rows.select("k", ask.alias("prompt"))


def confirm(entities: DataFrame, docs: DataFrame, provider: LlmProvider, tau: float = TAU, limit: float = 0.05, **options) -> DataFrame:
    """k, keep: a model's decisions on the spans below the threshold; only those are sent.

    Unanswered spans are dropped; more than a share ``limit`` of them fails the step before anything is published.
    """
    asked = complete_or_fail(prompts(entities, docs, tau), "prompt", provider, limit, **options)
    return asked.select("k", keep(F.col("llm_raw")).alias("keep"))


def finalize(docs: DataFrame, entities: DataFrame, decisions: DataFrame, tau: float = TAU) -> DataFrame:
    """doc_id, spans: pattern spans, then entity spans that are sure or kept (k, keep), where they are disjoint.

    An unsure span without a readable decision is dropped.
    """
    marked = keyed(entities).join(decisions.select("k", "keep"), "k", "left")
    chosen = marked.filter((F.col("score") >= tau) | F.coalesce("keep", F.lit(False)))
    item = F.struct("i", "start_char", "end_char", "entity_type", "score")
    per = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("more"))
    rows = docs.select("doc_id", "text").join(per, "doc_id", "left")
    both = once(rows.select("doc_id", "text", regex_spans(F.col("text")).alias("ruled"), with_values(F.col("text"), F.col("more")).alias("more")))
    return both.select("doc_id", "text", merge_spans(F.col("ruled"), F.col("more")).alias("spans"))


def with_values(text: Column, spans: Column) -> Column:
    """Entity spans with the strings that they cover."""
    out = F.transform(spans, lambda s: F.struct(s["start_char"].alias("start_char"), s["end_char"].alias("end_char"), s["entity_type"].alias("entity_type"), F.substring(text, s["start_char"] + 1, s["end_char"] - s["start_char"]).alias("pii_value"), s["score"].alias("score")))
    return F.coalesce(out.cast(SPANS), none())


def entity_label(label: Column) -> Column:
    """A model's label in our vocabulary; null for labels without use."""
    bare = F.regexp_replace(F.upper(label), "^[BI]-", "")
    return F.when(bare.rlike("^(PS|PER)"), "PERSON").when(bare.rlike("^(LC|LOC)"), "ADDRESS")
