"""Watching without labels: silent detectors, unreadable answers, and rules proposed for new formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import span_items, unreadable
from ..functions.patterns import PATTERNS, STRUCTURED, Pattern
from ..functions.spans import candidates, occurrences, once, overlap, regex_spans, resolved, shape

#: What a repaired rule of each type counts against the built-in ones.
PRIORITY = {"RRN": 8, "ACCOUNT": 7, "CARD": 7, "PHONE": 6, "PASSPORT": 5, "IMEI": 4, "EMAIL": 9}


def silent_rate(docs: DataFrame, rule: DataFrame, model: DataFrame) -> DataFrame:
    """n_docs and n_silent: documents in which the model finds something and the rules nothing."""
    flags = docs.select("doc_id").join(rule.select("doc_id", F.lit(True).alias("r")).distinct().hint("merge"), "doc_id", "left").join(model.select("doc_id", F.lit(True).alias("m")).distinct().hint("merge"), "doc_id", "left")
    return flags.agg(F.count("*").alias("n_docs"), F.count_if(F.col("m").isNotNull() & F.col("r").isNull()).alias("n_silent"))


def parse_fail_rate(answers: DataFrame, column: str = "llm_raw") -> DataFrame:
    """n_answers and n_failed by backend: answers in which no list of spans can be read."""
    read = answers.select("backend", span_items(F.col(column))["ok"].alias("ok"))
    return read.groupBy("backend").agg(F.count("*").alias("n_answers"), F.count_if(~F.col("ok")).alias("n_failed"))


def no_json(answers: DataFrame, column: str = "llm_raw") -> DataFrame:
    """n_failed: answers without any bracket."""
    return answers.agg(F.count_if(unreadable(F.col(column))).alias("n_failed"))


def breach(now: Column, base: Column) -> Column:
    """CRIT, WARN or OK, by how far a rate has risen over its base."""
    return F.when(now > F.greatest(base * 3, F.lit(0.2)), "CRIT").when(now > F.greatest(base * 2, F.lit(0.1)), "WARN").otherwise("OK")


def cosigned(audit: DataFrame, docs: DataFrame) -> DataFrame:
    """Audit spans with whether a pattern span of the same type touches them."""
    rows = audit.join(docs.select("doc_id", regex_spans(F.col("text")).alias("spans")).hint("merge"), "doc_id")
    here = F.struct("start_char", "end_char")
    return rows.withColumn("regex_cosign", F.exists("spans", lambda s: (s["entity_type"] == F.col("entity_type")) & overlap(s, here))).drop("spans")


def calibration(audit: DataFrame, gold: DataFrame, docs: DataFrame, recall_floor: float = 0.90, precision_floor: float = 0.70) -> DataFrame:
    """n_gold, n_audit, n_hit and degraded of the auditor against gold, by offsets, over these documents."""
    within = lambda df: df.join(docs.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select("doc_id", "start_char", "end_char").distinct()
    a, g = within(audit).withColumn("a", F.lit(1)), within(gold).withColumn("g", F.lit(1))
    n = a.join(g, ["doc_id", "start_char", "end_char"], "full").agg(F.count("g").alias("n_gold"), F.count("a").alias("n_audit"), F.count_if(F.col("a").isNotNull() & F.col("g").isNotNull()).alias("n_hit"))
    return n.withColumn("degraded", (F.col("n_hit") < recall_floor * F.col("n_gold")) | (F.col("n_hit") < precision_floor * F.col("n_audit")))


def leaked(silver: DataFrame, rule: DataFrame) -> DataFrame:
    """Silver spans of structured types that the rules didn't find at the same place."""
    return silver.filter(F.col("entity_type").isin(*STRUCTURED)).join(rule.select("doc_id", "start_char", "end_char").distinct().hint("merge"), ["doc_id", "start_char", "end_char"], "left_anti")


def shape_clusters(spans: DataFrame, min_support: int = 2) -> DataFrame:
    """entity_type, shape, support of leaked values: from two on."""
    return spans.groupBy("entity_type", shape(F.col("pii_value")).alias("shape")).agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)


def shape_regex(code: str) -> str:
    """The regular expression of a shape, for whole words; literals are escaped."""
    classes = {"D": "\\d", "L": "[A-Z]", "l": "[a-z]"}
    parts = re.split(r"([DLl]\d+)", code)
    body = "".join(f"{classes[p[0]]}{{{p[1:]}}}" if re.fullmatch(r"[DLl]\d+", p) else re.escape(p) for p in parts if p)
    return rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])"


def proposals(clusters: DataFrame, most: int = 500) -> list[Pattern]:
    """A candidate rule for each cluster, the largest first.  More than ``most`` formats at once are refused: what leaked
    then isn't a new format, and every candidate is matched against all texts."""
    rows = clusters.orderBy(F.desc("support"), "entity_type", "shape").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} shapes of leaked values: raise the support that a cluster needs")
    return [Pattern(r.entity_type, shape_regex(r.shape), PRIORITY.get(r.entity_type, 5), ".") for r in rows]


def shadow(candidates_: list[Pattern], members: DataFrame, drift: DataFrame, clean: DataFrame, clean_gold: DataFrame) -> DataFrame:
    """entity_type, regex, recall_gain, clean_fp, shadow_pass of each candidate: one job over drift and one over clean text.

    Gain: leaked spans (of the candidate's own shape) that patterns with the candidate find exactly.  False
    positives: matches in clean text that aren't gold.
    """
    spark = drift.sparkSession
    ask = [(i, p.entity_type, p.regex) for i, p in enumerate(candidates_)]
    frame = spark.createDataFrame(ask, "i int, entity_type string, regex string")
    # the built-in patterns are matched once for all candidates
    known = once(drift.select("doc_id", "text", candidates(F.col("text")).alias("base")))
    per_doc = F.array(*(F.struct(F.lit(i).alias("i"), resolved(F.concat("base", candidates(F.col("text"), [p]))).alias("spans")) for i, p in enumerate(candidates_))) if candidates_ else F.array().cast("array<struct<i:int,spans:array<struct<start_char:int,end_char:int,entity_type:string>>>>")
    found = known.select("doc_id", F.explode(per_doc).alias("c")).select("doc_id", "c.i", F.explode("c.spans").alias("s"))
    hits = found.select("doc_id", "i", F.col("s.start_char").alias("start_char"), F.col("s.end_char").alias("end_char"), F.col("s.entity_type").alias("entity_type"))
    named = members.join(frame, "entity_type").filter(F.expr("regexp_like(pii_value, concat('^(?:', regex, ')$'))"))
    gain = named.join(hits.hint("merge"), ["doc_id", "i", "start_char", "end_char", "entity_type"], "left_semi").groupBy("i").agg(F.count("*").alias("recall_gain"))
    raw = F.array(*(F.struct(F.lit(i).alias("i"), occurrences(F.col("text"), p.regex).alias("m")) for i, p in enumerate(candidates_))) if candidates_ else F.array().cast("array<struct<i:int,m:array<struct<start:int,value:string>>>>")
    matches = clean.select("doc_id", F.explode(raw).alias("c")).select("doc_id", "c.i", F.explode("c.m").alias("m"))
    places = matches.select("doc_id", "i", F.col("m.start").alias("start_char"), (F.col("m.start") + F.length("m.value")).alias("end_char"))
    false = places.join(clean_gold.select("doc_id", "start_char", "end_char").distinct().hint("merge"), ["doc_id", "start_char", "end_char"], "left_anti").groupBy("i").agg(F.count("*").alias("clean_fp"))
    out = frame.join(gain, "i", "left").join(false, "i", "left").na.fill(0, ["recall_gain", "clean_fp"])
    return out.withColumn("shadow_pass", (F.col("recall_gain") > 0) & (F.col("clean_fp") == 0)).drop("i")


def promoted(shadowed: DataFrame, approve: bool = False, degraded: bool = False) -> DataFrame:
    """With who is promoted: those that passed, if a person approved and the auditor is sound."""
    return shadowed.withColumn("promoted", F.col("shadow_pass") & F.lit(approve and not degraded))


def passing(candidates_: list[Pattern], shadowed: DataFrame) -> list[Pattern]:
    """The candidates that are promoted (their number is bounded by ``proposals``)."""
    yes = {(r.entity_type, r.regex) for r in shadowed.filter("promoted").select("entity_type", "regex").collect()}
    return [p for p in candidates_ if (p.entity_type, p.regex) in yes]


def honesty(drift: DataFrame, gold: DataFrame) -> DataFrame:
    """n_checked, n_missed: structured spans of the new formats, and those that no pattern span touches."""
    found = drift.select("doc_id", regex_spans(F.col("text")).alias("spans"))
    here = F.struct("start_char", "end_char")
    rows = gold.filter(F.col("entity_type").isin(*STRUCTURED)).select("doc_id", "start_char", "end_char").distinct().join(found.hint("merge"), "doc_id")
    return rows.agg(F.count("*").alias("n_checked"), F.count_if(~F.exists("spans", lambda s: overlap(s, here))).alias("n_missed"))


def augmented_spans(text: Column, more: list[Pattern]) -> Column:
    return regex_spans(text, [*PATTERNS, *more])


def repair_recall(drift: DataFrame, gold: DataFrame, more: list[Pattern]) -> DataFrame:
    """n_gold, n_before, n_after: structured gold spans that are found exactly, without and with these rules."""
    places = lambda c: F.transform(c, lambda s: F.struct(s["start_char"].alias("s"), s["end_char"].alias("e")))
    found = drift.select("doc_id", places(regex_spans(F.col("text"))).alias("before"), places(augmented_spans(F.col("text"), more)).alias("after"))
    rows = gold.filter(F.col("entity_type").isin(*STRUCTURED)).select("doc_id", F.struct(F.col("start_char").alias("s"), F.col("end_char").alias("e")).alias("x")).distinct().join(found.hint("merge"), "doc_id")
    return rows.agg(F.count("*").alias("n_gold"), F.count_if(F.array_contains("before", F.col("x"))).alias("n_before"), F.count_if(F.array_contains("after", F.col("x"))).alias("n_after"))


__all__ = ["PRIORITY", "augmented_spans", "breach", "calibration", "candidates", "cosigned", "leaked", "parse_fail_rate", "promoted", "proposals", "repair_recall", "shadow", "shape_clusters", "shape_regex", "silent_rate"]
