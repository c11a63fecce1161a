"""Self-checks: each a row (check, result), so that a report is their union and a failure names itself.

The checks judge stored results by other means than those that made them: counts again from predictions, scores again
from counts, detectors again from texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORIES, STRUCTURED
from ..functions.spans import regex_spans

#: How far stored and recomputed scores may lie apart, and how much of the gold patterns have to find.
COLUMN_TOLERANCE, SPAN_TOLERANCE, LEAST_MATCH = 1e-4, 1e-3, 0.95


def check(name: str, df: DataFrame, passed: Column) -> DataFrame:
    """(check, result) from a frame of one row."""
    return df.select(F.lit(name).alias("check"), F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL").alias("result"))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def legal_categories(truth: DataFrame) -> DataFrame:
    """n_wrong: categories that aren't in the vocabulary; free text has one of its own."""
    return truth.agg(F.count_if(~F.col("category").isin(*CATEGORIES, "FREE_TEXT_PII")).alias("n_wrong"))


def column_scores_again(predictions: DataFrame, truth: DataFrame, stored: DataFrame) -> DataFrame:
    """n_cells, n_wrong: cells whose stored precision, recall or f1 differ from those counted here by sets of columns."""
    hits = lambda df: F.collect_set(F.struct("table_name", "column_name"))
    known = truth.select("table_name", "column_name", "is_pii")
    said = predictions.join(known, ["table_name", "column_name"])
    yes = said.filter("pred_is_pii").groupBy("stage", "backend").agg(hits(said).alias("p"))
    gold = said.filter("is_pii").groupBy("stage", "backend").agg(hits(said).alias("g"))
    cells = said.select("stage", "backend").distinct().join(yes, ["stage", "backend"], "left").join(gold, ["stage", "backend"], "left")
    empty = F.array().cast("array<struct<table_name:string,column_name:string>>")
    p, g = F.coalesce("p", empty), F.coalesce("g", empty)
    tp, np_, ng = F.size(F.array_intersect(p, g)).cast("double"), F.size(p).cast("double"), F.size(g).cast("double")
    again = cells.select("stage", "backend", F.try_divide(tp, np_).alias("p2"), F.try_divide(tp, ng).alias("r2"), F.try_divide(2 * tp, np_ + ng).alias("f2"))
    both = again.join(stored.select("stage", "backend", "precision", "recall", "f1"), ["stage", "backend"], "left")
    apart = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > COLUMN_TOLERANCE, F.col(a).isNull() != F.col(b).isNull())
    return both.agg(F.count("*").alias("n_cells"), F.count_if(apart("precision", "p2") | apart("recall", "r2") | apart("f1", "f2")).alias("n_wrong"))


def span_identities(span_eval: DataFrame, predictions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rows of the evaluation with what is wrong in them: gold_ok (tp + fn is all gold), said_ok (exact: tp + fp is all
    that was said of covered documents), scores_ok (precision, recall and f1 follow from the counts)."""
    keys = ["stage", "backend"]
    said = predictions.select(*keys, "doc_id", "start_char", "end_char", "entity_type").distinct().join(coverage.select(*keys, "doc_id").distinct().hint("merge"), [*keys, "doc_id"], "left_semi").groupBy(*keys).agg(F.count("*").alias("n_said"))
    rows = span_eval.join(said, keys, "left")
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    near = lambda c, x: F.abs(F.col(c) - x) <= SPAN_TOLERANCE
    return rows.select(
        *keys, "regime", ((F.col("regime") == "char") | (F.col("tp") + F.col("fn") == F.col("n_gt"))).alias("gold_ok"),
        ((F.col("regime") != "exact") | (F.col("tp") + F.col("fp") == F.coalesce("n_said", F.lit(0)))).alias("said_ok"), (near("precision", p) & near("recall", r) & near("f1", f)).alias("scores_ok"),
    )


def regex_against_gold(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """n_gold, n_matched, n_spurious: pattern spans, found again, against the gold of that layer."""
    key = ["doc_id", "start_char", "end_char", "entity_type"]
    found = docs.select("doc_id", F.explode(regex_spans(F.col("text"))).alias("s")).select("doc_id", "s.start_char", "s.end_char", "s.entity_type").filter(F.col("entity_type").isin(*STRUCTURED)).distinct().withColumn("p", F.lit(1))
    both = found.join(gold.filter("source_layer = 'PATTERN'").select(*key).distinct().withColumn("g", F.lit(1)), key, "full")
    return both.agg(F.count("g").alias("n_gold"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("n_matched"), F.count_if(F.col("g").isNull()).alias("n_spurious"))


def monotone(grid: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """f1_first, f1_second: the exact scores of two cells."""
    of = lambda cell: F.max(F.when((F.col("stage") == cell[0]) & (F.col("backend") == cell[1]), F.col("span_exact_f1")))
    return grid.agg(of(first).alias("f1_first"), of(second).alias("f1_second"))
