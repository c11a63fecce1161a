"""Scoring span predictions against gold in four regimes, and the comparison grid.

Inputs: ``predictions`` (stage, backend, doc_id, start_char, end_char, entity_type), ``coverage`` (stage, backend,
doc_id: what a cell processed) and ``gold`` (doc_id, start_char, end_char, entity_type).  Only covered documents
count; a cell without coverage rows covers the documents that it has predictions in.  Everything joins on the
document, and no document's spans are collected anywhere but in its own row.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import once

CELL = ["stage", "backend"]
COUNTS = "struct<tp:bigint,fp:bigint,fn:bigint>"


def iou(a: Column, b: Column) -> Column:
    both = F.greatest(F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]), F.lit(0))
    return F.coalesce(F.try_divide(both.cast("double"), (a["e"] - a["s"] + b["e"] - b["s"] - both).cast("double")), F.lit(0.0))


def _sets(p: Column, g: Column) -> Column:
    """Counts over sets."""
    tp = F.size(F.array_intersect(p, g))
    return F.struct(tp.alias("tp"), (F.size(F.array_distinct(p)) - tp).alias("fp"), (F.size(F.array_distinct(g)) - tp).alias("fn")).cast(COUNTS)


def _partial(p: Column, g: Column, theta: float) -> Column:
    """Each gold span in order takes the unused prediction of its type with the largest overlap, the first on a tie."""
    zero = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("tp"))
    numbered = F.transform(p, lambda x, i: F.struct(i.alias("i"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))

    def take(acc: Column, x: Column) -> Column:
        fits = F.filter(numbered, lambda y: (y["t"] == x["t"]) & ~F.array_contains(acc["used"], y["i"]) & (iou(x, y) >= theta))
        best = F.array_max(F.transform(fits, lambda y: F.struct(iou(x, y).alias("v"), (-y["i"]).alias("i"))))
        return F.when(best.isNull(), acc).otherwise(F.struct(F.concat(acc["used"], F.array(-best["i"])).alias("used"), (acc["tp"] + 1).alias("tp")))

    tp = F.aggregate(g, zero, take)["tp"]
    return F.struct(tp.alias("tp"), (F.size(p) - tp).alias("fp"), (F.size(g) - tp).alias("fn")).cast(COUNTS)


def _merged(spans: Column) -> Column:
    """Disjoint ranges in order that cover the same characters."""
    def join(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"]), longer).otherwise(F.concat(acc, F.array(x)))

    plain = F.array_sort(F.transform(F.filter(spans, lambda x: x["e"] > x["s"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    return F.aggregate(plain, F.array().cast("array<struct<s:int,e:int>>"), join)


def _chars(p: Column, g: Column) -> Column:
    """Counts of characters; p and g are merged ranges."""
    length = lambda spans: F.aggregate(spans, F.lit(0), lambda a, x: a + x["e"] - x["s"])
    mp, mg = p, g
    shared = F.aggregate(mp, F.lit(0), lambda a, x: a + F.aggregate(mg, F.lit(0), lambda b, y: b + F.greatest(F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]), F.lit(0))))
    return F.struct(shared.alias("tp"), (length(mp) - shared).alias("fp"), (length(mg) - shared).alias("fn")).cast(COUNTS)


def _per_document(spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    item = F.struct(F.col("start_char").alias("s"), F.col("end_char").alias("e"), F.col("entity_type").alias("t"))
    return spans.groupBy(*keys, "doc_id").agg(F.array_sort(F.collect_list(item)).alias(name))


def document_counts(predictions: DataFrame, coverage: DataFrame, gold: DataFrame, theta: float = 0.5) -> DataFrame:
    """A row per cell and covered document, with the counts of each regime."""
    recorded = coverage.select(*CELL, "doc_id").distinct()
    silent = predictions.select(*CELL, "doc_id").distinct().join(recorded.select(*CELL).distinct(), CELL, "left_anti")
    covered = recorded.unionByName(silent)
    rows = covered.join(_per_document(predictions, CELL, "p"), [*CELL, "doc_id"], "left").join(_per_document(gold, [], "g"), "doc_id", "left")
    return row_counts(rows, theta)


def row_counts(rows: DataFrame, theta: float = 0.5) -> DataFrame:
    """``document_counts`` of rows that hold their spans themselves: stage, backend, doc_id, p and g, arrays of (s, e, t) in order."""
    kind = "array<struct<s:int,e:int,t:string>>"
    rows = once(rows.select(*CELL, "doc_id", *(F.coalesce(c, F.array()).cast(kind).alias(c) for c in ("p", "g"))))
    rows = once(rows.select("*", _merged(F.col("p")).alias("mp"), _merged(F.col("g")).alias("mg")))
    p, g = F.col("p"), F.col("g")
    bare = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    regimes = {"exact": _sets(p, g), "type_agnostic": _sets(bare(p), bare(g)), "partial": _partial(p, g, theta), "char": _chars(F.col("mp"), F.col("mg"))}
    return once(rows.select(*CELL, "doc_id", F.size("g").cast("long").alias("n_gt"), *(c.alias(name) for name, c in regimes.items())))


def f1_columns() -> list[Column]:
    """precision, recall and f1 from tp, fp and fn; 0 where a denominator is."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def evaluate_spans(predictions: DataFrame, coverage: DataFrame, gold: DataFrame, theta: float = 0.5) -> DataFrame:
    """stage, backend, regime, tp, fp, fn, precision, recall, f1, n_docs, n_gt."""
    return totals(document_counts(predictions, coverage, gold, theta))


def totals(counts: DataFrame) -> DataFrame:
    """The sums and scores of documents' counts, by cell and regime."""
    regimes = ["exact", "type_agnostic", "partial", "char"]
    each = counts.select(*CELL, "n_gt", F.explode(F.array(*(F.struct(F.lit(r).alias("regime"), F.col(r).alias("n")) for r in regimes))).alias("x"))
    total = each.groupBy(*CELL, F.col("x.regime").alias("regime")).agg(*(F.sum(f"x.n.{c}").alias(c) for c in ("tp", "fp", "fn")), F.count("*").alias("n_docs"), F.sum("n_gt").alias("n_gt"))
    return total.select(*CELL, "regime", "tp", "fp", "fn", *f1_columns(), "n_docs", "n_gt")


def grid(span_eval: DataFrame, col_eval: DataFrame, perf: DataFrame | None = None) -> DataFrame:
    """One row per stage and backend: column scores, span scores by regime, and costs where they were measured."""
    pick = lambda regime, c, name: F.max(F.when(F.col("regime") == regime, F.col(c))).alias(name)
    spans = span_eval.groupBy(*CELL).agg(
        pick("exact", "precision", "span_exact_prec"), pick("exact", "recall", "span_exact_recall"), pick("exact", "f1", "span_exact_f1"),
        pick("partial", "f1", "span_partial_f1"), pick("type_agnostic", "f1", "span_detect_f1"), pick("char", "recall", "span_char_recall"), F.max("n_docs").alias("span_n_docs"),
    )
    costs = ["latency_p50_ms", "latency_p95_ms", "est_cost_usd_per_1k", "llm_route_rate"]
    if perf is None:
        perf = span_eval.sparkSession.createDataFrame([], "stage string, backend string, " + ", ".join(f"{c} double" for c in costs))
    cells = span_eval.select(*CELL).union(col_eval.select(*CELL)).union(perf.select(*CELL)).distinct()
    columns = col_eval.select(*CELL, F.col("precision").alias("col_precision"), F.col("recall").alias("col_recall"), F.col("f1").alias("col_f1"), F.col("category_acc").alias("col_category_acc"))
    return cells.join(columns, CELL, "left").join(spans, CELL, "left").join(perf.select(*CELL, *costs), CELL, "left")


def offset_mismatches(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Gold spans whose offsets don't cut their value out of the text.

    Here and elsewhere joins of documents with their spans ask for a merge: what Spark guesses of the size of arrays and
    compressed files is too small, and a broadcast would gather the rows of millions of documents on the driver.
    """
    return gold.join(docs.select("doc_id", "text").hint("merge"), "doc_id").filter(F.expr("substring(text, start_char + 1, end_char - start_char) <> pii_value")).drop("text")


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """A checksum that doesn't depend on order: rows are hashed one by one and their digests summed in four parts."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)))
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.agg(F.count("*").alias("n_rows"), F.md5(F.concat_ws("-", *parts)).alias("checksum"))


def overlap_recall(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """n_gold and n_hit: gold spans that any prediction in the same document touches."""
    g = gold.select("doc_id", "start_char", "end_char").distinct()
    p = predictions.select("doc_id", F.col("start_char").alias("ps"), F.col("end_char").alias("pe")).hint("merge")
    hit = g.join(p, (g["doc_id"] == p["doc_id"]) & (p["pe"] > g["start_char"]) & (p["ps"] < g["end_char"]), "left_semi")
    return g.agg(F.count("*").alias("n_gold")).crossJoin(hit.agg(F.count("*").alias("n_hit")))


def gate(champion: dict[str, float], challenger: dict[str, float], delta: float = 0.01, main_floor: float = -0.005, canary_floor: float = -0.01) -> str:
    """PROMOTE if recall on new forms rises by ``delta`` and doesn't fall on the old ones; else KEEP."""
    gain = {k: challenger[k] - champion[k] for k in ("stress", "main", "canary")}
    return "PROMOTE" if round(gain["stress"], 4) >= delta and gain["main"] >= main_floor and gain["canary"] >= canary_floor else "KEEP"


DECISION = "ts timestamp, decision string, champ_stress double, chal_stress double, delta_stress double, main_ok boolean, canary_ok boolean, approved boolean, active_model string"


def decision(champion: dict[str, float], challenger: dict[str, float], approve: bool, champion_model: str, challenger_model: str) -> tuple:
    """A row of the decision log: the challenger becomes active if it passes the gate and a person approved."""
    passed = gate(champion, challenger)
    yes = passed == "PROMOTE" and approve
    gain = {k: challenger[k] - champion[k] for k in champion}
    return datetime.now(), passed, champion["stress"], challenger["stress"], round(gain["stress"], 4), gain["main"] >= -0.005, gain["canary"] >= -0.01, yes, challenger_model if yes else champion_model


def gate_column(d_stress: Column, d_main: Column, d_canary: Column, delta: float = 0.01, main_floor: float = -0.005, canary_floor: float = -0.01) -> Column:
    return F.when((d_stress >= delta) & (d_main >= main_floor) & (d_canary >= canary_floor), "PROMOTE").otherwise("KEEP")


def stage_cost(stage: Column, route_rate: Column, tokens_per_doc: float = 220, usd_per_1k_tokens: float = 0.0006, ner_usd_per_1k: float = 0.01) -> Column:
    """Dollars for a thousand documents: what is routed to the language model, and the entity model's own cost."""
    full = tokens_per_doc / 1000 * usd_per_1k_tokens * 1000
    return route_rate * full + F.when(stage.isin("S3", "S4"), ner_usd_per_1k).otherwise(0.0)


def percentiles(values: DataFrame, group: str, value: str) -> DataFrame:
    """group, p50, p95 by index, as ``percentile_index`` has them, of any number of values.

    Values are counted before anything is sorted, and sorted by Spark, which spills; no group is held in memory.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(value)
    placed = counts.withColumns({"upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy(group))})
    last = F.least(F.col("all"), F.greatest(F.lit(1), F.rint(F.col("all") * 0.95).cast("long"))) - 1
    holds = lambda at: (F.col("upto") - F.col("n") <= at) & (at < F.col("upto"))
    return placed.groupBy(group).agg(F.max(F.when(holds(F.floor(F.col("all") / 2)), F.col(value))).alias("p50"), F.max(F.when(holds(last), F.col(value))).alias("p95"))


def measure_latency(answer: Callable[[list[str]], list], prompts: list[str], serial: int = 10, batch: int = 80) -> dict[str, float]:
    """p50_ms, p95_ms of single calls after one that warms up, and docs_per_s of one batch: what a model costs in time."""
    answer(prompts[:1])
    took = []
    for i in range(serial):
        began = time.perf_counter()
        answer([prompts[i % len(prompts)]])
        took.append((time.perf_counter() - began) * 1000)
    took.sort()
    many = [prompts[i % len(prompts)] for i in range(batch)]
    began = time.perf_counter()
    answer(many)
    return {"p50_ms": took[len(took) // 2], "p95_ms": took[min(len(took), max(1, round(len(took) * 0.95))) - 1], "docs_per_s": batch / (time.perf_counter() - began)}


def percentile_index(latencies: Column) -> Column:
    """``struct<p50, p95>`` of an array, by index in sorted order rather than by interpolation."""
    ordered, n = F.array_sort(latencies), F.size(latencies)
    last = F.least(n, F.greatest(F.lit(1), F.rint(n * 0.95).cast("int")))
    return F.struct(F.get(ordered, F.floor(n / 2).cast("int")).alias("p50"), F.get(ordered, last - 1).alias("p95"))
