"""Span algebra as Catalyst expressions.

A span is a half-open range of code points with its type: arrays of
``struct<start_char, end_char, entity_type, pii_value, score>``, one array per document, in order of start.  Nothing
here is a Python function over rows; arrays hold the spans of one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import PATTERNS, TYPE_NAMES, Pattern

SPAN = "struct<start_char:int,end_char:int,entity_type:string,pii_value:string,score:double>"
SPANS = f"array<{SPAN}>"
CANDIDATE = "struct<start_char:int,end_char:int,entity_type:string,pii_value:string,score:double,priority:int>"


def once(df: DataFrame) -> DataFrame:
    """``df``, evaluated once per row however often columns are used above: projections don't merge through a generator."""
    return df.select(F.explode(F.array(F.struct(*(F.col(c) for c in df.columns)))).alias("__row")).select("__row.*")


def none(kind: str = SPANS) -> Column:
    """An empty array of spans."""
    return F.array().cast(kind)


def overlap(a: Column, b: Column) -> Column:
    return (a["end_char"] > b["start_char"]) & (a["start_char"] < b["end_char"])


def span(start: Column, end: Column, entity_type: Column, value: Column, score: Column) -> Column:
    return F.struct(start.cast("int").alias("start_char"), end.cast("int").alias("end_char"), entity_type.alias("entity_type"), value.alias("pii_value"), score.cast("double").alias("score"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used: lambda variables are."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of a block of running totals; up to ``FEW`` elements aren't worth it.
BLOCK, FEW = 64, 32


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of whole numbers, all those before it joined (0 before the first).

    Totals of blocks come first, then what lies before each within its block.  (Spark copies an aggregation's
    accumulator at every step, so that gathering an array in it would take quadratic time.)
    """
    fold = lambda part: F.aggregate(part, F.lit(0), join)

    def within(x: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: fold(F.slice(x, i * BLOCK + 1, F.lit(BLOCK))))
        starts = let(totals, lambda t: F.transform(t, lambda _, i: fold(F.slice(t, F.lit(1), i))))
        return let(starts, lambda at: F.transform(x, lambda _, i: join(F.get(at, F.floor(i / BLOCK).cast("int")), fold(F.slice(x, i - i % BLOCK + 1, i % BLOCK)))))

    return let(values, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(within(x)))


def occurrences(text: Column, regex: str | Column) -> Column:
    """Matches with offsets in code points: ``array<struct<start, value>>``.

    The strings between matches give the offsets; regular expression positions count UTF-16 units and wouldn't do.
    Few matches are placed one after the other, many by running totals: with the same result.
    """
    kind = "array<struct<start:int,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + F.length(x["value"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["value"].alias("value")))).alias("out"))

    pattern = F.lit(regex) if isinstance(regex, str) else regex
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def place(values: Column) -> Column:
        pairs = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
        few = lambda p: F.aggregate(p, zero, add)["out"]
        return let(pairs, lambda p: F.when(F.size(p) <= FEW, few(p)).otherwise(many(p)))

    def many(p: Column) -> Column:
        return F.zip_with(p, running(F.transform(p, lambda x: x["gap"] + F.length(x["value"])), lambda a, n: a + n), lambda x, at: F.struct((at + x["gap"]).alias("start"), x["value"].alias("value")))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(found, lambda v: F.when(F.size(v) == 0, F.array().cast(kind)).otherwise(place(v)))


def candidates(text: Column, patterns: Iterable[Pattern] = PATTERNS) -> Column:
    """All matches of all patterns, with priorities; a pattern runs where its guard holds.

    The patterns that run are an array, so that matching is one expression, however many patterns there are.
    """
    kind = "struct<regex:string,entity_type:string,priority:int>"

    def run(p: Pattern) -> Column:
        there = text.contains(p.guard) if p.guard == "@" else text.rlike(p.guard)
        return F.when(there, F.struct(F.lit(p.linear or p.regex).alias("regex"), F.lit(p.entity_type).alias("entity_type"), F.lit(p.priority).alias("priority")))

    def found(p: Column) -> Column:
        def candidate(m: Column) -> Column:
            return F.struct(m["start"].alias("start_char"), (m["start"] + F.length(m["value"])).alias("end_char"), p["entity_type"].alias("entity_type"), m["value"].alias("pii_value"), F.lit(1.0).alias("score"), p["priority"].alias("priority"))

        return F.transform(occurrences(text, p["regex"]), candidate)

    ready = F.filter(F.array(*(run(p) for p in patterns)).cast(f"array<{kind}>"), lambda p: p.isNotNull())
    return F.flatten(F.transform(ready, found))


def by_overlap(found: Column) -> Column:
    """Candidates in order of start as ``struct<alone, x>``: ``alone`` if no other candidate overlaps it."""

    def mark(x: Column) -> Column:
        ends = running(F.transform(x, lambda c: c["end_char"]), lambda a, n: F.greatest(a, n))
        begins = F.zip_with(x, ends, lambda c, end: c["start_char"] >= end)
        return let(begins, lambda b: F.transform(x, lambda c, i: F.struct((F.get(b, i) & F.coalesce(F.get(b, i + 1), F.lit(True))).alias("alone"), c.alias("x"))))

    return let(F.array_sort(found), mark)


def keep_disjoint(ordered: Column, kind: str = CANDIDATE) -> Column:
    """Greedy choice in the order given: a span stays if it overlaps none that stayed before."""
    merge = lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.when(F.size(ordered) <= 1, ordered).otherwise(F.aggregate(ordered, none(f"array<{kind}>"), merge))


def by_start(spans: Column) -> Column:
    """Spans in order of start, without what isn't part of a span."""
    plain = F.transform(spans, lambda s: span(s["start_char"], s["end_char"], s["entity_type"], s["pii_value"], s["score"]))
    return F.array_sort(plain)


def resolved(found: Column) -> Column:
    """Spans out of candidates: of overlapping ones the larger priority stays, then the longer, then the first.

    Of many, those that overlap no other stay at once, and only the rest are compared with each other.
    """
    first = lambda a, b: F.coalesce(
        F.nullif(b["priority"] - a["priority"], F.lit(0)),
        F.nullif((b["end_char"] - b["start_char"]) - (a["end_char"] - a["start_char"]), F.lit(0)),
        a["start_char"] - b["start_char"],
    )
    pick = lambda marked, alone: F.transform(F.filter(marked, lambda m: m["alone"] == alone), lambda m: m["x"])
    settle = lambda marked: F.concat(pick(marked, F.lit(True)), keep_disjoint(F.array_sort(pick(marked, F.lit(False)), first)))
    many = lambda f: let(by_overlap(f), settle)
    return by_start(let(found, lambda f: F.when(F.size(f) <= 1, f).when(F.size(f) <= FEW, keep_disjoint(F.array_sort(f, first))).otherwise(many(f))))


def regex_spans(text: Column, patterns: Iterable[Pattern] = PATTERNS) -> Column:
    """Pattern spans of a text, disjoint (see ``resolved``)."""
    return resolved(F.coalesce(candidates(text, patterns), none(f"array<{CANDIDATE}>")))


def norm_type(name: Column) -> Column:
    """A model's name for a type in our vocabulary; unknown names stay, in upper case."""
    clean = F.upper(F.regexp_replace(name, r"^\s+|\s+$", ""))
    names = F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv))
    return F.when(name.isNull() | (name == ""), F.lit("UNKNOWN")).otherwise(F.coalesce(F.try_element_at(names, clean), clean))


def first_free(text: Column, value: Column, taken: Column) -> Column:
    """The 0-based place where ``value`` first occurs without touching ``taken``; null if nowhere.  One pass over the text."""
    literal = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    free = F.filter(occurrences(text, literal), lambda m: ~F.exists(taken, lambda t: (t["start_char"] < m["start"] + F.length(value)) & (t["end_char"] > m["start"])))
    return F.try_element_at(free, F.lit(1))["start"]


def recover_spans(text: Column, items: Column, score: float = 0.8) -> Column:
    """Offsets for strings that a model says it found (``array<struct<value,type>>``): longest first, each at its
    first free occurrence; strings that don't occur are dropped."""
    usable = F.filter(F.coalesce(items, F.array().cast("array<struct<value:string,type:string>>")), lambda x: F.coalesce(x["value"] != "", F.lit(False)))
    order = F.transform(usable, lambda x, i: F.struct((-F.length(x["value"])).alias("n"), i.alias("i"), x["value"].alias("value"), x["type"].alias("type")))

    def place(acc: Column, x: Column) -> Column:
        at = first_free(text, x["value"], acc)
        found = span(at, at + F.length(x["value"]), norm_type(x["type"]), x["value"], F.lit(score))
        return F.when(at.isNull(), acc).otherwise(F.concat(acc, F.array(found)))

    return F.array_sort(F.aggregate(F.array_sort(order), none(), place))


def merge_spans(kept: Column, more: Column) -> Column:
    """All of ``kept``, and those of ``more``, in turn, that overlap nothing accepted so far."""
    add = lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_sort(F.aggregate(more, kept, add))


def mask_spans(text: Column, spans: Column, tokens: dict[str, str], default: str = "[PII]") -> Column:
    """The text with each (disjoint) span replaced by its type's token."""
    names = F.create_map(*(F.lit(x) for kv in tokens.items() for x in kv))
    ordered = F.array_sort(spans)

    def part(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get(ordered, i - 1)["end_char"], F.lit(0))
        return F.concat(F.substring(text, at + 1, s["start_char"] - at), F.coalesce(F.try_element_at(names, s["entity_type"]), F.lit(default)))

    last = F.coalesce(F.try_element_at(ordered, F.lit(-1))["end_char"], F.lit(0))
    return F.concat(F.array_join(F.transform(ordered, part), ""), F.substring(text, last + 1, F.length(text)))


def context(text: Column, start: Column, end: Column, width: int = 40) -> Column:
    """The text around a span."""
    low = F.greatest(start - width, F.lit(0))
    return F.substring(text, low + 1, end + width - low)


def shape(value: Column) -> Column:
    """Run-length classes: digits D, capitals L, small letters l, each with its length; other runs as they are."""
    runs = F.regexp_extract_all(value, F.lit(r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+"), F.lit(0))

    def code(run: Column) -> Column:
        kind = F.when(run.rlike("^[0-9]"), "D").when(run.rlike("^[A-Z]"), "L").when(run.rlike("^[a-z]"), "l")
        return F.coalesce(F.concat(kind, F.length(run).cast("string")), run)

    return F.array_join(F.transform(runs, code), "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass the Luhn check; false without digits."""
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    each = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: d.cast("int") * (1 + i % 2))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))
    return F.coalesce((F.size(each) > 0) & (total % 10 == 0), F.lit(False))
