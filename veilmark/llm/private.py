"""Personal data in texts, by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these, and long hexadecimal strings as
secrets, are the seeds.  The same pass notes every string that looks like an identifier, with the words before it.
A pattern is the words before an identifier, whatever its form; patterns and instances make a graph, in which
Spark scores both in turn: a pattern by the instances believed to be of one kind against those that contradict it
(seeds of other kinds, and dates and decimal numbers, which are known not to be identifiers), an instance by its best
patterns.  Instances of which nothing is known weigh ``UNKNOWN`` of a contradiction.  Patterns that end above
``accept``, with enough distinct believed instances, then yield further identifiers wherever they occur.

The graph has a row per distinct (pattern, instance), aggregated before it is shuffled; a pattern that very many
identifiers share is many rows, never one.

A pattern needs ``min_instances`` believed instances (5), so a corpus with fewer identifiers in one context gives base
spans and secrets after credential words alone.  Contexts are taken from the ``CONTEXT_CHARS`` characters before a
string (80): a label that stands further away, or words longer than that, don't count.

Defined results: a null or empty text has no spans; repeated rows have theirs each; null ids are kept; very long
texts are read whole; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, map_arrow, release, written

#: Kinds in the order in which spans at one place are listed; those after the first four come from the method alone.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

#: The base patterns.  A match of digits begins at the first of its run and takes the run whole, so nothing
#: is tried twice and the time is linear in the text.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Strings that look like identifiers: at least six characters, a digit among them.
RUN = re.compile(r"[A-Za-z0-9._@+/=-]{6,}+")
FIRST, LEAST = re.compile(r"[A-Za-z0-9]"), 6
#: Groups of digits with single blanks, dots, hyphens or brackets between, and account numbers written in blocks.
GROUPS = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|(?:\([0-9]{1,6}\)|[0-9]{1,6})(?:[\x20./-]?\([0-9]{1,6}\)|(?:(?<=\))|[\x20./-])\x20?[0-9]{1,6})+)(?![A-Za-z0-9])")
GROUP_DIGITS = range(7, 25)
#: Known not to be identifiers: dates, with or without a time, times, ranges of years, decimal numbers.
NOT = re.compile(r"(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?:[T\x20][0-9.]+Z?)?|(?:1[5-9]|20)[0-9]{2}[-/](?:1[5-9]|20)[0-9]{2}|[0-9]+\.[0-9]+")
NONE, UNKNOWN = "none", 0.1
SECRET = re.compile(r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,}")
HEX = re.compile(rf"(?<![A-Za-z0-9]){SECRET.pattern}(?![A-Za-z0-9])")
#: A long hexadecimal string after one of these words, with marks and at most two short words between, is a secret at once.
CREDENTIAL = re.compile(r"(?i)(?:api[_ -]?key|access[_ -]?key|secret|token|passw(?:or)?d|passphrase|credentials?|bearer|private[_ -]?key|authorization|key)s?[\"']?(?:\s+(?:is|was|of|for|the|bearer|basic|value)){0,2}[\s:=\"'>`(\[]{0,6}$")
WORD = re.compile(r"\w+|[^\w\s]")
CONTEXT_CHARS, CONTEXT_WORDS, START = 80, 3, "^^"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of the address pattern, leftmost and non-overlapping, found from each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text) if "." in text else ():
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def contexts(text: str, start: int) -> list[str]:
    """The two and the three words and marks before a place, if one of them is a word; digits are made equal.

    The start of the text is a mark.
    """
    before = text[max(0, start - CONTEXT_CHARS) : start]
    words = [DIGIT.sub("0", w.lower()) for w in WORD.findall(before)]
    words = [*([START] if start <= CONTEXT_CHARS else []), *words][-CONTEXT_WORDS:]
    return [" ".join(words[-n:]) for n in range(2, len(words) + 1) if any(w.isalpha() for w in words[-n:])]


def runs(text: str) -> list[tuple[int, int]]:
    """Strings of letters, digits and a few marks that begin with a letter or digit, end so or with =, and hold a digit."""
    out = []
    for m in RUN.finditer(text):
        first = FIRST.search(text, m.start(), m.end())
        if first and DIGIT.search(text, first.start(), m.end()):
            end = m.start() + len(m[0].rstrip("._@+/-"))
            if end - first.start() >= LEAST:
                out.append((first.start(), end))
    return out


def found_by(pattern: re.Pattern | None, text: str) -> list[tuple[int, int]]:
    return runs(text) if pattern is None else [m.span() for m in pattern.finditer(text)]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int]]:
    """(kind if a seed, start, end): base spans and all other strings that look like identifiers, outside of them.

    Strings known not to be identifiers are seeds of kind ``NONE``.
    """
    out: list[tuple[str | None, int, int]] = list(base)
    if DIGIT.search(text):
        taken = sorted((a, b) for _, a, b in base)
        for pattern in (HEX, GROUPS, None):
            i, new = 0, []
            for start, end in found_by(pattern, text):
                value = text[start:end]
                if pattern is GROUPS and not value[0].isalpha() and len(NOT_DIGIT.sub("", value)) not in GROUP_DIGITS:
                    continue
                while i < len(taken) and taken[i][1] <= start:
                    i += 1
                if i < len(taken) and taken[i][0] < end:
                    continue
                new.append((start, end))
                out.append(("secret" if SECRET.fullmatch(value) else NONE if NOT.fullmatch(value) else None, start, end))
            taken = sorted(taken + new)
    return out


FOUND = "doc_id long, tell long, base array<struct<kind:string,start:int,end:int>>, seen array<struct<kind:string,start:int,end:int,value:long,sure:boolean,contexts:array<string>>>"


def scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: base spans, and identifier-like strings with their contexts."""

    def make():
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        seen = pa.struct([*span, ("value", pa.int64()), ("sure", pa.bool_()), ("contexts", pa.list_(pa.string()))])

        import xxhash

        def number(value: str) -> int:
            h = xxhash.xxh64_intdigest(value.encode())
            return h - (1 << 64) if h >> 63 else h

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bases, others = [], []
            for text in batch.column(2).to_pylist():
                base = base_spans(text) if text else []
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                others.append([{"kind": k, "start": a, "end": b, "value": number(text[a:b]), "sure": k == "secret" and bool(CREDENTIAL.search(text[max(0, a - CONTEXT_CHARS) : a])), "contexts": contexts(text, a)} for k, a, b in candidates(text, base)] if text else [])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bases, pa.list_(span)), pa.array(others, pa.list_(seen))], names=["doc_id", "tell", "base", "seen"])

        return step

    text = df[text_col].cast("string")
    return map_arrow(df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("tell"), text.alias("text")), make, FOUND)


def graph(found: DataFrame) -> DataFrame:
    """pattern, instance, kind (of seeds, else null): a row per distinct pattern and instance."""
    seen = found.select(F.explode("seen").alias("s"))
    edges = seen.select(F.explode("s.contexts").alias("pattern"), F.col("s.value").alias("instance"), F.col("s.kind").alias("kind"))
    return edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def scored_patterns(edges: DataFrame, rounds: int = 3, min_instances: int = 5, accept: float = 0.8) -> DataFrame:
    """pattern, kind, n, score of the accepted patterns.

    Beliefs in instances begin with the seeds.  Each round scores a pattern for a kind by the sum of its instances'
    beliefs over that of all kinds, with ``UNKNOWN`` for each instance that has no belief and 1 against chance, and
    gives an instance that isn't a seed the belief 1 - prod(1 - score) over its patterns that stand above ``accept``.
    """
    first = edges.filter("kind is not null").select("instance", "kind").distinct().withColumn("belief", F.lit(1.0))
    beliefs, seeds = first, first.select("instance").distinct()
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= min_instances)
    links = edges.select("pattern", "instance")
    accepted = None
    for _ in range(rounds):
        mass = links.join(beliefs.hint("shuffle_hash"), "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.count("*").alias("known"))
        every = mass.groupBy("pattern").agg(F.sum("mass").alias("total"), F.sum("known").alias("known"))
        against = F.col("total") + UNKNOWN * F.greatest(F.col("n") - F.col("known"), F.lit(0)) + 1
        scored = mass.drop("known").filter((F.col("mass") >= min_instances) & (F.col("kind") != NONE)).join(every.hint("shuffle_hash"), "pattern").join(sizes.hint("shuffle_hash"), "pattern")
        accepted = scored.withColumn("score", F.col("mass") / against).filter(F.col("score") >= accept).select("pattern", "kind", "n", "score")
        accepted = written(accepted, "patterns")
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score"))))
        others = links.join(accepted.select("pattern", "kind", "score").hint("shuffle_hash"), "pattern").join(seeds.hint("shuffle_hash"), "instance", "left_anti")
        learned = others.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("belief"))
        beliefs = written(first.unionByName(learned), "beliefs")
    return accepted


def find_private(df: DataFrame, rounds: int = 3, min_instances: int = 5, accept: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tell (a hash of the text), base and spans (arrays of kind, start, end): the base spans, and all spans.

    Where several kinds claim one string the best score wins, then the kind listed first.
    """
    found = written(scanned(df, id_col, text_col), "found")
    edges = written(graph(found), "graph")
    patterns = scored_patterns(edges, rounds, min_instances, accept)
    release(edges)
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    rank = F.struct(F.col("score"), -order, F.col("kind"))
    seen = found.select("doc_id", "tell", F.explode("seen").alias("s")).select("doc_id", "tell", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("seed"), F.explode("s.contexts").alias("pattern"))
    sure = found.select("doc_id", "tell", F.explode(F.filter("seen", lambda s: s["sure"])).alias("s")).select("doc_id", "tell", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), F.lit(1.0).alias("score"))
    # of a base kind each seed is a base span already; secrets count as found once a pattern or a credential word bears them out
    fresh = seen.filter(F.col("seed").isNull() | (F.col("seed") == "secret")).join(patterns, "pattern").select(*sure.columns).unionByName(sure)
    best = fresh.groupBy("doc_id", "tell", "start", "end").agg(F.max(rank).alias("r")).select("doc_id", "tell", F.struct(F.col("r.kind").alias("kind"), "start", "end").alias("span"))
    more = best.groupBy(F.col("doc_id").alias("m_id"), F.col("tell").alias("m_tell")).agg(F.collect_list("span").alias("more"))
    both = found.select("doc_id", "tell", "base").join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tell") == F.col("m_tell")), "left")
    spans = F.concat("base", F.coalesce("more", F.expr("array()").cast("array<struct<kind:string,start:int,end:int>>")))
    place = lambda k: F.array_position(F.array(*(F.lit(x) for x in KINDS)), k)
    spans = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((place(a["kind"]) - place(b["kind"])).cast("int")))
    return both.select("doc_id", "tell", "base", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of spans that reports carry."""
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, and spans that overlap it, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_private(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with all personal data in its text replaced; other columns, and rows without a text, stay as they are."""
    own = [free_name(df.columns, x) for x in ("m_id", "m_tell", "m_spans")]
    found = find_private(df, id_col=id_col, text_col=text_col, **options).filter("size(spans) > 0").select("doc_id", "tell", "spans").toDF(*own)
    found = found.dropDuplicates(own[:2])
    same = df[id_col].cast("long").eqNullSafe(found[own[0]]) & (F.xxhash64(df[text_col].cast("string")) == found[own[1]])
    both = df.join(found.hint("shuffle_hash"), same, "left").drop(*own[:2])
    names, at = df.columns, df.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(batch.columns)
            spans = columns.pop().to_pylist()
            rows = zip(columns[at].to_pylist(), spans, strict=True)
            columns[at] = pa.array([t if t is None or not s else masked(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in rows], pa.string())
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    return map_arrow(both, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
