"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule.  A
versioned policy is a mask of the bits that reject, so that applying another version, or asking what each rule
alone costs, needs bit operations over the ledger and no text.

The rule on toxicity has no word list of its own: ``learn_lexicon`` finds, in all labelled documents, the words and
beginnings of words that occur almost only in those labelled toxic, and the ledger counts the words that have one.

Defined results: null and empty texts have no words and fail the rule on length; ids may be null or repeated
(one row each); very long texts are measured whole; an empty table gives an empty ledger; columns other than id
and text are not read.  Labels that are null, or of no document, teach nothing; without labels the lexicon is empty and
its rule never fails.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, map_arrow, prepare, release, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_toxic long"
NAMES = [m.split()[0] for m in MEASURES.split(", ")]
#: Bit i of ``fail_bits`` is rule i; each is SQL over whole numbers, the same in Spark and elsewhere.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "10 * n_upper > 6 * n_letters"),
    ("toxic", "n_toxic >= 2 AND 500 * n_toxic >= n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ["few_words", "repeats"],
    "v1": ["few_words", "repeats", "short_words", "long_words", "symbols", "duplicate_lines", "shouting"],
    "v2": ["few_words", "repeats", "short_words", "long_words", "symbols", "duplicate_lines", "shouting", "toxic"],
}
CURRENT = "v2"


def mask(rules: list[str]) -> int:
    return sum(BIT[r] for r in rules)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, free = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(free, i)
            free = i + 3
    return covered


_upper, _lower = bytes(range(65, 91)), bytes(range(97, 123))
#: A word's parts are the word without these marks around it, and its beginnings of these lengths where it is longer.
MARKS, BEGINNINGS = ".,;:!?\"'()", (4, 5, 6, 7, 8)
#: A part is toxic if so many toxic texts have it, and they are at least this share (in hundredths) of all that have it
#: and ``DOUBT`` more, so that few texts have to agree wholly.  Copies of a text count once.
LEAST_DOCUMENTS, LEAST_SHARE, DOUBT = 5, 70, 2
MEMO = 200_000


def parts(word: bytes) -> list[str]:
    """A lower-cased word and its beginnings, which are marked with a star."""
    w = word.decode().strip(MARKS)
    return [w, *(w[:n] + "*" for n in BEGINNINGS if len(w) > n)]


class Measure:
    """Measures texts, with a lexicon of toxic parts of words."""

    def __init__(self, lexicon: frozenset[str] = frozenset()):
        self.lexicon, self.memo = lexicon, {}
        self.heads = frozenset(p[: BEGINNINGS[0]] for p in lexicon)  # what no part begins with needs no closer look

    def toxic(self, words: list[bytes]) -> int:
        if not self.lexicon:
            return 0
        memo, heads = self.memo, self.heads
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = w.decode().strip(MARKS)[: BEGINNINGS[0]] in heads and not self.lexicon.isdisjoint(parts(w))
        return sum(map(memo.__getitem__, words))

    def __call__(self, text: str) -> tuple[int, ...]:
        """The measurements, in the order of ``MEASURES``."""
        raw = text.encode()
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
        upper, lower = (len(raw) - len(raw.translate(None, x)) for x in (_upper, _lower))
        chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), upper, upper + lower, self.toxic(raw.lower().split())


def part_counts(texts: DataFrame) -> DataFrame:
    """part, n_toxic, n_clean: in how many toxic and other texts (columns text and toxic, 1 or 0) it occurs; counted in each
    task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for n, names in zip(counts, (("n_clean", "n_toxic"), ("n_toxic", "n_clean")), strict=True):
                if n:
                    both = {names[0]: pa.array(n.values(), pa.int64()), names[1]: pa.array([0] * len(n), pa.int64())}
                    yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), both["n_toxic"], both["n_clean"]], names=["part", "n_toxic", "n_clean"])
                n.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({p for w in set(text.encode().lower().split()) for p in parts(w)})
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield from flush()
        yield from flush()

    prepare(texts.sparkSession)
    return texts.select("text", "toxic").mapInArrow(run, "part string, n_toxic long, n_clean long").groupBy("part").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


#: Bits for each labelled text in the filter of ``met``, and the most bits it has (32 MB): more texts make it let more through.
FILTER_BITS, MOST_BITS = 8, 1 << 28


def met(keys: DataFrame, n: int) -> Callable[[Column], Column]:
    """A condition that holds for all of ``n`` whole numbers (column key) and for few others (a Bloom filter of two places a
    number).  Its words are put together by Spark; the driver gets at most ``MOST_BITS``, however many numbers there are."""
    bits = min(MOST_BITS, max(64, 1 << (FILTER_BITS * n - 1).bit_length()))
    places = keys.select(F.explode(F.expr(f"array(key & {bits - 1}L, shiftrightunsigned(key, 32) & {bits - 1}L)")).alias("p"))
    found = places.groupBy(F.expr("shiftright(p, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63L as int)))").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["at"].to_numpy()] = found["word"].to_numpy()
    shared = prepare(keys.sparkSession).sparkContext.broadcast(words.view(np.uint64))

    @F.pandas_udf("boolean")
    def there(key: pd.Series) -> pd.Series:
        k, yes = key.to_numpy(np.int64).view(np.uint64), True
        for p in (k & np.uint64(bits - 1), (k >> np.uint64(32)) & np.uint64(bits - 1)):
            yes = yes & ((shared.value[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return pd.Series(yes)

    return there


def labelled_texts(rows: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """text, toxic: each labelled text once for each label that it has, of ``rows`` (id, text) and ``marks`` (id, toxic); and
    the stored table behind it, to be released.

    Digests meet the labels and one row is chosen for each text; then texts move once, and of those that aren't
    chosen hardly any does.
    """
    hashed = rows.withColumn("h", F.unhex(F.sha2("text", 256))).withColumn("key", F.xxhash64("id", "h"))
    chosen = written(hashed.drop("text", "key").join(marks, "id").groupBy("h", "toxic").agg(F.min("id").alias("id")), "labelled")
    there = met(chosen.select(F.xxhash64("id", "h").alias("key")), chosen.count())
    return hashed.filter(there("key")).drop("key").join(chosen, ["id", "h"]).dropDuplicates(["id", "h", "toxic"]).select("text", "toxic"), chosen


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> frozenset[str]:
    """The toxic parts, from all rows of ``labels`` (doc_id, toxic).

    Texts meet their labels in a join, and parts are judged where they are counted: the driver gets the lexicon alone.
    """
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).filter("text is not null")
    texts, chosen = labelled_texts(rows, marks)
    n = F.col("n_toxic")
    toxic = (n >= LEAST_DOCUMENTS) & (100 * n >= LEAST_SHARE * (n + F.col("n_clean") + DOUBT))
    found = frozenset(r.part for r in part_counts(texts).filter(toxic).select("part").collect())
    release(chosen)
    return found


LEDGER = "ledger"


def measured(df: DataFrame, lexicon: frozenset[str] = frozenset(), text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a struct of measurements in a column of its own, and that column's name: one pass, without a shuffle."""
    columns, book_name = df.columns, free_name(df.columns, LEDGER)
    at = columns.index(text_col)
    kind = pa.struct([(n, pa.int64()) for n in NAMES])
    shared = prepare(df.sparkSession).sparkContext.broadcast(lexicon)

    def make():
        measure = Measure(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t or "") for t in batch.column(at).cast(pa.string()).to_pylist()]
            book = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], fields=list(kind)) if rows else pa.array([], kind)
            return pa.RecordBatch.from_arrays([*batch.columns, book], names=[*columns, book_name])

        return step

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, make, f"{own}, {book_name} struct<{', '.join(m.replace(' ', ':') for m in MEASURES.split(', '))}>"), book_name


def fail_bits(prefix: str = "") -> Column:
    """One bit per rule that fails, each rule evaluated once."""
    named = [re.sub(r"\b(n_\w+|word_chars)\b", rf"{prefix}\1", rule) for _, rule in RULES]
    return F.expr(" + ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, rule in enumerate(named)))


def ledger(df: DataFrame, lexicon: frozenset[str] = frozenset(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, fail_bits: one row per row of ``df``."""
    rows, book = measured(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")), lexicon)
    return rows.select("doc_id", f"{book}.*").withColumn("fail_bits", fail_bits())


def kept_documents(df: DataFrame, lexicon: frozenset[str] = frozenset(), version: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that a policy's version keeps."""
    rows, book = measured(df, lexicon, text_col)
    return rows.filter(passes(fail_bits(f"{book}."), POLICIES[version])).select(*df.columns)


def passes(bits: Column, rules: list[str]) -> Column:
    """Whether none of these rules failed."""
    return bits.bitwiseAND(F.lit(mask(rules))) == 0


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy's version."""
    base = ~passes(F.col("fail_bits"), POLICIES["base"])
    return book.withColumns({"base_failed": base, "kept": ~base & passes(F.col("fail_bits"), POLICIES[version])})


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """What each rule of a policy does: rule, n_failed, n_only (fails this rule of the policy alone), n_kept_without.

    Documents are counted once per distinct bit pattern before anything is shuffled; what follows sees at most
    2 ** len(RULES) rows, whatever the corpus.
    """
    rules = POLICIES[version]
    whole = mask(rules)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    each = patterns.select("bits", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in rules))).alias("r"))
    failed, only = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    kept = only | (F.col("bits") == 0)
    return each.groupBy(F.col("r.rule").alias("rule")).agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for c, name in ((failed, "n_failed"), (only, "n_only"), (kept, "n_kept_without"))))


def oracle_sql() -> str:
    """The ledger under the current policy in DuckDB SQL, written apart from the code above."""
    policy = " OR ".join(f"({rule})" for name, rule in RULES if name in POLICIES[CURRENT])
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))
    return f"""{_book_sql()}
SELECT *, ({bits})::BIGINT AS fail_bits, ({RULES[0][1]}) OR ({RULES[1][1]}) AS base_failed, NOT ({policy}) AS kept FROM m
"""


def _book_sql() -> str:
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    beginnings = " ".join(f"UNION ALL SELECT w, left(s, {n}) || '*' FROM strips WHERE length(s) > {n}" for n in BEGINNINGS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, dense_rank() OVER (ORDER BY text) AS u, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, u, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
said AS (SELECT k, u, doc_id, w, count(*) AS n FROM (SELECT k, u, doc_id, unnest(regexp_extract_all(translate(t, '{capitals}', '{small}'), '[^\\x20\\x09-\\x0D]+')) AS w FROM w) GROUP BY ALL),
strips AS (SELECT w, trim(w, '.,;:!?"''()') AS s FROM (SELECT DISTINCT w FROM said)),
parts AS (SELECT w, s AS p FROM strips {beginnings}),
taught AS (SELECT p, count(DISTINCT u) FILTER (toxic = 1) AS a, count(DISTINCT u) FILTER (toxic = 0) AS b
        FROM said JOIN labels USING (doc_id) JOIN parts USING (w) GROUP BY p),
lexicon AS (SELECT p FROM taught WHERE a >= {LEAST_DOCUMENTS} AND 100 * a >= {LEAST_SHARE} * (a + b + {DOUBT})),
tox AS (SELECT k, sum(n) AS n FROM said WHERE w IN (SELECT w FROM parts JOIN lexicon USING (p)) GROUP BY k),
tri AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY k),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
        coalesce(tox.n, 0)::BIGINT AS n_toxic
      FROM w LEFT JOIN cov ON cov.k = w.k LEFT JOIN tox ON tox.k = w.k)"""


def ablations_sql(version: str = CURRENT) -> str:
    """``ablations`` in DuckDB SQL: each rule is judged over the measurements, not over bits."""
    rules = [(name, rule) for name, rule in RULES if name in POLICIES[version]]
    rows = []
    for name, rule in rules:
        rest = " AND ".join(f"NOT ({r})" for n, r in rules if n != name)
        rows.append(f"SELECT '{name}' AS rule, count(*) FILTER ({rule}) AS n_failed, count(*) FILTER (({rule}) AND {rest}) AS n_only, count(*) FILTER ({rest}) AS n_kept_without FROM m")
    return _book_sql() + "\n" + "\nUNION ALL ".join(rows)
