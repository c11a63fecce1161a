"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits leaves one of any k + 1 pieces of it untouched.  So each
item is cut into k + 1 pieces, an automaton finds exact hits of all pieces in each text, and only around a hit
the edit distance is computed, with Myers' bit-parallel recurrence: first over two pieces, then over more, and
over the whole item where these bear the hit out.

Texts and items are compared lower-cased with white space runs as one space.  ``k`` is a share of the item's
length.  Items shorter than ``min_chars``, which a few edits would make something else, are matched exactly and as whole
words.  The benchmark is taken in blocks of ``block_chars`` characters, each against all documents; a block takes about
110 bytes a character in each worker (measured), so that the default keeps within 450 MB.

Defined results: null and empty texts and items match nothing; repeated rows give repeated results; null ids are kept; empty tables give
no rows; columns other than ids and texts are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, prepare

MATCHES = "doc_id long, item_id long, edits int, start_char long, end_char long"


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of the normalised text, its place in ``text``; one more at the end."""
    out, pending, seen = [], -1, False
    for m in re.finditer(r"\S+|\s+", text):
        if m[0].isspace():
            pending = m.start() if seen else -1
            continue
        if pending >= 0:
            out.append(pending)
        for i, c in enumerate(m[0]):
            out.extend([m.start() + i] * len(c.lower()))
        seen, pending = True, -1
    return [*out, (out[-1] + 1) if out else 0]


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item cut into k + 1 pieces of nearly equal length, each with its place."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Item:
    """An item's text, error budget and the bit masks of its characters."""

    def __init__(self, number: int, text: str, k: int, whole: bool = False):
        self.number, self.text, self.k, self.whole = number, text, k, whole
        self.edges = [a for a, _ in pieces(text, k)] + [len(text)]
        middles = [(a + b) // 2 for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.halves = [[(x, y, text[x:y]) for x, y in ((a, m), (m, b))] for a, m, b in zip(self.edges, middles, self.edges[1:], strict=False)]
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, window: str, low: int = 0, high: int | None = None) -> tuple[int, int]:
        """Least edit distance between characters [low, high) of the item and any part of ``window``, and where that
        part ends (Myers, 1999)."""
        m = (len(self.text) if high is None else high) - low
        full, top, get = (1 << m) - 1, 1 << (m - 1), self.masks.get
        pv, mv, score, best, end = full, 0, m, m, 0
        for j, c in enumerate(window):
            eq = get(c, 0) >> low & full
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, j + 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | ~(xv | ph) & full
            mv = ph & xv
        return best, end

    def begin(self, window: str, end: int) -> int:
        """Where the best part that ends at ``end`` begins: the same search, backwards."""
        back = Item(0, self.text[::-1], self.k)
        return end - back.search(window[:end][::-1])[1]

    def has_neighbours(self, line: str, piece: int, start: int, a: int, b: int) -> bool:
        """Pieces a to b but for the hit have at most as many edits as they are many: of their halves, as many are untouched."""
        budget = need = b - a - 1
        for p in range(a, b):
            if p != piece:
                for low, high, half in self.halves[p]:
                    if half in line[max(0, start + low - budget) : max(0, start + high + budget)]:
                        need -= 1
                        if not need:
                            return True
        return False

    def bears_out(self, line: str, piece: int, start: int) -> bool:
        """Whether a piece that was hit, with the item beginning at ``start``, can belong to an occurrence.

        Pieces are halved again and again.  Of c pieces with at most c - 1 edits one half, of d pieces, has at most
        d - 1; so on the way from the hit to the whole, all halves around it must fit.  Clean text fails at two pieces.
        """
        a, b = 0, self.k + 1
        halves = []
        while b - a > 2:
            middle = (a + b) // 2
            a, b = (a, middle) if piece < middle else (middle, b)
            if b - a > 1:
                halves.append((a, b))
        if halves and not self.has_neighbours(line, piece, start, *halves[-1]):
            return False
        for a, b in reversed(halves):
            low, high, budget = self.edges[a], self.edges[b], b - a - 1
            # the hit itself is in place; what lies before and after it may have moved by the budget
            if self.search(line[max(0, start + low - budget) : start + high + budget], low, high)[0] > budget:
                return False
        return True


def _joins(a: str, b: str) -> bool:
    """Whether two neighbours belong to one word."""
    return (a.isalnum() or a == "_") and (b.isalnum() or b == "_")


class Matcher:
    """All items of a block, against one text after the other."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = 0):
        import ahocorasick

        self.items, found = [], {}
        for number, text in items:
            item = Item(number, text, int(len(text) * rate) if len(text) >= min_chars else 0, len(text) < min_chars)
            for n, (at, piece) in enumerate(pieces(text, item.k)):
                found.setdefault(piece, []).append((len(self.items), n, at))
            self.items.append(item)
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) in characters of ``text``: each item's best occurrence."""
        if self.empty:
            return []
        line = normalized(text)
        tried, best = set(), {}
        for last, (length, owners) in self.automaton.iter(line):
            for i, n, at in owners:
                item = self.items[i]
                start = last + 1 - length - at
                if item.whole:
                    if i not in best and (not start or not _joins(line[start - 1], line[start])) and (last + 1 == len(line) or not _joins(line[last], line[last + 1])):
                        best[i] = (0, start, last + 1)
                    continue
                # hits on one diagonal, give or take k, share a window; both windows that may hold it are tried
                cell = start // (item.k + 1)
                if (i, cell) in tried or (i in best and best[i][0] == 0):
                    continue
                if not item.bears_out(line, n, start):
                    continue
                tried.add((i, cell))
                begin = max(0, cell * (item.k + 1) - item.k)
                window = line[begin : (cell + 1) * (item.k + 1) + len(item.text) + item.k]
                edits, end = item.search(window)
                if edits <= item.k and (i not in best or edits < best[i][0]):
                    best[i] = (edits, begin + item.begin(window, end), begin + end)
        if not best:
            return []
        where = places(text)
        return [(self.items[i].number, e, where[a], where[b - 1] + 1 if b else 0) for i, (e, a, b) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_chars: int, id_col: str, text_col: str):
    """The benchmark's normalised items, a block of at most about ``block_chars`` characters at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    n_blocks = -(-total // block_chars) if total else 0
    for b in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b) if n_blocks > 1 else items
        block = sorted({(r.item_id, normalized(r.text)) for r in rows.toLocalIterator()}, key=lambda x: (x[0] is None, x))
        if block := [x for x in block if x[1]]:
            yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_chars: int = 40, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds with at most ``rate`` edits per character of the item.

    Each block of the benchmark is broadcast (its size is bounded by ``block_chars``) and all documents are read
    against it.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark, block_chars, item_id_col, item_text_col):
        items = spark.sparkContext.broadcast(block)

        def make(items=items):
            matcher = Matcher(items.value, rate, min_chars)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found, of = [], []
                for r, t in enumerate(batch.column(1).to_pylist()):
                    for m in matcher.matches(t) if t else ():
                        found.append(m)
                        of.append(r)
                columns = list(zip(*found, strict=True)) or [[]] * 4
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.array(of, np.int64))), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                    names=["doc_id", "item_id", "edits", "start_char", "end_char"],
                )

            return step

        part = map_arrow(rows, make, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_chars: int = 40, block_chars: int = 4_000_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark: one pass per block, and no shuffle."""
    spark = prepare(docs.sparkSession)
    at, schema, out = docs.columns.index(text_col), docs.schema, docs
    for block in item_blocks(benchmark, block_chars, item_id_col, item_text_col):
        items = spark.sparkContext.broadcast(block)

        def make(items=items):
            matcher = Matcher(items.value, rate, min_chars)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = batch.column(at).cast(pa.string()).to_pylist()
                return batch.filter(pa.array([not (t and matcher.matches(t)) for t in texts], pa.bool_()))

            return step

        out = map_arrow(out, make, schema)
    return out
