"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by workers.

The model is of bigrams over words, continued to unigrams by how many words a word follows, and to a uniform share
for the unknown.  Three passes over the training texts and one over all texts:

1. Words are counted by 64-bit hash.  Each shard of hashes writes its sorted hashes and counts; a word's number is
   its rank in that order, over all shards.
2. Pairs of numbers are counted, merged in each task before they are moved, to the shard of their first word's
   range of numbers.  Words that make a large part of all tokens (at most ``1 / HOT`` of them) are dealt out by
   their second word as well.  Each shard writes its sorted pairs with counts and, for its range, each first word's
   total and the numbers of its pairs with count 1, 2 and 3 or more.
3. From the distinct pairs each word's continuation count is summed, by ranges of the second word.
4. Workers map these arrays and score texts; discounts come from the counts of counts.

Everything lies in the shared folder as flat arrays, named by shard; no worker holds the model, and none keeps more
than a few arrays open: look-ups are sorted and go shard by shard.  A pair is one 64-bit number, so more than
``LIMIT`` distinct words are refused.

Defined results: a null or empty text is its end alone; a null id is a training document; repeated rows count each
time; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh_dir, prepare, release, written
from .arrays import by_shard, deltas, expand, find, merge_counts, open_array, squeeze, write_array

#: The end of a text as a token: white space, so that no word is equal to it.
END = b" "
SEED = 42
#: A first word with more than this share of all tokens has its pairs dealt out over all shards.
HOT = 1e-3
#: Distinct words, and pairs, that a task holds before it hands on their counts.
WORDS_HELD, PAIRS_HELD = 400_000, 3_000_000
MEMO = 400_000
PAIR = np.uint64(32)
LIMIT = (1 << 32) - 2


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, SEED)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether the document is kept out of training, by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == remainder, F.lit(False))


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])


def word_counts(train: DataFrame, n_shards: int) -> DataFrame:
    """shard, blob: hashes and counts of words, merged within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.array([word_hash(w) for w in counts], np.uint64)
            order = np.argsort(keys)
            keys, n = keys[order], np.fromiter(counts.values(), np.uint64, len(counts))[order]
            shard = hash_shard(keys, n_shards)
            edges = np.searchsorted(shard, np.arange(n_shards + 1))
            yield _rows([(s, squeeze(deltas(keys[a:b]), n[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text.encode().lower().split())
                if len(counts) > WORDS_HELD:
                    yield from flush()
                    counts = Counter()
            counts[END] += batch.num_rows
        if counts:
            yield from flush()

    return train.mapInArrow(run, "shard int, blob binary")


def hash_shard(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard of a hash: n equal ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def vocabulary(counted: DataFrame, n_shards: int, base: str) -> DataFrame:
    """shard, n_words, n_tokens, top and top_counts (number in the shard and count of its frequent words); writes keys and counts."""

    def step(shard: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [expand(b, "<u8", "<u8") for b in held]
        keys, counts = merge_counts(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts]))
        write_array(base, keys, f"{shard}.keys")
        write_array(base, counts, f"{shard}.counts")
        n = int(counts.sum())
        top = np.flatnonzero(counts > HOT * n)  # what makes so much of all tokens makes more of its shard's
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([n], pa.int64()), pa.array([top], pa.list_(pa.int64())), pa.array([counts[top].astype(np.int64)], pa.list_(pa.int64()))],
            names=["shard", "n_words", "n_tokens", "top", "top_counts"],
        )

    return by_shard(counted, n_shards, step, "shard int, n_words long, n_tokens long, top array<long>, top_counts array<long>")


@dataclass
class Words:
    """The vocabulary: where its arrays lie; a word's number is its rank."""

    base: str
    first: list[int]  # number of each shard's first word, and of all words at the end
    n_tokens: int
    memo: dict = field(default_factory=dict)

    @property
    def n_shards(self) -> int:
        return len(self.first) - 1

    @property
    def n_words(self) -> int:
        return self.first[-1]

    @property
    def start(self) -> int:
        """The number that stands for the begin of a text: it is a first word only."""
        return self.n_words

    def array(self, shard: int, name: str) -> np.ndarray:
        return open_array(f"{self.base}/{shard}.{name}" if self.first[shard + 1] > self.first[shard] else "", "<u8")

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes; -1: unknown."""
        edges = np.searchsorted(hash_shard(hashes, self.n_shards), np.arange(self.n_shards + 1))
        out = np.full(len(hashes), -1, np.int64)
        for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                at = find(self.array(s, "keys"), hashes[a:b])
                out[a:b] = np.where(at < 0, -1, at + self.first[s])
        return out

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts of sorted known numbers."""
        return gather(numbers, self.first, lambda s: self.array(s, "counts"), np.uint64)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its words' numbers, then the end's."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        words = [t.encode().lower().split() for t in texts]
        for w in words:
            w.append(END)
        if new := list({x for w in words for x in w if x not in memo}):
            hashes = np.array([word_hash(x) for x in new], np.uint64)
            order = np.argsort(hashes)
            found = np.empty(len(new), np.int64)
            found[order] = self.look_up(hashes[order])
            memo.update(zip(new, found.tolist(), strict=True))
        return [np.fromiter((memo[x] for x in w), np.int64, len(w)) for w in words]


def gather(numbers: np.ndarray, first: list[int], array: Callable[[int], np.ndarray], dtype: type) -> np.ndarray:
    """Values by sorted numbers, from arrays that each hold a range of them; what isn't written is 0."""
    edges = np.searchsorted(numbers, first)
    out = np.zeros(len(numbers), dtype)
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            held = array(i)
            if len(held):
                out[a:b] = held[numbers[a:b] - first[i]]
    return out


@dataclass
class Ranges:
    """Equal ranges of numbers, one for each shard of pairs; hot first words are dealt out."""

    edges: list[int]
    hot: list[int]  # sorted

    @property
    def n(self) -> int:
        return len(self.edges) - 1

    def shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.edges, a, "right") - 1
        hot = np.isin(a, self.hot)
        out[hot] = (a[hot] + b[hot] * 7919) % self.n
        return np.clip(out, 0, self.n - 1)


def pair_counts(train: DataFrame, words: Words, ranges: Ranges) -> DataFrame:
    """shard, blob: pairs of numbers and their counts, merged within each task."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((words, ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ranges = shared.value
        parts, held, keys, counts = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.uint32)

        def merge() -> None:
            nonlocal parts, held, keys, counts
            k, c = np.unique(np.concatenate(parts), return_counts=True)
            keys, counts = merge_counts(np.concatenate([keys, k]), np.concatenate([counts, c.astype(np.uint32)]))
            parts, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts
            shard = ranges.shard((keys >> PAIR).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(ranges.n + 1))
            yield _rows([(s, squeeze(deltas(keys[order[a:b]]), counts[order[a:b]])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a])
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint32)

        for batch in batches:
            rows = batch.column(0).to_pylist()
            for at in range(0, len(rows), 500):
                for n in words.numbers(rows[at : at + 500]):
                    n = n.astype(np.uint64)
                    parts.append(np.concatenate([[np.uint64(words.start)], n[:-1]]) << PAIR | n)
                    held += len(n)
                if held >= 1_000_000:
                    merge()
                if len(keys) >= PAIRS_HELD:
                    yield from flush()
        if parts:
            merge()
        if len(keys):
            yield from flush()

    return train.mapInArrow(run, "shard int, blob binary")


CONTEXT = [("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")]


def context_stats(first_words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct first words of sorted pairs, with the sum of counts and the numbers of counts 1, 2, 3 or more."""
    at = np.flatnonzero(np.concatenate([[True], first_words[1:] != first_words[:-1]])) if len(first_words) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64) for x in (counts.astype(np.int64), (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))]
    return first_words[at], sums


def pair_index(counted: DataFrame, ranges: Ranges, base: str) -> DataFrame:
    """A row per shard: the widths of its counts, counts of counts, and what hot first words have here; writes pairs,
    counts and context arrays.

    Rows of kind 1 carry, for ranges of second words, how many distinct first words they follow here.
    """
    schema = "kind int, shard int, blob binary, width int, of_counts array<long>, hot array<array<long>>"

    def row(kind: int, shard: int, blob: bytes | None = None, width: int | None = None, of_counts: list[int] | None = None, hot: list[list[int]] | None = None) -> pa.RecordBatch:
        columns = [pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), pa.array([width], pa.int32()), pa.array([of_counts], pa.list_(pa.int64())), pa.array([hot], pa.list_(pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    def step(shard: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [expand(b, "<u8", "<u4") for b in held]
        keys, counts = merge_counts(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.uint64))
        del parts
        a, b = (keys >> PAIR).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        word, sums = context_stats(a, counts)
        low, high = ranges.edges[shard], ranges.edges[shard + 1]
        is_hot = np.isin(word, ranges.hot)
        for (name, dtype), values in zip(CONTEXT, sums, strict=True):
            dense = np.zeros(high - low, dtype)
            dense[word[~is_hot] - low] = values[~is_hot]
            write_array(base, dense, f"{shard}.{name}")
        hot = np.stack([word[is_hot], *(v[is_hot] for v in sums)], axis=1).tolist()
        of_counts = [int((counts == i).sum()) for i in range(1, 5)]
        width = 4 if int(counts.max(initial=0)) < 1 << 32 else 8
        write_array(base, keys, f"{shard}.pairs")
        write_array(base, counts.astype(f"<u{width}"), f"{shard}.pair_counts")
        yield row(0, shard, width=width, of_counts=of_counts, hot=hot)
        word, n = np.unique(b, return_counts=True)
        edges = np.searchsorted(word, ranges.edges)
        for s, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            if y > x:
                yield row(1, s, blob=squeeze(deltas(word[x:y].astype(np.uint64)), n[x:y].astype("<u4")))

    return by_shard(counted, ranges.n, step, schema)


def continuations(index: DataFrame, ranges: Ranges, base: str) -> DataFrame:
    """shard, and counts of counts; writes, for each second word of the range, how many first words it follows."""

    def step(shard: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        low, high = ranges.edges[shard], ranges.edges[shard + 1]
        dense = np.zeros(high - low, "<u4")
        for blob in held:
            d, n = expand(blob, "<u8", "<u4")
            dense[np.cumsum(d, dtype=np.uint64).astype(np.int64) - low] += n
        write_array(base, dense, f"{shard}.continued")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([[int((dense == i).sum()) for i in range(1, 5)] + [int((dense > 2).sum()), int(dense.sum(dtype=np.int64))]], pa.list_(pa.int64()))], names=["shard", "of_counts"])

    return by_shard(index.filter("kind = 1").select("shard", "blob"), ranges.n, step, "shard int, of_counts array<long>")


def discounts(n: list[int]) -> np.ndarray:
    """Chen and Goodman's three discounts from the counts of counts 1 to 4, by index of min(count, 3)."""
    n1, n2, n3, n4 = (max(0, x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))])


@dataclass
class Model:
    """What scoring needs; arrays are opened when a worker uses them."""

    words: Words
    ranges: Ranges
    widths: list[int]  # bytes of a count by shard of pairs; 0 where there are none
    continued: list[bool]
    hot: np.ndarray  # word, total, n1, n2, n3: rows in order of word
    d1: np.ndarray
    d2: np.ndarray
    of_continued: list[int]

    def array(self, shard: int, name: str, dtype: str) -> np.ndarray:
        there = self.continued[shard] if name == "continued" else self.widths[shard]
        return open_array(f"{self.words.base}/{shard}.{name}" if there else "", dtype)

    def unigram(self, words: np.ndarray) -> np.ndarray:
        """Continuation probability of sorted numbers, -1 being the unknown word."""
        c = np.zeros(len(words))
        known = words >= 0
        c[known] = gather(words[known], self.ranges.edges, lambda s: self.array(s, "continued", "<u4"), np.float64)
        n1, n2, _, _, n3, total = self.of_continued
        share = (self.d1[1:] @ np.array([n1, n2, n3])) / total if total else 1.0
        rest = (c - self.d1[np.minimum(c, 3).astype(int)]) / total if total else 0.0
        return rest + share / (self.words.n_words + 1)

    def probability(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """P(b | a) by distinct sorted pairs of numbers; -1: unknown."""
        second, inverse = np.unique(b, return_inverse=True)
        lower = self.unigram(second)[inverse]
        first, inverse = np.unique(a, return_inverse=True)
        stats = np.zeros((4, len(first)))
        known = first >= 0
        for i, (name, dtype) in enumerate(CONTEXT):
            stats[i, known] = gather(first[known], self.ranges.edges, lambda s, name=name, dtype=dtype: self.array(s, name, dtype), np.float64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot[:, 0], first), len(self.hot) - 1)
            is_hot = self.hot[at, 0] == first
            stats[:, is_hot] = self.hot[at[is_hot], 1:].T
        total = stats[0]
        share = np.where(total > 0, (self.d2[1:] @ stats[1:]) / np.maximum(total, 1), 1.0)
        c = np.zeros(len(a))
        both = np.flatnonzero((a >= 0) & (b >= 0))
        shard = self.ranges.shard(a[both], b[both])
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.ranges.n + 1))
        for s, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            if y > x and self.widths[s]:
                i = both[order[x:y]]
                at = find(self.array(s, "pairs", "<u8"), a[i].astype(np.uint64) << PAIR | b[i].astype(np.uint64))
                hit = at >= 0
                c[i[hit]] = self.array(s, "pair_counts", f"<u{self.widths[s]}")[at[hit]]
        upper = np.maximum(c - self.d2[np.minimum(c, 3).astype(int)], 0) / np.maximum(total[inverse], 1)
        return upper + share[inverse] * lower


def train(docs: DataFrame, text_col: str = "text", shard_tokens: int = 6_000_000) -> Model:
    """Fit the model to all rows of ``docs``.  The driver sees a few numbers per shard, and the hot first words: at most
    1 / ``HOT`` of them, and for each what every shard has of it."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    base = fresh_dir(spark, "ngrams")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(2, -(-total // (5 * shard_tokens)))
    found = written(vocabulary(word_counts(texts, n), n, base), "vocabulary")
    rows = {r.shard: r for r in found.select("shard", "n_words", "n_tokens").collect()}
    first = [0, *np.cumsum([rows[s].n_words if s in rows else 0 for s in range(n)]).tolist()]
    if first[-1] > LIMIT:
        raise OverflowError(f"{first[-1]} distinct words: pairs of more than {LIMIT} don't fit in 64 bits")
    words = Words(base, first, sum(r.n_tokens for r in rows.values()))
    top = found.select("shard", F.explode(F.arrays_zip("top", "top_counts")).alias("t")).filter(F.col("t.top_counts") > HOT * words.n_tokens)
    hot = {r.top + first[r.shard] for r in top.select("shard", "t.top").collect()} | {words.start}
    ranges = Ranges([words.n_words * i // n for i in range(n)] + [words.n_words + 1], sorted(hot))
    index = written(pair_index(pair_counts(texts, words, ranges), ranges, base), "pairs")
    shards = {r.shard: r for r in index.filter("kind = 0").select("shard", "width", "of_counts").collect()}
    more = {r.shard: r for r in written(continuations(index, ranges, base), "continuations").collect()}
    each = index.filter("kind = 0").select(F.explode("hot").alias("h"))
    sums = each.groupBy(F.col("h")[0].alias("word")).agg(*(F.sum(F.col("h")[i]).alias(f"s{i}") for i in range(1, 5)))
    crowded = np.array(sorted(tuple(r) for r in sums.collect()), np.float64).reshape(-1, 5)
    release(found, index)
    of = lambda found, k: [sum(r.of_counts[i] for r in found.values()) for i in range(k)]
    return Model(words, ranges, [shards[s].width if s in shards else 0 for s in range(n)], [s in more for s in range(n)], crowded, discounts(of(more, 6)), discounts(of(shards, 4)), of(more, 6))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (as in column ``held_out`` of ``df``), token counts, the unigram score and the model's, in log10."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        words = model.words
        bottom = math.log10(words.n_tokens + words.n_words + 1)

        def part(ids: pa.Array, out: pa.Array, rows: list[str]) -> pa.RecordBatch:
            numbers = words.numbers(rows)
            n = np.array([len(x) for x in numbers], np.int64)
            second = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            begin = np.cumsum(n) - n
            previous = np.roll(second, 1)
            previous[begin] = words.start
            distinct, inverse = np.unique(second, return_inverse=True)
            counts = np.zeros(len(distinct))
            counts[distinct >= 0] = words.count(distinct[distinct >= 0])
            unigram = (np.log10(counts + 1) - bottom)[inverse]
            pairs, inverse = np.unique((previous + 1).astype(np.uint64) << PAIR | (second + 1).astype(np.uint64), return_inverse=True)
            p = np.log10(model.probability((pairs >> PAIR).astype(np.int64) - 1, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1))[inverse]
            known = (second >= 0).astype(np.int64)
            sums = [np.add.reduceat(x, begin) for x in (known, unigram, p)]
            return pa.RecordBatch.from_arrays([ids, out, pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), words.n_tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=[c.split()[0] for c in SCORES.split(", ")])

        for batch in batches:
            sizes = np.cumsum([len(x) for x in batch.column(2).to_pylist()])
            at = 0
            while at < batch.num_rows:  # about four million characters at a time
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4_000_000, "right")))
                yield part(batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at), batch.column(2).slice(at, stop - at).to_pylist())
                at = stop

    rows = df.select(df[id_col].cast("long").alias("doc_id"), "held_out", F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCORES)


def train_and_score(df: DataFrame, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents that the CRC-32 of their ids doesn't hold out; score all."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], SCORES)
    return score(rows, train(rows.filter("not held_out")))
