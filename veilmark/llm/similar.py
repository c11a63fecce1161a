"""Near-duplicates at a similarity: the SimHash operator for texts that differ in more than a few bits.

Two texts are near-duplicates if the Jaccard similarity of their word-shingle sets is at least ``similarity``.  At 0.8
two fingerprints differ in about 15 % of their bits, and a pigeonring over so many differences has keys of a few bits,
which tell nothing apart.  So here the fingerprints are wide (``WIDE`` bits), candidates come from keys of shared
minima (``BANDS`` keys of ``ROWS``: a pair of similarity 0.8 shares none with probability 7e-5, one of 0.9 with 5e-10),
and the pigeonring prunes them: of ``SEGMENTS`` segments some chain must keep within its budgets before the full Hamming
distance is taken.  The budget is that of ``similarity`` and 3.5 standard deviations more, so that a pair that is similar
enough is pruned with probability 2e-4.  What is left is compared exactly: a link is made only between sets that are
similar enough.

Texts with equal sets are one row.  Members of a key are first compared with its least and greatest one.  Keys whose
members aren't all connected then get their members' sets, and the pairs within the budget are compared there, the nearest
first, unless a chain of links connects them by then; what a key gives back are links, fewer than its members.  A key
with very many members is dealt out in blocks of ``BLOCK``, each pair of blocks a group of its own, so that no task
holds more than two blocks.  For a family of n texts that are alike but not similar enough to be linked the work grows
with the square of n, spread over its blocks; rows and memory don't.

Defined results: null and empty texts have the empty set and link with each other; texts shorter than a shingle are
one shingle; repeated ids give a row each; a null id comes last; an empty table gives no rows; other columns stay as
they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, prepare, release, written
from .components import components
from .simhash import heads_of_groups

BANDS, ROWS, PART = 24, 5, 4096
WIDE, SEGMENTS = 1024, 16
BLOCK = 2048


def shingles(text: bytes, words_in_shingle: int = 5) -> np.ndarray:
    """The text's distinct word shingles under XXH64, sorted; A-Z are lower-cased."""
    import xxhash

    h, words, k = xxhash.xxh64_intdigest, text.lower().split(), words_in_shingle
    if len(words) <= k:
        return np.array([h(b" ".join(words))] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([h(line[a:b]) for a, b in spans], np.uint64))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(42)
    add, times = r.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return add, times | np.uint64(1)


def band_keys(found: np.ndarray, add: np.ndarray, times: np.ndarray) -> list[int]:
    """A key for each band of minima; none for the empty set."""
    import xxhash

    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), PART):
        least = np.minimum(least, ((found[None, at : at + PART] ^ add) * times).min(axis=1))
    return [xxhash.xxh64_intdigest(b.tobytes(), seed=i) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def identity(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes())


def wide_fingerprint(found: np.ndarray) -> bytes:
    """SimHash of a set of shingles in ``WIDE`` bits: a bit is 1 if it is set in over half the hashes."""
    lanes = np.random.default_rng(8).integers(0, 1 << 64, (1, WIDE // 64), np.uint64) | np.uint64(1)
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(found), 255):  # sums of 255 bits fit in a byte
        x = found[at : at + 255, None] * lanes
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(found)).tobytes()


def budget(similarity: float) -> int:
    """The most bits in which fingerprints of sets that are similar enough differ, but for one pair in 5,000."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(WIDE, math.ceil(WIDE * share + 3.5 * math.sqrt(WIDE * share * (1 - share))))


def near(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows of a and b differ in at most ``most`` bits, in how many): first the chains, then the distance.

    On a ring of segments, if the whole keeps within ``most``, some segment starts a chain that keeps within its share
    at every length; so pairs without a chain of three are left out.
    """
    d = np.bitwise_count(a ^ b).astype(np.int16)
    chain, ok = np.zeros_like(d), np.ones(d.shape, bool)
    for length in range(1, 4):
        chain = chain + np.roll(d, 1 - length, axis=1)
        ok &= chain * SEGMENTS <= length * most
    i = np.flatnonzero(ok.any(axis=1))
    n = d[i].sum(axis=1, dtype=np.int64)
    return i[n <= most], n[n <= most]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tell (a hash of the text) and text."""
    text = df[text_col].cast("string")
    return df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("tell"), text.alias("text"))


def sketches(rows: DataFrame, words_in_shingle: int) -> DataFrame:
    """doc_id, tell, fp (a hash of the shingle set) and keys of the bands."""

    def make():
        add, times = permutations()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x.as_py() or b"", words_in_shingle) for x in batch.column(2).cast(pa.large_binary())]
            fps = np.array([identity(s) for s in sets], np.uint64).view(np.int64)
            keys = [np.array(band_keys(s, add, times), np.uint64).view(np.int64) for s in sets]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "tell", "fp", "keys"])

        return step

    return map_arrow(rows, make, "doc_id long, tell long, fp long, keys array<long>")


def sets_of(rows: DataFrame, wanted: DataFrame, words_in_shingle: int) -> DataFrame:
    """(fp, wide, shingles) of the texts that ``wanted`` (doc_id, tell) names."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x.as_py() or b"", words_in_shingle) for x in batch.column(0).cast(pa.large_binary())]
            fps = np.array([identity(s) for s in sets], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fps), pa.array([wide_fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "wide", "shingles"])

        return step

    named = wanted.select(F.col("doc_id").alias("w_id"), F.col("tell").alias("w_tell"))
    found = rows.join(named.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tell") == F.col("w_tell")), "left_semi")
    return map_arrow(found.select("text"), make, "fp long, wide binary, shingles binary").dropDuplicates(["fp"])


def _wide(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE // 64)


def pruned(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose wide fingerprints are near enough."""
    most = budget(similarity)
    of = lambda name: sets.select(F.col("fp").alias(name), F.col("wide").alias(f"of_{name}"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            i, _ = near(_wide(batch.column(2)), _wide(batch.column(3)), most)
            return batch.select([0, 1]).take(pa.array(i))

        return step

    return map_arrow(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b"), make, "a long, b long")


def similar_enough(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted) have at least this Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    of = lambda name: sets.select(F.col("fp").alias(name), F.col("shingles").alias(f"of_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar_enough(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")
    return rows.mapInArrow(run, "a long, b long")


def new_links(root: np.ndarray, wide: np.ndarray, sets: list[np.ndarray], similarity: float, most: int) -> list[tuple[int, int]]:
    """Links between members (in order of root) of different components, that connect all that links can connect."""
    a, b, d = [], [], []
    for i in range(len(root) - 1):
        j = int(np.searchsorted(root, root[i], "right"))
        if j < len(root):
            hit, far = near(wide[j:], wide[i], most)
            a.append(np.full(len(hit), i))
            b.append(hit + j)
            d.append(far)
    if not a:
        return []
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.argsort(np.concatenate(d), kind="stable")
    _, group = np.unique(root, return_inverse=True)
    up, out = list(range(int(group[-1]) + 1)), []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(int(group[i])), find(int(group[j]))
        if x != y and similar_enough(sets[i], sets[j], similarity):
            up[x] = y
            out.append((i, j))
    return out


def across(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within keys whose members aren't all connected yet (``roots``: fp, root)."""
    most = budget(similarity)
    apart = written(members.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "apart")
    split = apart.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = apart.join(split.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("key", "block", "fp", "root", other.alias("other")).select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp", "root")
    rows = rows.join(sets, "fp").select("key", "low", "high", "root", "fp", "wide", "shingles")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "root", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            root, fp = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in (3, 4))
            found = [np.frombuffer(x, np.uint64) for h in held for x in h.column(6).to_pylist()]
            links = new_links(root, np.concatenate([_wide(h.column(5)) for h in held]), found, similarity, most)
            return pa.RecordBatch.from_arrays([pa.array([int(fp[i]) for i, _ in links], pa.int64()), pa.array([int(fp[j]) for _, j in links], pa.int64())], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            cells = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            at = 0
            while at < len(cells):
                stop = at
                while stop < len(cells) and cells[stop] == cells[at]:
                    stop += 1
                if cells[at] != now and held:
                    yield done(held)
                    held = []
                now = cells[at]
                held.append(batch.slice(at, stop - at))
                at = stop
        if held:
            yield done(held)

    return rows.mapInArrow(run, "a long, b long")


def grouped(df: DataFrame, similarity: float, words_in_shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tell, fp) of all rows; and (fp, root): each distinct set and its component."""
    prepare(df.sparkSession)
    rows = keyed(df, id_col, text_col)
    docs = written(sketches(rows, words_in_shingle), "sketches")
    every = written(docs.select("fp", F.explode("keys").alias("key")).distinct(), "members")
    crowds = every.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).filter("n > 1")
    members = written(every.join(crowds.drop("n"), "key"), "buckets")
    release(every)
    each = docs.groupBy("fp").agg(F.min(F.struct("doc_id", "tell")).alias("r")).join(members.select("fp").distinct(), "fp", "left_semi")
    sets = written(sets_of(rows, each.select("r.doc_id", "r.tell"), words_in_shingle), "sets")
    ends = members.select("fp", F.explode(F.array("low", "high")).alias("end")).filter("fp <> end")
    tried = ends.select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b")).distinct()
    linked = written(checked(pruned(tried, sets, similarity), sets, similarity), "linked")
    roots = components(linked).withColumnRenamed("node", "fp")
    more = written(across(members.select("key", "fp"), roots, sets, similarity), "more")
    if not more.isEmpty():
        roots = components(linked.unionByName(more)).withColumnRenamed("node", "fp")
    release(members, sets)
    distinct = docs.select("fp").distinct()
    return docs.select("doc_id", "tell", "fp"), distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def one_of_similar(df: DataFrame, similarity: float = 0.8, words_in_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, but one of each group of similar texts, chosen as ``one_of_each`` does."""
    return heads_of_groups(df, *grouped(df, similarity, words_in_shingle, id_col, text_col), id_col, text_col)
