"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits lies on a ring of ``SEGMENTS`` equal segments.  If two fingerprints differ in at most
``max_bits`` bits, some segment starts a chain in which, for every length l, the first l segments differ in at
most ``l * max_bits / SEGMENTS`` bits (the strong form of the pigeonhole principle on a ring).  So the first
segments of that chain are equal, and of the next ones one half is: that gives the candidate keys.  Candidates
that meet in a key are tested for the chain's budgets, then for the full Hamming distance.

Distinct fingerprints alone are compared, so copies cost one row; a crowded key is linked through the points up to
``max_bits / 2`` bits (rounded up) away from its members: of two that differ in at most ``max_bits`` bits some point
lies that near to both.  So no key is compared by all pairs.  ``max_bits`` is at most ``MOST``: beyond, keys of a few
bits would tell too little apart (``similar`` is for texts that differ more).

Defined results: null and empty texts have fingerprint zero and link like any other; repeated ids give a row
each; a null id takes the smallest non-null id of its component (null if there is none); an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, prepare, written
from .components import components

SEGMENTS, BITS = 8, 64
#: Buckets up to this size are compared pair by pair; larger ones through shared points, which connects the same.
SMALL = 24
MOST = 4
#: Rows of keys that a task holds at once, and points of a crowded key.
HELD, POINTS = 1_000_000, 8_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, words_in_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles under XXH64; A-Z are lower-cased."""
    import xxhash

    h, words, k = xxhash.xxh64_intdigest, text.lower().split(), words_in_shingle
    if not words:
        return 0
    if len(words) < k:
        return h(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([h(line[a:b], seed) for a, b in spans], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, words_in_shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tell (a hash of the text, to tell rows with one id apart), fp: the fingerprint's bits as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(2).cast(pa.large_binary())
            found = np.array([fingerprint(x.as_py() or b"", words_in_shingle, seed) for x in column], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "tell", "fp"])

        return step

    text = df[text_col].cast("string")
    return map_arrow(df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("tell"), text.alias("text")), make, "doc_id long, tell long, fp long")


def budgets(max_bits: int) -> list[int]:
    """The most bits in which a chain's first l segments may differ, for l from 1."""
    return [(length * max_bits) // SEGMENTS for length in range(1, SEGMENTS + 1)]


def key_masks(max_bits: int) -> list[tuple[int, int]]:
    """(first segment of the chain, mask of the bits that are equal), one for each candidate key."""
    width = BITS // SEGMENTS
    segment = [((1 << width) - 1) << (BITS - width * (i + 1)) for i in range(SEGMENTS)]
    limits = budgets(max_bits)
    exact = sum(x == 0 for x in limits)
    near = sum(x <= 1 for x in limits) - exact
    halves = [range(exact, exact + near // 2), range(exact + near // 2, exact + near)] if near >= 2 else [range(0)]
    out = []
    for start in range(SEGMENTS):
        for half in halves:
            mask = 0
            for j in [*range(exact), *half]:
                mask |= segment[(start + j) % SEGMENTS]
            out.append((start, mask))
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _chain(x: np.ndarray, start: int, limits: list[int]) -> np.ndarray:
    """Whether differences x keep within the chain's budgets from this start on."""
    width = BITS // SEGMENTS
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for j, limit in enumerate(limits):
        shift = np.uint64(BITS - width * ((start + j) % SEGMENTS + 1))
        total += _bits((x >> shift) & np.uint64((1 << width) - 1))
        ok &= total <= limit
    return ok


def bucket_links(tag: np.ndarray, key: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[np.ndarray]:
    """Links (a, b) between the fingerprints that share a key; ``tag`` says which mask the key was taken with."""
    masks, limits = key_masks(max_bits), budgets(max_bits)
    order = np.lexsort((fp, key, tag))
    tag, key, fp = tag[order], key[order], fp[order]
    new = np.ones(len(fp), bool)
    new[1:] = (tag[1:] != tag[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(fp)))
    bucket = np.repeat(np.arange(len(first)), size)
    small = (size <= SMALL)[bucket]
    for d in range(1, int(size[size <= SMALL].max(initial=1))):
        i = np.flatnonzero((bucket[d:] == bucket[:-d]) & small[:-d])
        if not len(i):
            break
        x = fp[i] ^ fp[i + d]
        for start in range(SEGMENTS):
            mine = np.isin(tag[i], [t for t, (s, _) in enumerate(masks) if s == start])
            j, y = i[mine], x[mine]
            ok = _chain(y, start, limits)
            ok[ok] = _bits(y[ok]) <= max_bits
            if ok.any():
                yield np.stack([fp[j[ok]], fp[j[ok] + d]])
    for b in np.flatnonzero(size > SMALL):
        yield from crowded_links(fp[first[b] : first[b] + size[b]], masks[int(tag[first[b]])][1], max_bits)


def flips(mask: int, most: int) -> np.ndarray:
    """All ways to change up to ``most`` of the bits outside of ``mask``."""
    free = [1 << j for j in range(BITS) if not mask >> j & 1]
    return np.array([sum(c) for n in range(most + 1) for c in combinations(free, n)], np.uint64)


def crowded_links(members: np.ndarray, mask: int, max_bits: int) -> Iterator[np.ndarray]:
    """Links that connect the members of one key that lie within ``max_bits`` bits.

    Each member claims the points around it.  Of two claimants one at least is near (half of ``max_bits``, rounded
    down) and the other at most one bit further, so all that claim a point link to its nearest claimant, if that one
    is near.  Points are taken in parts, so that a part's fit in memory.
    """
    near = max_bits // 2
    moves = flips(mask, (max_bits + 1) // 2)
    is_near = _bits(moves) <= near
    parts = -(-len(members) * len(moves) // POINTS)
    for part in range(parts):
        points, owner, close = [], [], []
        for move, c in zip(moves, is_near, strict=True):
            p = members ^ move
            mine = np.flatnonzero((p * _ODD >> np.uint64(40)) % np.uint64(parts) == np.uint64(part)) if parts > 1 else np.arange(len(p))
            points.append(p[mine])
            owner.append(members[mine])
            close.append(np.full(len(mine), c))
        points, owner, close = np.concatenate(points), np.concatenate(owner), np.concatenate(close)
        order = np.lexsort((owner, ~close, points))
        points, owner, close = points[order], owner[order], close[order]
        new = np.concatenate([[True], points[1:] != points[:-1]]) if len(points) else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(points) else new
        ok = close[head] & (owner != owner[head]) if len(points) else new
        if ok.any():
            yield np.unique(np.stack([owner[head][ok], owner[ok]]), axis=1)


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) within ``max_bits`` bits; enough of them to connect all."""
    if not 0 <= max_bits <= MOST:
        raise ValueError(f"max_bits must lie between 0 and {MOST}")
    masks = [(t, m - (1 << 64) if m >> 63 else m) for t, (_, m) in enumerate(key_masks(max_bits))]
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in masks)))
    rows = distinct.select("fp", keys.alias("k")).select("k.tag", "k.key", "fp").repartition("tag", "key").sortWithinPartitions("tag", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[list[np.ndarray]], whole: bool) -> tuple[list[pa.RecordBatch], list[list[np.ndarray]]]:
            """Links of the keys that are complete, and the rows of the last key, which may go on."""
            tag, key, fp = (np.concatenate([p[i] for p in parts]) for i in range(3))
            stop = len(tag)
            if not whole:
                stop = int(np.flatnonzero((tag != tag[-1]) | (key != key[-1]))[-1]) + 1 if ((tag != tag[-1]) | (key != key[-1])).any() else 0
            out = []
            for edge in bucket_links(tag[:stop], key[:stop].view(np.uint64), fp[:stop].view(np.uint64), max_bits) if stop else ():
                edge = edge.view(np.int64)
                out.append(pa.RecordBatch.from_arrays([pa.array(edge[0]), pa.array(edge[1])], names=["a", "b"]))
            return out, [[tag[stop:], key[stop:], fp[stop:]]] if stop < len(tag) else []

        parts, held = [], 0
        for batch in batches:
            parts.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            held += batch.num_rows
            if held >= HELD:
                out, parts = found(parts, False)
                held = sum(len(p[0]) for p in parts)
                yield from out
        if parts:
            yield from found(parts, True)[0]

    return rows.mapInArrow(run, "a long, b long")


def clustered(df: DataFrame, max_bits: int, words_in_shingle: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tell, fp) of all rows; and (fp, least, root): each distinct fingerprint, its smallest id and its component."""
    prepare(df.sparkSession)
    docs = written(fingerprints(df, words_in_shingle, seed, id_col, text_col), "fingerprints")
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    return docs, distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, max_bits: int = 2, words_in_shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that links reach."""
    docs, rooted = clustered(df, max_bits, words_in_shingle, seed, id_col, text_col)
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(group, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, max_bits: int = 2, words_in_shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, but one of each group of near-duplicates: that with the smallest id.

    Null ids come last.  Of rows with one id the one whose text hashes lowest stays; of rows that agree in both, one.
    """
    return heads_of_groups(df, *clustered(df, max_bits, words_in_shingle, seed, id_col, text_col), id_col, text_col)


def heads_of_groups(df: DataFrame, docs: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of ``df`` in each group, given (doc_id, tell, fp) of all rows and (fp, root) of all fingerprints."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tell")
    heads = docs.groupBy("fp").agg(F.min(first).alias("first")).join(rooted, "fp").groupBy("root").agg(F.min("first").alias("f")).select("f.doc_id", "f.tell")
    rows = docs.groupBy("doc_id", "tell").agg(F.count("*").alias("n"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tell"] == b["tell"])
    kept = written(rows.join(heads, same(rows, heads), "left_semi"), "kept")
    # the row itself is one column, so that no name of its own can clash
    named = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), df[id_col].cast("long").alias("own_id"), F.xxhash64(df[text_col].cast("string")).alias("own_tell"))

    def those(kept: DataFrame) -> DataFrame:
        return named.join(kept.hint("shuffle_hash"), named["own_id"].eqNullSafe(kept["doc_id"]) & (named["own_tell"] == kept["tell"]), "left_semi")

    if kept.filter("n > 1").isEmpty():
        return those(kept).select("row.*")
    return those(kept.filter("n = 1")).unionByName(those(kept.filter("n > 1")).dropDuplicates(["own_id", "own_tell"])).select("row.*")
