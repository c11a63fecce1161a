"""Exact substring deduplication with sharded suffix arrays.

Every byte goes that a string of ``span`` bytes covers which also starts earlier (in a smaller document, or before
in the same one).  To find such strings without sorting the corpus as one text:

* A window of ``span`` bytes has a key, the least hash of its ``GRAM``-byte strings: equal windows have equal keys.
  Windows in a row with one key make a segment.  Segments that are equal within a chunk of text are merged at once.
* Keys are counted over the corpus, and each task of the scan is told those of its own keys that occur again; only
  segments with such a key are moved, to the shard of their key.  Keys that very many segments have (a line that a third of all documents hold) are refined: their windows take
  the least hash among the strings that aren't such keys, which their surroundings supply.
* Each shard lays its distinct segments end to end, builds their suffix array by induced sorting, and computes
  permuted common prefixes; suffixes with ``span`` bytes in common are equal windows, of which the earliest stays.

Nothing is sampled, and counts only route segments, so the result is exact.  No task opens more than one array, and
the driver sees a row per shard and the hot keys, whose number is bounded.

Defined results: texts are UTF-8 bytes, null being empty; texts shorter than ``span`` are kept; rows that repeat a
doc_id are judged each by its own text, and a string at one start of one doc_id isn't earlier than itself; a null
id is smaller than any other; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_dir, map_arrow, prepare, release, remove, written
from .arrays import by_shard, deltas, expand, find, merge_counts, open_array, squeeze, write_array
from .suffix_array import permuted_lcp, suffix_array

GRAM = 24
#: Bytes of text that are hashed at once, and windows that a segment has at most; neither changes a result.
CHUNK, LONGEST = 2 << 20, 256
#: Bytes of text whose segments are moved together.
FLUSH = 24 << 20
NULL = -(1 << 63)
#: Marks the length of a segment that can hold a window twice by itself, as in text that repeats within a few words.
TWICE = 1 << 31
#: Lengths and places within a chunk must stay well below the bits that they have.
LONGEST_SPAN = 1 << 20
#: Values that are worked on at once.
CACHED = 1 << 14
#: Bits for a place within a chunk.
PLACE = np.uint64((1 << 22) - 1)
TOP = np.uint64(1 << 63)

_r = np.random.default_rng(20)
_GEAR = _r.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_C = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2 ** 64."""
    size = 1 << max(12, n.bit_length())
    if size not in _powers:
        _powers.clear()
        base = np.full(size, _C, np.uint64)
        back = np.full(size, pow(_C, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _powers[size] = np.multiply.accumulate(base), np.multiply.accumulate(back)
    return _powers[size]


def mixed(h: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), np.uint64)
    for at in range(0, len(h), CACHED):
        x = h[at : at + CACHED]
        x = x ^ (x >> np.uint64(32))
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.bitwise_xor(x, x >> np.uint64(32), out=out[at : at + CACHED])
    return out


def least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row: of 2, 4, 8 and so on, in parts that stay in a core's cache."""
    n = len(h) - w + 1
    out = np.empty(max(n, 0), h.dtype)
    block = max(CACHED, w)
    for at in range(0, n, block):
        x, have = h[at : at + block + w - 1], 1
        while 2 * have <= w:
            x = np.minimum(x[:-have], x[have:])
            have *= 2
        if have < w:
            x = np.minimum(x[: len(x) - (w - have)], x[w - have :])
        out[at : at + block] = x[: n - at]
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the ranges, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class Segments:
    """Of a chunk: key, content hash, start in the chunk and windows of each segment, in order of start.

    ``anchor``: where the string of least hash lies in the segment.  ``twice``: whether equal windows can lie within the segment.  In two equal windows the string of least hash lies
    at one offset, so its place moves from the one to the other: a segment in which it never moves has none.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray, span: int, hot: np.ndarray | None = None):
        empty = np.zeros(0, np.int64)
        self.start, self.windows, self.key, self.content, self.twice, self.anchor = empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty.astype(bool), empty
        n = len(text)
        if n < span:
            return
        power, back = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        x = _GEAR[text]
        x *= power[:n]
        np.cumsum(x, out=sums[1:])
        x = sums[GRAM:] - sums[:-GRAM]
        x *= back[: n - GRAM + 1]
        h = mixed(x)
        h &= ~TOP
        w = span - GRAM + 1
        np.bitwise_and(h, ~PLACE, out=x)
        x |= np.arange(len(h), dtype=np.uint64)
        place = least(x, w)
        place &= PLACE
        key = h[place.view(np.int64)]
        if hot is not None and len(hot):
            run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.diff(np.append(run, len(key)))
            crowded = np.isin(key[run], hot)
            run, many = run[crowded], many[crowded]
            if len(run):  # their windows with what these reach, one run after the other, unless that is more than all
                reach = many + w - 1
                part = int(reach.sum()) < len(h)
                x = h[ragged(run, reach)] if part else h
                spared = least(np.where(np.isin(x, hot), x | TOP, x), w)[ragged(np.cumsum(reach) - reach if part else run, many)]
                key[ragged(run, many)] = spared ^ np.uint64(0x5555555555555555) & ~TOP | TOP
        usable = np.maximum(sizes - span + 1, 0)
        valid = np.repeat(np.tile([True, False], len(sizes)), np.stack([usable, sizes - usable], 1).reshape(-1))[: len(key)]
        changes = key[1:] != key[:-1]
        new = valid.copy()
        new[1:] &= changes | ~valid[:-1]
        start = np.flatnonzero(new)
        stop = valid.copy()
        stop[:-1] &= changes | ~valid[1:]
        windows = np.flatnonzero(stop) + 1 - start
        parts = -(-windows // LONGEST)
        if len(parts) and parts.max() > 1:
            which = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            start, windows = np.repeat(start, parts) + which * LONGEST, np.minimum(np.repeat(windows, parts) - which * LONGEST, LONGEST)
        self.start, self.windows, self.key, self.twice = start, windows, key[start], place[start] != place[start + windows - 1]  # it never moves back
        self.anchor = place[start].astype(np.int64) - start
        end = start + windows + span - 1
        self.content = mixed((sums[end] - sums[start]) * back[start] + windows.astype(np.uint64))


def equal_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges from a and from b hold the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    same = text[ragged(a, length)] == text[ragged(b, length)]
    return np.logical_and.reduceat(same, np.cumsum(length) - length)


def repeated(key: np.ndarray, content: np.ndarray, length: np.ndarray, start: np.ndarray, doc: np.ndarray, place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each segment the one with the same key and bytes that starts first, in order of (doc, place); itself if it does."""
    order = np.lexsort((place, doc, length, content, key))
    k, c, n = key[order], content[order], length[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else first
    later = np.flatnonzero(first != np.arange(len(first)))
    wrong = later[~equal_bytes(text, start[later], start[first[later]], length[later])]
    first[wrong] = wrong  # unequal bytes with equal hashes stay apart
    return first


def beside(first: np.ndarray, doc: np.ndarray, tell: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Segments that start where their first one does but belong to another text of the same doc_id: one of each text.

    Neither is earlier than the other, so that what is removed of the one is removed of the other.
    """
    i = np.flatnonzero((first != np.arange(len(first))) & (doc == doc[first]) & (place == place[first]) & (tell != tell[first]))
    if len(i) < 2:
        return i
    order = np.lexsort((i, tell[i], first[i]))
    f, t = first[i][order], tell[i][order]
    return np.sort(i[order[np.concatenate([[True], (f[1:] != f[:-1]) | (t[1:] != t[:-1])])]])


class Chunk:
    """Pieces of documents, in order of (doc_id, place): up to ``CHUNK`` bytes, or one piece."""

    def __init__(self, pieces: list[tuple[int, int, int, bytes]], span: int, hot: np.ndarray | None = None):
        self.span = span
        self.doc, self.tell, self.at = (np.array(c, np.int64) for c in list(zip(*pieces, strict=True))[:3])
        sizes = np.array([len(p[3]) for p in pieces], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.text = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        s = self.segments = Segments(self.text, sizes, span, hot)
        self.piece = np.searchsorted(self.begin + sizes, s.start, "right")
        self.length = s.windows + span - 1
        self.place = self.at[self.piece] + s.start - self.begin[self.piece]
        doc, tell = self.doc[self.piece], self.tell[self.piece]
        self.first = repeated(s.key, s.content, self.length, s.start, doc, self.place, self.text)
        own = self.first == np.arange(len(self.first))
        own[beside(self.first, doc, tell, self.place)] = True
        self.kept = np.flatnonzero(own)

    def local(self) -> list[np.ndarray]:
        """Intervals (doc, tell, start, end) of segments that occur earlier in this chunk."""
        p, f = self.piece, self.first
        i = np.flatnonzero((f != np.arange(len(f))) & ((self.doc[p] != self.doc[p[f]]) | (self.place != self.place[f])))
        return joined(self.doc[p[i]], self.tell[p[i]], self.place[i], self.place[i] + self.length[i], self.span)


def joined(doc: np.ndarray, tell: np.ndarray, start: np.ndarray, end: np.ndarray, span: int) -> list[np.ndarray]:
    """Overlapping or touching intervals that follow each other, as one."""
    if not len(doc):
        return [doc, tell, start, end]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tell[1:] != tell[:-1]) | (start[1:] > end[:-1]) | (start[1:] < start[:-1])
    first = np.flatnonzero(new)
    return [doc[first], tell[first], start[first], np.maximum.reduceat(end, first)]


def chunks(batch: pa.RecordBatch, span: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Pieces of a batch's texts; a long text is cut so that each window lies in one piece."""
    rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), key=lambda r: r[:2])
    held, size, before = [], 0, None
    for doc, tell, text in rows:
        if (doc, tell) == before:  # the same row again: what goes for the first goes for it
            continue
        before, raw = (doc, tell), text.encode()
        for at in range(0, max(1, len(raw) - span + 1), CHUNK):
            piece = raw[at : at + CHUNK + span - 1]
            if len(piece) < span:
                continue
            if held and size + len(piece) > CHUNK + span:
                yield held
                held, size = [], 0
            held.append((doc, tell, at, piece))
            size += len(piece)
    if held:
        yield held


def shard_of(key: np.ndarray, n: int) -> np.ndarray:
    return (mixed(key + np.uint64(1)) % np.uint64(n)).astype(np.int64)


def split(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else []
    for a, b in zip(edges, [*edges[1:], len(s)], strict=True):
        yield int(s[a]), order[a:b]


def blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])


class Tally:
    """How many rows a task of the scan has read, and which: two scans deal out the rows alike if their tallies agree."""

    def __init__(self):
        self.rows, self.mark = 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.rows += batch.num_rows
        both = mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) + batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        self.mark ^= int(np.bitwise_xor.reduce(mixed(both))) if len(both) else 0

    def head(self) -> np.ndarray:
        return np.array([self.rows, self.mark], "<u8")


#: What a blob begins with: the task of the scan that it comes from, as a whole number of 8 bytes.
HEAD, PART_BYTES = -1, 8


def key_counts(docs: DataFrame, span: int, n_shards: int) -> DataFrame:
    """shard, blob: of each task, the keys of its segments, how many have them, and how many distinct ones in a chunk.

    Shard -1 - i has the tallies of tasks whose number is i modulo the shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, tally = [], [], 0, Tally()
        part = TaskContext.get().partitionId()
        said = part.to_bytes(PART_BYTES, "little")

        def flush() -> Iterator[pa.RecordBatch]:
            k, c = merge_counts(np.concatenate(keys), np.concatenate(counts))
            yield blobs([(s, said + squeeze(deltas(k[i]), (c[i] >> 32).astype("<u4"), c[i].astype("<u4"))) for s, i in split(shard_of(k, n_shards))])

        for batch in batches:
            tally.add(batch)
            for pieces in chunks(batch, span):
                chunk = Chunk(pieces, span)
                distinct = np.zeros(len(chunk.first), np.int64)
                distinct[chunk.kept] = 1
                k, c = merge_counts(chunk.segments.key, (distinct << 32) + 1 + chunk.segments.twice)  # both counts in one number
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 4_000_000:
                    yield from flush()
                    keys, counts, held = [], [], 0
        if held:
            yield from flush()
        if tally.rows:
            yield blobs([(HEAD - part % n_shards, said + tally.head().tobytes())])

    return docs.mapInArrow(run, "shard int, blob binary")


INDEX = "part int, blob binary, n_segments long, hot array<long>, n_hot array<long>"


def repeated_keys(counted: DataFrame, n_shards: int, hot_floor: int) -> DataFrame:
    """What is known of the keys: for each task of the scan (part) those of its keys that occur again; and rows with
    n_segments, hot, n_hot (keys that reach ``hot_floor``)."""

    def row(part: list[int | None], blob: list[bytes | None], n: int | None = None, hot: np.ndarray | None = None, n_hot: np.ndarray | None = None) -> pa.RecordBatch:
        more = len(part)
        columns = [pa.array(part, pa.int32()), pa.array(blob, pa.binary()), pa.array([n] * more, pa.int64()), pa.array([hot] * more, pa.list_(pa.int64())), pa.array([n_hot] * more, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "blob", "n_segments", "hot", "n_hot"])

    def step(shard: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [int.from_bytes(x[:PART_BYTES], "little") for x in held]
        if shard < 0:
            yield row(parts, [b"h" + x[PART_BYTES:] for x in held])
            return
        keys, counts = [], []
        for blob in held:
            d, distinct, n = expand(blob[PART_BYTES:], "<u8", "<u4", "<u4")
            keys.append(np.cumsum(d, dtype=np.uint64))
            counts.append((distinct.astype(np.int64) << 32) + n)
        k, both = merge_counts(np.concatenate(keys), np.concatenate(counts))
        c, n = both >> 32, both & 0xFFFFFFFF
        again = k[n > 1]
        big = c >= hot_floor
        yield row([None], [None], int(c.sum()), k[big].view(np.int64), c[big])
        for at in range(0, len(parts), 64):
            told = [(p, x[find(again, x) >= 0]) for p, x in zip(parts[at : at + 64], keys[at : at + 64], strict=True)]
            told = [(p, x) for p, x in told if len(x)]
            if told:
                yield row([p for p, _ in told], [b"k" + squeeze(deltas(x)) for _, x in told])

    return by_shard(counted, n_shards, step, INDEX)


def told_keys(index: DataFrame, n_parts: int, base: str) -> DataFrame:
    """Writes, for each task of the scan, the file of its tally and of its keys that occur again."""

    def step(part: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        head = next(x[1:] for x in held if x[:1] == b"h")
        keys = [np.cumsum(expand(x[1:], "<u8")[0], dtype=np.uint64) for x in held if x[:1] == b"k"]
        found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        write_array(base, np.concatenate([np.frombuffer(head, "<u8"), found]), f"{part}.keys")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    return by_shard(index.filter("part is not null").select(F.col("part").alias("shard"), "blob"), n_parts, step, "part int")


@contextmanager
def dealt_alike(spark: SparkSession):
    """Within, files are dealt out to tasks by their sizes alone, not by how many cores happen to be there."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


DTYPES = ("<u8", "<i8", "<i8", "<i8", "<u4", "<u4")


def moved_segments(docs: DataFrame, span: int, base: str, hot: np.ndarray, n_shards: int) -> DataFrame:
    """kind, shard, blob: the segments whose key occurs again, for their shards; and intervals that chunks found (kind 1).

    Each task reads the keys of its own part of the scan, and fails if its rows aren't those that were counted.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hot, tally, repeats, told = shared.value, Tally(), None, None
        compress = zstandard.ZstdCompressor(level=3).compress
        held, size = [], 0

        def flush() -> pa.RecordBatch | None:
            rows = []
            local = [np.concatenate(c) for c in zip(*(chunk.local() for chunk in held), strict=True)]
            if len(local[0]):
                rows.append((1, 0, squeeze(*(c.astype("<i8") for c in local))))
            key = np.concatenate([c.segments.key[c.kept] for c in held])
            owner = np.repeat(np.arange(len(held)), [len(c.kept) for c in held])
            index = np.concatenate([c.kept for c in held])
            for s, i in split(shard_of(key, n_shards)):
                i = i[np.argsort(key[i], kind="stable")]
                k = key[i]
                i = np.sort(i[(k >= TOP) | (find(repeats, k) >= 0)])
                if not len(i):
                    continue
                parts = [(held[o], index[i[owner[i] == o]]) for o in np.unique(owner[i])]
                columns = zip(*((c.segments.key[j], c.doc[c.piece[j]], c.tell[c.piece[j]], c.place[j], c.length[j] + TWICE * c.segments.twice[j], c.segments.anchor[j]) for c, j in parts), strict=True)
                head = squeeze(*(np.concatenate(c).astype(t) for c, t in zip(columns, DTYPES, strict=True)))
                body = compress(b"".join(c.text[ragged(c.segments.start[j], c.length[j])].tobytes() for c, j in parts))
                rows.append((0, s, len(head).to_bytes(4, "little") + head + body))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "shard", "blob"]) if rows else None

        for batch in batches:
            if told is None:
                file = open_array(f"{base}/{TaskContext.get().partitionId()}.keys", "<u8")
                told, repeats = file[:2], file[2:]
            tally.add(batch)
            for pieces in chunks(batch, span):
                held.append(Chunk(pieces, span, hot))
                size += len(held[-1].text)
                if size >= FLUSH:
                    if (out := flush()) is not None:
                        yield out
                    held, size = [], 0
        if held and (out := flush()) is not None:
            yield out
        if tally.rows and tally.head().tolist() != told.tolist():
            raise RuntimeError("the table was dealt out to tasks in another way than before: write it first, and deduplicate what was written")

    return docs.mapInArrow(run, "kind int, shard int, blob binary")


def later_windows(text: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, tell: np.ndarray, place: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of the windows that start earlier in another place; segments are in order of (doc, place).

    So are the windows of different segments, but for those of several texts with one doc_id.  Separators are symbol 1, the end is 0: no window holds either.
    """
    size = length + 1
    begin = np.cumsum(size) - size
    t = np.ones(int(size.sum()) + 1, np.int32)
    t[ragged(begin, length)] = text[ragged(start, length)].astype(np.int32) + 2
    t[-1] = 0
    sa = suffix_array(t, 258)
    windows = length - span + 1
    lcp = permuted_lcp(t, sa, begin, windows, span)[sa]
    group = np.flatnonzero(np.concatenate([[True], lcp[1:] < span]))
    head = np.minimum.reduceat(sa, group)
    sizes = np.diff(np.append(group, len(sa)))
    if ((doc[1:] == doc[:-1]) & (tell[1:] != tell[:-1])).any():
        many = np.flatnonzero(sizes > 1)
        i = ragged(group[many], sizes[many])
        at, of = sa[i].astype(np.int64), np.repeat(many, sizes[many])
        s = np.searchsorted(begin, at, "right") - 1
        order = np.lexsort((place[s] + at - begin[s], doc[s], of))
        head[many] = at[order][np.cumsum(sizes[many]) - sizes[many]]
    head = np.repeat(head, sizes)
    later = sa != head
    at, head = sa[later].astype(np.int64), head[later].astype(np.int64)
    s, f = np.searchsorted(begin, at, "right") - 1, np.searchsorted(begin, head, "right") - 1
    window = at - begin[s]
    apart = (doc[s] != doc[f]) | (place[s] + window != place[f] + head - begin[f])
    s, window = s[apart], window[apart]
    order = np.lexsort((window, s))
    return s[order], window[order]


def _intervals(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.int64)), pa.array(columns[3].astype(np.int64))], names=["doc", "tell", "start", "end"])


INTERVALS = "doc long, tell long, start long, end long"


def shard_intervals(moved: DataFrame, n_shards: int, span: int) -> DataFrame:
    """Intervals to remove, found in the shards' suffix arrays."""

    def step(shard: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        import zstandard

        heads, bodies = [], []
        for blob in held:
            n = int.from_bytes(blob[:4], "little")
            heads.append(expand(blob[4 : 4 + n], *DTYPES))
            bodies.append(zstandard.ZstdDecompressor().decompress(blob[4 + n :]))
        key, doc, tell, place, length, anchor = (np.concatenate([h[i] for h in heads]) for i in range(6))
        text, twice, length = np.frombuffer(b"".join(bodies), np.uint8), length >= TWICE, length.astype(np.int64) % TWICE
        del heads, bodies
        start = np.cumsum(length) - length
        order = np.lexsort((place, doc, key))  # keys that only one segment has here can't match
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        again = np.repeat(np.diff(np.append(np.flatnonzero(new), len(order))) > 1, np.diff(np.append(np.flatnonzero(new), len(order))))
        i = np.sort(order[again | twice[order]])
        i = i[np.lexsort((place[i], doc[i]))]
        key, doc, tell, place, length, start, twice, anchor = (x[i] for x in (key, doc, tell, place, length, start, twice, anchor))
        if not len(i):
            return
        content = hashes(text, start, length)
        first = repeated(key, content, length, start, doc, place, text)
        mine = np.arange(len(first))
        later = np.flatnonzero((first != mine) & ((doc != doc[first]) | (place != place[first])))
        twin = beside(first, doc, tell, place)
        twin = twin[np.argsort(first[twin], kind="stable")]
        yield _intervals(joined(doc[later], tell[later], place[later], place[later] + length[later], span))
        alone = np.flatnonzero(first == mine)
        _, inverse, count = np.unique(key[alone], return_inverse=True, return_counts=True)
        alone = alone[(count[inverse] > 1) | twice[alone]]
        alone = alone[can_match(text, key[alone], start[alone], length[alone], anchor[alone].astype(np.int64), twice[alone], span)]
        if not len(alone):
            return
        # A key's segments stay together; keys are dealt out in parts of a bounded size, each with an array of its own
        by_key = alone[np.lexsort((alone, key[alone]))]
        edges = np.cumsum(length[by_key]) // PART
        starts = np.flatnonzero(np.concatenate([[True], key[by_key][1:] != key[by_key][:-1]]))
        part = np.repeat(edges[starts], np.diff(np.append(starts, len(by_key))))
        for _, members in split(part):
            m = np.sort(by_key[members])
            s, window = later_windows(text, start[m], length[m], doc[m], tell[m], place[m], span)
            at = place[m][s] + window
            found = joined(doc[m][s], tell[m][s], at, at + span, span)
            yield _intervals(found)
            if len(twin) and len(s):  # other texts of a doc_id with the same segment at the same place
                low, high = np.searchsorted(first[twin], m[s]), np.searchsorted(first[twin], m[s], "right")
                more = twin[ragged(low, high - low)]
                at = np.repeat(at, high - low)
                yield _intervals([doc[more], tell[more], at, at + span])

    return by_shard(moved.filter("kind = 0").select("shard", "blob"), n_shards, step, INTERVALS)


def can_match(text: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray, twice: np.ndarray, span: int) -> np.ndarray:
    """Which segments can share a window with another one of their key.

    Equal windows agree on the anchor's place, and reach at least half of what a window has besides the anchor to its
    left or to its right: so segments that can match have equal bytes there.  Where an anchor moves within one of a
    key's segments, all of the key's stay.
    """
    half = (span - GRAM) // 2
    keep = np.isin(key, key[twice])
    for low, there in ((anchor - half, anchor >= half), (anchor + GRAM, anchor + GRAM + half <= length)):
        i = np.flatnonzero(there)
        if len(i):
            side = mixed(hashes(text, start[i] + low[i], np.full(len(i), half)) ^ key[i])
            _, inverse, count = np.unique(side, return_inverse=True, return_counts=True)
            keep[i] |= count[inverse] > 1
    return keep


#: Bytes of segments that one suffix array holds, about: a key's segments are never parted.
PART = 4 << 20


def hashes(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A content hash of each range; ranges lie one after the other but may have gaps."""
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(start), 20_000):
        s, n = start[at : at + 20_000], length[at : at + 20_000]
        part = text[ragged(s, n)]
        power, back = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_GEAR[part] * power[: len(part)], out=sums[1:])
        end = np.cumsum(n)
        out[at : at + 20_000] = mixed((sums[end] - sums[end - n]) * back[end - n] + n.astype(np.uint64))
    return out


def local_intervals(moved: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            parts = [expand(b.as_py(), "<i8", "<i8", "<i8", "<i8") for b in batch.column(0)]
            return _intervals([np.concatenate([p[i] for p in parts]) for i in range(4)]) if parts else None

        return step

    return map_arrow(moved.filter("kind = 1").select("blob"), make, INTERVALS)


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the intervals; how many went, in how many runs."""
    kept, removed, runs, at = [], 0, 0, -1
    for start, end in sorted(spans):
        if start > at or at < 0:
            kept.append(raw[max(at, 0) : start])
            runs += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    kept.append(raw[max(at, 0) :])
    return b"".join(kept), removed, runs


OUTPUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_substrings(df: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, shard_bytes: int = 24 << 20, hot_share: float = 2e-7, hot_floor: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the checksum of what is left; ``with_kept`` adds the bytes left (kept).

    A key is hot if at least ``hot_floor`` segments and ``hot_share`` of all have it, so that at most
    1 / ``hot_share`` hot keys are broadcast, whatever the input.
    """
    if not GRAM + 8 <= span <= LONGEST_SPAN:
        raise ValueError(f"span must lie between {GRAM + 8} and {LONGEST_SPAN}")
    spark = prepare(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(NULL)), "tell": F.xxhash64("text")})
    scan = docs.filter(F.octet_length("text") >= span).select("doc", "tell", "text")
    if "Exchange" in scan._jdf.queryExecution().executedPlan().toString():  # it is read twice, and must be dealt out alike
        scan = written(scan, "texts")
    total = scan.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    base = fresh_dir(spark, "keys")
    n_shards = max(4, -(-total // shard_bytes))
    with dealt_alike(spark):
        counted = key_counts(scan, span, n_shards)
        n_parts = counted.rdd.getNumPartitions()
        index = written(repeated_keys(counted, n_shards, hot_floor), "keys-index")
        n_segments = index.agg(F.coalesce(F.sum("n_segments"), F.lit(0)).alias("n")).first().n
        least_hot = max(hot_floor, int(n_segments * hot_share))
        crowded = index.select(F.explode(F.arrays_zip("hot", "n_hot")).alias("h")).filter(F.col("h.n_hot") >= least_hot).select("h.hot").collect()
        hot = np.array(sorted(r.hot for r in crowded), np.int64).view(np.uint64)
        told_keys(index, n_parts, base).agg(F.count("*")).collect()
        moved = written(moved_segments(scan, span, base, hot, n_shards), "segments")
    remove(spark, base)
    release(index)
    gone = written(shard_intervals(moved, n_shards, span).unionByName(local_intervals(moved)), "intervals")
    release(moved)
    spans = gone.groupBy("doc", "tell").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = docs.join(spans.hint("shuffle_hash"), ["doc", "tell"], "left").select("doc_id", "text", "spans")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                kept, removed, runs = cut(raw, [(s["start"], s["end"]) for s in spans or ()])
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            n, removed, runs, sha, kept = zip(*out, strict=True) if out else [[]] * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = [c.split()[0] for c in OUTPUT.split(", ")]
            if with_kept:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    return map_arrow(both, make, OUTPUT + (", kept binary" if with_kept else ""))
