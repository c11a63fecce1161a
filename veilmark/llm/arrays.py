"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers; and compact shuffling of them.

An array is a raw little-endian file.  Where the shared folder is a mounted path workers map it, so that they share
its pages and hold none of it themselves; in another store the array is read whole.  A worker keeps at most ``OPEN``
arrays open, whatever their number: callers ask for them shard by shard.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import prepare

#: Arrays that a worker keeps open.  A mapped one holds a file handle at most.
OPEN = 64
_open: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()
#: Names that Hadoop and Arrow give to one store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}
KNOWN = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")


def store_of(path: str):
    """Arrow's file system for a full path of the shared folder, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    if not colon:
        raise ValueError(f"{path} isn't a full path")
    scheme = SCHEMES.get(scheme, scheme)
    if scheme not in KNOWN:
        raise ValueError(f"arrays and archives can't be kept in a {scheme} store: let spark.checkpoint.dir be a mounted path, or one of {', '.join(KNOWN)}")
    return fs.FileSystem.from_uri(f"{scheme}://{rest}")


def write_array(base: str, array: np.ndarray, name: str | None = None) -> str:
    """Write an array; returns the path.

    Without a name it gets one that no other task uses.  With one the file appears whole, by renaming; a second try
    of the same task writes the same bytes.
    """
    path = f"{base}/{uuid.uuid4().hex}.bin"
    store, place = store_of(path)
    with store.open_output_stream(place, compression=None) as f:
        f.write(np.ascontiguousarray(array).data if len(array) else b"")
    if name is None:
        return path
    target = f"{base}/{name}"
    try:
        store.move(place, store_of(target)[1])
    except OSError:  # stores that don't replace: an earlier try's file is the same
        if store.get_file_info(store_of(target)[1]).type.name != "File":
            raise
        store.delete_file(place)
    return target


def _map(place: str, dtype: str) -> np.ndarray:
    """Map a local file; the handle is closed where Python can (from 3.13 on)."""
    handle = os.open(place, os.O_RDONLY)
    try:
        try:
            held = mmap.mmap(handle, 0, access=mmap.ACCESS_READ, trackfd=False)
        except TypeError:
            held = mmap.mmap(handle, 0, access=mmap.ACCESS_READ)
    finally:
        os.close(handle)
    return np.frombuffer(held, dtype)


def open_array(path: str, dtype: str) -> np.ndarray:
    """The array at a path; empty for an empty path.  The last ``OPEN`` ones stay open."""
    from pyarrow import fs

    if not path:
        return np.zeros(0, dtype)
    if (path, dtype) in _open:
        _open.move_to_end((path, dtype))
        return _open[path, dtype]
    store, place = store_of(path)
    if isinstance(store, fs.LocalFileSystem):
        found = _map(place, dtype) if os.path.getsize(place) else np.zeros(0, dtype)
    else:
        with store.open_input_file(place) as f:
            found = np.frombuffer(f.read(), dtype)
    _open[path, dtype] = found
    while len(_open) > OPEN:
        _open.popitem(last=False)
    return found


def find(sorted_array: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Where each value of the sorted ``query`` lies in the array; -1 if it isn't there."""
    if not len(sorted_array) or not len(query):
        return np.full(len(query), -1, np.int64)
    at = np.searchsorted(sorted_array, query)
    at[at == len(sorted_array)] = 0
    return np.where(sorted_array[at] == query, at, -1)


def squeeze(*columns: np.ndarray) -> bytes:
    """Arrays of one length, as bytes: each split in byte planes, which compress well when values are sorted or small."""
    import zstandard

    parts = [np.array([len(columns[0])], "<u8").tobytes()]
    for c in columns:
        parts.append(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() if len(c) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expand(data: bytes, *dtypes: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, "<u8", 1)[0]), 8, []
    for d in dtypes:
        size = np.dtype(d).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(d).reshape(n))
        at += n * size
    return out


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def by_shard(df: DataFrame, n: int, step: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring together the blobs of each shard (columns shard, blob) and apply ``step`` to one shard at a time.

    Shard i goes to partition i: no two share a task.  Blobs are already merged in the task that made them, so a key
    has one entry per task at most, however frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != shard:
                    if held:
                        yield from step(shard, held)
                    shard, held = s, []
                held.append(blob.as_py())
        if held:
            yield from step(shard, held)

    prepare(df.sparkSession)
    return df.repartitionById(n, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)
