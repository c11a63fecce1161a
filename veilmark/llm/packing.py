"""Sequence packing by concatenation and cutting.

Pass one tokenises each document once, numbers its tokens within the task's partition and writes the ids.
Partition totals, summed in order, give every partition its global offset; a document's tokens then have global
positions, and fixed windows cut them.  A document that crosses a window's edge gets a boundary record per
window.  All sequences but the last are full, so padding is below one window for the whole corpus.

Defined results: null or empty text is the end id alone; repeated rows are packed once each; null ids are kept;
an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, texts, written
from .bpe import MEMO, Vocabulary, chunks

#: Up to this many partition totals are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_PARTS = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Texts to ids, as the library gives them without added special tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.encode, self.cut, self.special = vocabulary.encoding().encode_ordinary, vocabulary.splitter(), vocabulary.special
        self.dtype = np.dtype("<u2" if vocabulary.size <= 65536 else "<u4")
        self.memo: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        """The ids as little-endian numbers of ``dtype``."""
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        pieces = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        for piece in pieces:
            if piece in self.special:
                out.append(np.array([self.special[piece]], self.dtype).tobytes())
                continue
            for c in chunks(piece):
                got = memo.get(c)
                if got is None:
                    got = np.array(self.encode(c), self.dtype).tobytes()
                    if len(c) < 64:
                        memo[c] = got
                out.append(got)
        return b"".join(out)


def tokenized(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """part, at (tokens before the document in its partition), doc_id, n_tokens, ids."""

    def make():
        encoder, part, at = Encoder(Vocabulary(tokenizer)), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype).tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal at
            ids = [encoder.raw(t) + end for t in texts(batch.column(1))]
            n = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), batch.column(0).cast(pa.int64()), pa.array(n), pa.array(ids, pa.binary())], names=["part", "at", "doc_id", "n_tokens", "ids"])

        return step

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return map_arrow(rows, make, "part long, at long, doc_id long, n_tokens long, ids binary")


def pack(df: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and a checksum of its ids.

    ``with_ids`` adds the ids themselves (array<int>).  The only rows that meet in one task are the partition
    totals: one for each task of the first pass.
    """
    width = 2 if Vocabulary(tokenizer).size <= 65536 else 4
    first_pass = tokenized(df, tokenizer, end_id, id_col, text_col)
    n_parts = first_pass.rdd.getNumPartitions()
    rows = written(first_pass, "pack")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if n_parts <= BROADCAST_PARTS else bases  # a row of two numbers for each partition
    placed = rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "n_tokens", "ids")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            first, last = at // window, (at + n - 1) // window
            k = last - first + 1
            row = np.repeat(np.arange(len(n)), k)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            begin, end = np.maximum(at[row], sequence * window), np.minimum((at + n)[row], (sequence + 1) * window)
            start, raw = begin - at[row], batch.column(3)
            ids, sums, pieces, of = None, [], [], -1
            for r, s, e in zip(row.tolist(), start.tolist(), (end - at[row]).tolist(), strict=True):
                if r != of:
                    ids, of = np.frombuffer(raw[r].as_buffer(), f"<u{width}").astype("<u4"), r
                sums.append(zlib.crc32(ids[s:e].tobytes()))
                if with_ids:
                    pieces.append(ids[s:e].astype(np.int32))
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(sums, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * window)]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    return map_arrow(placed, make, PIECES + (", ids array<int>" if with_ids else ""))
