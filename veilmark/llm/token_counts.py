"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come out as one token are proven.  On the
executors a pre-token that is proven counts one, by a set lookup; only the rest is merged.  Space-delimited
chunks are memoised with their counts, so that each distinct chunk is looked at once in a while.

Defined results: null or empty text has 0 bytes and 0 tokens; ids may be null or repeated (one row each);
other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import map_arrow, prepare, texts
from .bpe import MEMO, PATTERN, Vocabulary, chunks

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_whole long, over_limit boolean"


class Counter:
    """Counts tokens of texts; ``proven`` strings need no merging."""

    def __init__(self, vocabulary: Vocabulary, proven: frozenset[str]):
        self.proven, self.encode, self.cut = proven, vocabulary.encoding().encode_ordinary, vocabulary.splitter()
        self.special, self.pretokens, self.memo = frozenset(vocabulary.special), regex.compile(PATTERN).findall, {}

    def chunk(self, chunk: str) -> tuple[int, int]:
        """Tokens, and those that the shortcut gave."""
        proven = self.proven
        if chunk in proven:
            return 1, 1
        tokens = whole = 0
        for p in self.pretokens(chunk):
            if p in proven:
                tokens += 1
                whole += 1
            else:
                tokens += len(self.encode(p))
        return tokens, whole

    def count(self, text: str) -> tuple[int, int]:
        if self.cut and any(s in text for s in self.special):
            pieces = self.cut.split(text)
        else:
            pieces = [text]
        tokens = whole = 0
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for piece in pieces:
            if piece in self.special:
                tokens += 1
                continue
            for c in chunks(piece):
                got = memo.get(c)
                if got is None:
                    got = self.chunk(c)
                    if len(c) < 64:
                        memo[c] = got
                tokens += got[0]
                whole += got[1]
        return tokens, whole


def token_counts(df: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: bytes, tokens, tokens by the shortcut, and whether tokens exceed ``limit``.

    ``tokenizer`` is a byte-level vocabulary file that each executor can read.  The proof runs on the driver
    over the vocabulary (its size is that of the file, whatever the input) and is broadcast.
    """
    spark = prepare(df.sparkSession)
    proven = spark.sparkContext.broadcast(Vocabulary(tokenizer).proven())

    def make():
        counter = Counter(Vocabulary(tokenizer), proven.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = texts(batch.column(1))
            counts = [counter.count(t) for t in rows]
            tokens = [c[0] for c in counts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(tokens, pa.int64()), pa.array([c[1] for c in counts], pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "n_whole", "over_limit"],
            )

        return step

    return map_arrow(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")), make, SCHEMA)
