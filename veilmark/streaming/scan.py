"""Scanning a stream of documents with the pattern detector: the batch operator, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.spans import regex_spans


def scan_stream(docs: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", once: bool = True) -> StreamingQuery:
    """Write a row per span found in new documents; exactly once, by the sink's and the source's logs."""
    spans = docs.select(F.col(id_col), F.explode(regex_spans(F.col(text_col))).alias("s")).select(id_col, "s.*")
    writer = spans.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
