"""Dictionary-compressed WARC archives: writing pages as records, and reading them back.

A Zstandard dictionary is trained on a bounded sample of the payloads: the ``sample_rows`` rows whose hash is least,
of long payloads a part at a place given by the hash.  Where they are too few to train on, what was sampled is the
dictionary itself (raw content).  Each archive (``.warc.zst``) begins with
a skippable frame that holds the dictionary, then has one frame per record: a warcinfo record, then responses and
revisits, so that any record can be read by itself.  Pages with equal payloads of at least ``min_revisit_bytes``
bytes keep one response, that with the largest id; the others are revisit records that refer to it.

Archives go to the folder that driver and executors share, under names that no other task uses; a manifest,
committed by Spark, lists those of the tasks that succeeded, and readers follow the manifest alone.

Defined results: a null html is an empty payload; a null id is smaller than any other and its record has no id;
rows that repeat the largest id of their payload are all responses; line breaks in URLs are percent-encoded and
null URLs left out; an empty table gives no archives and no rows; columns other than id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh_dir, prepare, written
from .arrays import store_of

#: Fixed values of the WARC and Zstandard formats.
MAGIC_DICTIONARY = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:veilmark:page:"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
READ = 1 << 14

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"


def train_dictionary(pages: DataFrame, sample_rows: int, sample_chars: int, size: int) -> bytes:
    """A dictionary from at most ``sample_rows`` payloads (columns page_id, url, html), of each at most ``sample_chars`` characters."""
    import zstandard

    h = F.xxhash64("page_id", "url")
    at = F.pmod(h, F.greatest(F.length("html") - sample_chars + 1, F.lit(1))) + 1
    some = pages.filter("html <> ''")
    # the hashes alone go through the tasks' sorted lists; payloads are read for those that won
    last = some.select(h.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h").alias("h")).first().h
    rows = [] if last is None else some.filter(h <= last).select(h.alias("h"), F.substring(F.col("html"), at.cast("int"), F.lit(sample_chars)).alias("x")).limit(sample_rows).collect()
    rows.sort()
    samples = [r.x.encode() for r in rows]
    try:
        if len(samples) >= 8:
            return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        pass
    return (b"".join(samples) + HTTP_HEAD.encode())[-size:]


def record(kind: str, block: bytes, headers: list[tuple[str, str]], date: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response, or a revisit without the payload but with its length and digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [] if page_id is None else [("WARC-Record-ID", f"<{RECORD_ID}{page_id}>")]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head = HTTP_HEAD.format(len(payload)).encode()
    if not revisit:
        return record("response", head + payload, headers, date)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>")]
    return record("revisit", head, headers, date)


class Archive:
    """One archive being written."""

    def __init__(self, base: str, dictionary: bytes, level: int, date: str):
        import zstandard

        self.path = f"{base}/{uuid.uuid4().hex}.warc.zst"
        self.store, self.place = store_of(self.path)
        self.out = self.store.open_output_stream(self.place, compression=None)
        learned = zstandard.ZstdCompressionDict(dictionary)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=learned, write_checksum=True).compress
        self.records = self.bytes = 0
        self._write(struct.pack("<II", MAGIC_DICTIONARY, len(dictionary)) + dictionary)
        self._write(self.compress(record("warcinfo", b"software: veilmark\r\nformat: WARC File Format 1.1\r\n", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], date)))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes

    def discard(self) -> None:
        self.out.close()
        self.store.delete_file(self.place)


def write_warc(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = 32 << 20, level: int = 3, sample_rows: int = 400, sample_chars: int = 16384, dictionary_bytes: int = 65536, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row; returns the committed manifest (path, records, bytes).

    Payloads are shuffled once, to meet the id that stays; a payload that a large part of all rows share has as
    many rows, which Spark's skew join splits.
    """
    spark = prepare(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    heads = rows.groupBy("sha").agg(F.max("page_id").alias("head"))
    placed = rows.join(heads.hint("shuffle_hash"), "sha").select("page_id", "url", "html", "head")
    dictionary = spark.sparkContext.broadcast(train_dictionary(rows, sample_rows, sample_chars, dictionary_bytes))
    base = fresh_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        try:
            for batch in batches:
                for page_id, url, html, head in zip(*(batch.column(i) for i in range(4)), strict=True):
                    number, payload = page_id.as_py(), html.as_py().encode()
                    kept = head.as_py()
                    revisit = len(payload) >= min_revisit_bytes and kept is not None and number != kept
                    if archive is None:
                        archive = Archive(base, dictionary.value, level, date)
                    archive.add(page_record(number, url.as_py(), payload, kept, revisit, date))
                    if archive.bytes >= archive_bytes:
                        done.append(archive.close())
                        archive = None
            if archive is not None:
                done.append(archive.close())
        except BaseException:
            if archive is not None:
                archive.discard()
            raise
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return written(placed.mapInArrow(run, MANIFEST), "manifest")


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    import zstandard

    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC_DICTIONARY:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
    context = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        frame, out = context.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise EOFError("the archive ends within a record")
            part = view[at : at + READ]
            out.append(frame.decompress(part))
            at += len(part)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def page_number(urn: str | None) -> int | None:
    return int(urn.strip("<>").removeprefix(RECORD_ID)) if urn else None


def read_warc(manifest: DataFrame, with_html: bool = True) -> DataFrame:
    """All page records of the manifest's archives.

    A response's digest and length are computed from the payload that was read; a revisit's are those of its
    headers, and its html is null.  One archive at a time is held in memory.
    """
    spark = prepare(manifest.sparkSession)
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = store_of(path)
                with store.open_input_stream(place, compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                for item in records(data):
                    headers, block = parse(item)
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    html = payload.decode() if with_html and kind == "response" else None
                    rows.append((page_number(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind, size, digest, page_number(headers.get("warc-refers-to")), html))
                    held += len(html or "")
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    parts = min(n, 4 * spark.sparkContext.defaultParallelism * 64)
    return manifest.select("path").repartition(parts).mapInArrow(run, RECORDS)


def oracle_sql(min_revisit_bytes: int = 0) -> str:
    """What is read back, in DuckDB SQL: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hx FROM pages),
h AS (SELECT hx, max(page_id) AS head FROM p GROUP BY hx),
b AS (SELECT hx, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hx[i]) - 1), 4, '0')), '') AS bits FROM h),
e AS (SELECT hx, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1
        + 16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT + 4 * bits[5*i+3]::INT + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT]), '') AS payload_digest FROM b)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, e.payload_digest,
  CASE WHEN payload_bytes >= {min_revisit_bytes} AND p.page_id IS DISTINCT FROM head AND head IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {min_revisit_bytes} AND p.page_id IS DISTINCT FROM head AND head IS NOT NULL THEN head END AS refers_to
FROM p JOIN h USING (hx) JOIN e USING (hx)
"""
