"""WARC archives through a chunked record table (operator 7).

A payload travels as rows ``(record, chunk number, bytes)`` of at most ``CHUNK``
bytes, both when it is written and when it is read back; no step holds a whole
record's payload besides the input row itself.  In the file a payload of several
chunks is a segmented record (WARC 1.1, "continuation"): the first chunk is the
``response``, every further chunk a ``continuation`` with its segment number and
origin, the last with the total length.  Digests are computed incrementally over
the chunks as they are read and compared with the headers.

Writing uses Spark's text writer with the record terminator as line separator,
one gzip member per file, so the archives lie wherever Spark can write and a
repeated task replaces its own file.  Reading uses Spark's text reader with the
same separator; a file is read in order by one task as a stream of pieces, and
records are found by their Content-Length, so payloads that contain the
separator, or a whole archive, come back unchanged.

Equal payloads: the record with the smallest id is the response, others of at
least ``min_bytes`` are revisits that refer to it.  Payloads are equal by length,
SHA-1 and SHA-256; they are grouped by these narrow keys with partial sums, and
the decision joins back on them, so a payload shared by a third of all pages is
no single task's work.

Defined results: null payloads are empty; rows that repeat both id and payload
are the same record, each is written alike; a null id sorts last; null urls have
no target header; header values lose control characters; an empty table gives
an archive without records, which reads back as an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webrel.llm.common import checkpoint_dir

CHUNK = 1 << 15   # an Arrow batch holds 10,000 rows: at most 320 MB of chunks
# --- fixed values -----------------------------------------------------------
END = "\r\n\r\n"                                  # ends the header, and the record
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"       # RFC 4648
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"       # digits of numbers to the base 32
EMPTY_TIME = "1970-01-01T00:00:00Z"               # captures without a time
# ---------------------------------------------------------------------------


def base32_sha1(data: Column) -> Column:
    """SHA-1 as upper-case base32: 20 bits (5 hex digits) are 4 letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = 0) -> DataFrame:
    """One row per record: id, url, payload, length, digest, type and refers_to."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"))
    same = ["length", "digest", "sha256"]
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("length"), base32_sha1(F.col("payload")).alias("digest"),
                       F.unhex(F.sha2("payload", 256)).alias("sha256"))
    first = (rows.where(F.col("length") >= min_bytes).groupBy(*same)
             .agg(F.min(F.struct(F.col("key").isNull().alias("z"), "key", "id")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(*same, "first"))
    out = rows.join(first, same, "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first.key"))
    return out.select("id", "url", "payload", "length", "digest",
                      F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("type"),
                      F.when(revisit, F.col("first.id")).alias("refers_to"))


def _uri(c: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.url_encode(c))), F.lit(">"))


def chunk_table(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as rows of at most ``chunk`` bytes: + ``no`` (from 1), ``chunks``, ``data``."""
    chunks = F.when(F.col("type") == "revisit", F.lit(1)).otherwise(
        F.greatest(F.ceil(F.col("length") / chunk), F.lit(1))).cast("int")
    out = rows.withColumn("chunks", chunks).withColumn("no", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
    data = F.when(F.col("type") != "revisit", F.substring("payload", (F.col("no") - 1) * chunk + 1, F.lit(chunk)))
    return out.withColumn("data", data).drop("payload")


def write(chunks: DataFrame, path: str) -> None:
    """Write a chunk table as gzip WARC files below ``path``.  The chunks of a
    record follow each other in a file, as ``chunk_table`` leaves them."""
    no, many, first = F.col("no"), F.col("chunks") > 1, F.col("no") == 1

    def line(name, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    http = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                  F.col("length").cast("string"), F.lit(END))).otherwise(F.lit(""))
    data = F.coalesce(F.col("data"), F.lit(b""))
    size = F.octet_length(http) + F.octet_length(data)
    record = _uri(F.col("id"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first, F.col("type")).otherwise(F.lit("continuation"))),
        line("WARC-Record-ID", F.when(first, record).otherwise(F.regexp_replace(record, ">$", F.concat(F.lit("/"), no.cast("string"), F.lit(">"))))),
        line("WARC-Date", F.lit(EMPTY_TIME)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1f]", ""), F.col("url").isNotNull() & first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Refers-To", _uri(F.col("refers_to")), F.col("type") == "revisit"),
        line("WARC-Segment-Number", no, many),
        line("WARC-Segment-Origin-ID", record, ~first),
        line("WARC-Segment-Total-Length", F.col("length"), many & (no == F.col("chunks"))),
        line("Content-Type", F.lit("application/http; msgtype=response"), first),
        line("Content-Length", size), F.lit("\r\n"))
    (chunks.select(F.concat(header, http, data.cast("string")).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").text(path))


class _Stream:
    """Records of one file from the pieces between its separators."""

    def __init__(self):
        self.buffer, self.pieces = bytearray(), 0
        self.head: dict[str, str] | None = None
        self.record: dict | None = None   # the payload that is being read

    def feed(self, piece: bytes) -> Iterator[dict]:
        if self.pieces:
            self.buffer += END.encode()
        self.pieces += 1
        self.buffer += piece
        yield from self.parse()

    def finish(self) -> Iterator[dict]:
        self.buffer += END.encode()
        yield from self.parse()
        if self.head is not None or bytes(self.buffer).strip(b"\r\n") or self.record is not None:
            raise ValueError("the archive ends inside a record")

    def parse(self) -> Iterator[dict]:
        while True:
            if self.head is None:
                start = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
                end = self.buffer.find(END.encode(), start)
                if end < 0:
                    return
                lines = self.buffer[start:end].decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record begins at {lines[0][:40]!r}")
                self.head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
                del self.buffer[:end + len(END)]
            size = int(self.head["content-length"])
            if len(self.buffer) < size:
                return
            block = bytes(memoryview(self.buffer)[:size])
            del self.buffer[:size]
            head, self.head = self.head, None
            yield self.chunk(head, block)

    def chunk(self, head: dict[str, str], block: bytes) -> dict:
        if head["warc-type"] != "continuation":
            if self.record is not None:
                raise ValueError("a segmented record has no end")
            http, _, block = block.partition(END.encode())
            length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
            self.record = {"record": head["warc-record-id"], "type": head["warc-type"], "refers_to": head.get("warc-refers-to"),
                           "url": head.get("warc-target-uri"), "length": length, "no": 0, "read": 0,
                           "digest": head["warc-payload-digest"].removeprefix("sha1:"), "sha1": hashlib.sha1()}
        r = self.record
        if r is None or (r["no"] and head["warc-segment-origin-id"] != r["record"]):
            raise ValueError("a continuation does not follow its record")
        r["no"] += 1
        r["read"] += len(block)
        r["sha1"].update(block)
        last = "warc-segment-number" not in head or "warc-segment-total-length" in head
        if last:
            self.record = None
            if r["type"] != "revisit" and (r["read"] != r["length"] or base64.b32encode(r["sha1"].digest()).decode() != r["digest"]):
                raise ValueError(f"payload of {r['record']} does not fit its digest")
        return {k: r[k] for k in ("record", "type", "refers_to", "url", "length", "digest", "no")} | {"last": last, "data": block}


_SCHEMA = "record string, type string, refers_to string, url string, length long, digest string, no int, last boolean, data binary"
_ARROW = pa.schema([(n, t) for n, t in zip(
    ("record", "type", "refers_to", "url", "length", "digest", "no", "last", "data"),
    (pa.string(),) * 4 + (pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary()), strict=True)])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, stream, out, held = None, None, [], 0
    for batch in batches:
        for file, piece in zip(batch.column(0), batch.column(1), strict=True):
            if (file := file.as_py()) != name:
                out += stream.finish() if stream else []
                name, stream = file, _Stream()
            for row in stream.feed(piece.as_py()):
                out.append(row)
                held += len(row["data"])
            if held > 4 * CHUNK or len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
                out, held = [], 0
    out += stream.finish() if stream else []
    if out:
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Chunk table of the archives below ``path``; payload digests are verified.
    ``id`` and ``refers_id`` are the record ids as written."""
    pieces = spark.read.option("lineSep", END).option("recursiveFileLookup", "true").text(path)
    rows = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(_read, _SCHEMA)

    def plain(c):
        return F.when(F.col(c).startswith("<urn:record:v"), F.url_decode(F.regexp_replace(c, "^<urn:record:v|>$", "")))

    return rows.withColumn("id", plain("record")).withColumn("refers_id", plain("refers_to"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = 0, chunk: int = CHUNK, path: str | None = None) -> str:
    """Write the pages' archive (below the shared folder unless ``path`` is given) and return where."""
    path = path or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    write(chunk_table(records(pages, id_col, url_col, payload_col, min_bytes), chunk), path)
    return path
