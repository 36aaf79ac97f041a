"""WARC archives without repeated payloads.

Headers are shuffled by payload digest; of each digest's records one stays a response and the others
become revisit records that refer to it.  Archives are written by Spark's own text writer, whose line
separator is the end of a WARC record, so tasks commit their files like any other output and lost
executors cost a retry.  Files are read as streams of text that is cut at the same separator and put
together again; reading follows each record's Content-Length and holds a record, never a file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.scratch import Scratch

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Records in one file at most; a gzip file is read by one task.
FILE_RECORDS = 8000


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: ten hex digits at a time are eight digits of base 32."""
    hexadecimal = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_headers(pages: DataFrame, payload_col: str = "html") -> DataFrame:
    """``pages`` with payload_bytes and payload_digest; a null payload is empty."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", base32_sha1(payload))


def repeated_payloads(headers: DataFrame, least_bytes: int = 0, id_col: str = "page_id") -> DataFrame:
    """(payload_digest, first): digests of two or more records, with the largest id; combined before the shuffle."""
    found = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(id_col).alias("first"), F.count("*").alias("members"))
    return found.where("members > 1 AND first IS NOT NULL").select("payload_digest", "first")


def resolve_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", repeated: DataFrame | None = None) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest, record_type and refers_to.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest id is a
    response and the others are revisits that refer to it; the rest are responses.  Repeated rows of
    one id: one id cannot refer to itself, so all are responses.  A null payload is empty; a row with
    a null id is a response unless its payload has an id, to which it then refers.

    ``repeated`` may be a written table of ``repeated_payloads``: while that is small enough to be
    broadcast, by the size of its files, payloads are not shuffled at all.
    """
    rows = with_headers(pages, payload_col)
    known = repeated_payloads(rows, least_bytes, id_col) if repeated is None else repeated
    joined = rows.join(known.withColumnRenamed("first", "_first"), "payload_digest", "left")
    refers = F.when((F.col("payload_bytes") >= least_bytes) & ~F.col(id_col).eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.withColumn("refers_to", refers.cast("long")).withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")).drop("_first")


def record_text(id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Column:
    """A whole WARC record without the two line ends after it, from the columns of ``resolve_revisits``."""
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col(payload_col), F.lit(""))))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name(F.col(id_col))),
        line("WARC-Date", F.lit(DATE)),
        F.when(url != "", line("WARC-Target-URI", url)).otherwise(F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write ``pages`` below ``path`` as gzip-compressed archives, with revisits resolved.

    An empty table gives a folder without records.  Other columns are ignored.  Record ids name pages, so
    repeated rows of one id have the same.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    repeated = Scratch(pages.sparkSession, "warc").write("repeated", repeated_payloads(with_headers(rows), least_bytes))
    text = resolve_revisits(rows, least_bytes, repeated=repeated).select(record_text().alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class _Stream:
    """Bytes that come in pieces, taken as they are asked for."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > 1 << 16:  # what was taken is dropped now and then
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with the mark; None if it does not come."""
        while (end := self.held.find(mark, self.at)) < 0:
            if not self.more():
                return None
        return self.take(end + len(mark) - self.at)

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self.more():
                raise ValueError("an archive is cut off")
        out = bytes(self.held[self.at : self.at + size])
        self.at += size
        return out

    def rest(self) -> bytes:
        while self.more():
            pass
        return bytes(self.held[self.at :])
def records_of(pieces: Iterator[bytes], padded: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record; ``padded`` allows line ends after the last one."""
    stream = _Stream(pieces)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if padded and not head.strip() and not stream.rest().strip():
            return
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        yield fields, block
    if stream.rest().strip():
        raise ValueError("an archive is cut off")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a gzip archive of one or more members."""
    return records_of(iter([gzip.decompress(data)]))


def _page(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", name)
    return int(m[1]) if m else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the records of files, from their pieces (path, value) in order."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    pieces = (piece for batch in batches for piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    rows: list[tuple] = []
    size = 0

    def taken() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for _, of_file in groupby(pieces, key=lambda piece: piece[0]):
        for fields, block in records_of((value + END.encode() for _, value in of_file), padded=True):
            body = block.split(b"\r\n\r\n", 1)[1]
            kind, wanted = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                if digest != wanted:
                    raise ValueError(f"a payload's digest is {digest} and not {wanted}")
            length = len(body) if kind == "response" else int(fields["x-payload-length"])
            rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to", "")), wanted, length, body if kind == "response" else None))
            size += len(body) + 256
            if size > 1 << 23:
                yield taken()
                rows, size = [], 0
    if rows:
        yield taken()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) of all records.

    Responses' digests are checked; a revisit has no payload.  A folder without records gives no rows.
    A record must fit into memory, its file need not.
    """
    files = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    pieces = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
