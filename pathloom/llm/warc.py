"""Legacy archive converter: ARC records to WARC files and back (operator 8).

An ARC 1 record starts with ``URL IP date type length``, an ARC 2 record with ``URL IP
date type status checksum location offset name length``; both dates have 14 digits, and
the declared length says how many bytes of content follow.  The converter parses the
header line of the version at hand, takes the content by its declared length, and
synthesises the WARC record: its identifier (a UUID from the source record), timestamp,
type, content type and payload digest.

Pages become small ARC files first, each with its version block, of versions 1 and 2 by
turns; these are parsed as a whole, by their version and declared lengths.  WARC files are
written by Spark's text writer, a record a row and uncompressed, the two line ends after a
record being the writer's separator.  ``RECORDS`` records make a file if none is over
``LARGE`` bytes, larger ones are files of their own, so that a file is bounded in bytes; they
are read back by their declared lengths.

Defined results: a null html is an empty payload, a null url becomes ``about:blank``;
payloads below ``least`` bytes are always responses; a row with a null page_id is a record
without a page header and gives a null page_id back, it neither refers nor is referred
to; rows that repeat a page_id with an equal payload are responses together if it is the
smallest one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, slices, small_or_shuffled

LEAST = 100
#: Records in a file at most, and bytes from which a payload is a file of its own.
RECORDS = 256
LARGE = 256 << 10
_EPOCH = "20000101000000"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pathloom:arc")
_LINE = {
    1: re.compile(rb"(\S+) (\S+) (\d{14}) (\S+) (\d+)$"),
    2: re.compile(rb"(\S+) (\S+) (\d{14}) (\S+) (\d{3}) (\S+) (\S+) (\d+) (\S+) (\d+)$"),
}


class ArchiveError(ValueError):
    """The bytes are not an archive of the declared form."""


# --- ARC -------------------------------------------------------------------------


def arc_record(url: str, payload: bytes, version: int, ip: str = "0.0.0.0", date: str = _EPOCH, kind: str = "text/html") -> bytes:
    """A record of an ARC file of the given version, with the line end that follows it."""
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "about:blank"
    if version == 1:
        line = f"{url} {ip} {date} {kind} {len(payload)}"
    else:
        line = f"{url} {ip} {date} {kind} 200 {hashlib.md5(payload).hexdigest()} - 0 legacy.arc {len(payload)}"
    return line.encode() + b"\n" + payload + b"\n"


def arc_header(version: int, name: str = "legacy.arc") -> bytes:
    """The version block that opens an ARC file."""
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 pathloom\n{fields}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {_EPOCH} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ") + str(len(body))
    return line.encode() + b"\n" + body + b"\n"


def parse_arc_record(data: bytes, at: int, version: int) -> tuple[dict, int]:
    """The record at ``at`` by its declared length, and where the next one starts."""
    end = data.find(b"\n", at)
    m = _LINE[version].match(data[at:end].rstrip(b"\r")) if end >= 0 else None
    if not m:
        raise ArchiveError(f"no ARC {version} header line at {at}")
    g = m.groups()
    length = int(g[-1])
    payload = data[end + 1 : end + 1 + length]
    if len(payload) != length:
        raise ArchiveError(f"the record at {at} is shorter than it declares")
    at = end + 1 + length
    return {"url": g[0].decode(), "ip": g[1].decode(), "date": g[2].decode(), "type": g[3].decode(), "payload": payload}, at + (data[at : at + 1] == b"\n")


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of a whole ARC file; its version block says how to read the lines."""
    m = re.match(rb"filedesc://[^\n]*\n(\d)", data)
    if not m or int(m[1]) not in _LINE:
        raise ArchiveError("no ARC version block")
    version = int(m[1])
    _, at = parse_arc_record(data, 0, version)
    while at < len(data):
        record, at = parse_arc_record(data, at, version)
        yield record


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """url, ip, date, type, payload of the records of the ARC files at ``path``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = list(parse_arc(data))
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("type", pa.string()), ("payload", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "url string, ip string, date string, type string, payload binary")


# --- WARC ------------------------------------------------------------------------


def warc_record(page_id: int | None, refers_to: int | None, arc: dict) -> str:
    """The WARC record of an ARC record, without the line ends that close it."""
    payload = arc["payload"]
    digest = hashlib.sha256(payload).hexdigest()
    d = arc["date"]
    mark = lambda page: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}')}>"
    content = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {mark(page_id)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z",
        f"WARC-Target-URI: {arc['url']}",
        f"WARC-IP-Address: {arc['ip']}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Type: {arc['type']}",
        f"Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {mark(refers_to)}", f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(content)}")
    return "\r\n".join(lines) + "\r\n\r\n" + content.decode()


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and content of the records, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.0\r\n", at):
            raise ArchiveError(f"no WARC record at {at}")
        head = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.lower()] = value.strip()
        at = end + 4 + int(head["content-length"])
        content = data[end + 4 : at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ArchiveError("a record of another length than it declares")
        at += 4
        yield head, content


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Convert ``pages``, as ARC files of versions 1 and 2, to WARC files."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", F.sha2("html", 256).alias("digest"))
    keyed = materialise(keyed, "warc-digests")
    # only payloads that repeat matter; the counts are partial sums before they are shuffled
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = keyed.join(small_or_shuffled(materialise(first, "warc-first")), "digest").where(F.col("page_id") > F.col("refers_to"))
    # a page_id that repeats with different payloads refers by its digest too
    again = materialise(again.distinct(), "warc-again")
    listed = rows.withColumn("digest", F.sha2("html", 256)).join(small_or_shuffled(again), ["page_id", "digest"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in enumerate(slices(batches, "html")):
            version = 1 + number % 2
            pages, urls, html, refers = (b.column(i).to_pylist() for i in range(4))
            archive = arc_header(version) + b"".join([arc_record(u, h.encode(), version) for u, h in zip(urls, html, strict=True)])
            out = [warc_record(page, to, arc) for page, to, arc in zip(pages, refers, parse_arc(archive), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    large = F.octet_length("html") > LARGE
    for kind, rows, most in (("small", listed.where(~large), RECORDS), ("large", listed.where(large), 1)):
        records = rows.select("page_id", "url", "html", "refers_to").mapInArrow(work, "value string")
        records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(f"{path}/{kind}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records
    of the WARC files at ``path``, checked against their contents."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for head, content in parse_warc(data):
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] == "response" and (hashlib.sha256(content).hexdigest() != digest or len(content) != int(head["payload-length"])):
                        raise ArchiveError(f"{head['warc-record-id']} has another payload than it declares")
                    rows.append((number(head.get("page-id")), int(head["payload-length"]), digest, head["warc-type"], number(head.get("refers-to-page-id"))))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def convert(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` as WARC files in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, least)
    return read_warc(spark, path)
