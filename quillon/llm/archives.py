"""Legacy ARC archives and their conversion to WARC.

ARC versions 1 and 2 differ in the fields of a record's header line; the version block at the head of a file
says which holds. The converter cuts records by their declared lengths and synthesises what ARC lacks:
record identifiers, ISO timestamps, record types and SHA-1 digests. Among records of equal payload the
first in order stays a response, the others become revisits that refer to it.

Archives are written by Spark's text writer, whose line separator is the record separator of the format,
so they land wherever Spark can write; they are read as whole files of a bounded number of records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.llm.common import needs, texts_of

# The header fields of the two ARC versions and the names that WARC prescribes.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: HTTP header that carries a record's order; ARC has no identifiers of its own.
ORDER = "X-Archive-Order"
#: Header of a revisit that keeps the size of the payload left out.
LENGTH = "X-Payload-Length"
NO_URL = "about:blank"
RECORDS_PER_FILE = 20_000
#: Gzip level by Hadoop's name: most of the time of a write goes into it, and higher ones save little.
LEVEL = "FOUR"

ARC_SCHEMA = (
    "kind string, url string, ip string, date string, mime string, record_order long, head binary, payload binary, payload_bytes long, payload_digest string"
)
WARC_SCHEMA = (
    "record_id string, record_type string, date string, target_uri string, record_order long, payload binary, "
    "payload_bytes long, payload_digest string, refers_to_id string"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: int, url: str, ip: str, date: str, mime: str, length: int, status: str = "200", offset: int = 0, name: str = "-") -> bytes:
    if version == 1:
        return f"{url} {ip} {date} {mime} {length}\n".encode()
    return f"{url} {ip} {date} {mime} {status} - - {offset} {name} {length}\n".encode()


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 converter\n{' '.join(FIELDS[version])}".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name=name) + body


def safe_url(url: str) -> str:
    """A URL without blanks or other characters that an ARC header line cannot hold."""
    return re.sub(r"[^\x21-\x7e]+", lambda found: quote(found[0]), url) or NO_URL


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000", per_file: int = RECORDS_PER_FILE, key: str = "page_id") -> None:
    """ARC files (gzip) with one record per page: HTTP head and the html in UTF-8.

    Partitions take turns between the two versions. Null html is the empty text, a null or empty url becomes about:blank.
    """
    needs(pages, key, "url", "html")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, n = 1 + part % 2, 0
        for batch in batches:
            keys, urls, htmls = batch.column(0).to_pylist(), texts_of(batch.column(1)), texts_of(batch.column(2))
            out, held = [], 0
            for own, url, html in zip(keys, urls, htmls):
                if n % per_file == 0:  # the writer begins a file here
                    out.append(version_block(version, f"part-{part}-{n}.arc", date))
                    n += 1
                payload = html.encode()
                order = "" if own is None else f"{ORDER}: {own}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{order}\r\n".encode()
                out.append(arc_header(version, safe_url(url), "0.0.0.0", date, "text/html", len(head) + len(payload), offset=n) + head + payload)
                n += 1
                held += len(payload)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = pages.select(key, "url", "html").mapInArrow(records, "value binary")
    write_records(rows.select(F.col("value").cast("string")), folder, "\n", per_file)


def write_records(rows: DataFrame, folder: str, separator: str, per_file: int) -> None:
    written = rows.write.option("lineSep", separator).option("maxRecordsPerFile", per_file)
    written.option("compression", "gzip").option("zlib.compress.level", LEVEL).text(folder)


def whole_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")


def header_fields(line: bytes, version: int | None) -> dict[str, str] | None:
    """The named fields of a record's header line, or None if it is none.

    The fields after the URL hold no blanks and are counted from the right, so all that is left is the URL, blanks
    included. Without a version block the number of fields that fit tells the version.
    """
    parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
    for kind in (version,) if version else (2, 1):
        names = FIELDS[kind]
        if len(parts) < len(names):
            continue
        named = dict(zip(names[1:], parts[1 - len(names) :]))
        url = " ".join(parts[: 1 - len(names)])
        if url and named["Archive-length"].isascii() and named["Archive-length"].isdigit() and re.fullmatch(r"\d{4,14}", named["Archive-date"]):
            return {"URL": url.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), **named}
    return None


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file, gzipped or not, cut by their declared lengths.

    What is no header line where one is due, up to the next one, and a record cut off by the end of the file come as one
    row of kind `damaged` with those bytes; the records around them are read as ever.
    """
    file = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    version, lost = None, []

    def damaged() -> dict:
        body = b"".join(lost)
        lost.clear()
        return {"kind": "damaged", "url": None, "ip": None, "date": None, "mime": None, "body": body}

    while True:
        try:
            line = file.readline()
            if not line:
                break
            if not line.strip():
                if lost:
                    lost.append(line)
                continue
            named = header_fields(line, None if line.startswith(b"filedesc:") else version)
            if not named:
                lost.append(line)
                continue
            if lost:
                yield damaged()
            body = file.read(length := int(named["Archive-length"]))
        except (EOFError, OSError, zlib.error) as error:  # the rest of the compressed file cannot be read
            lost.append(str(error).encode())
            break
        if len(body) != length:
            lost += [line, body]
            break
        if line.startswith(b"filedesc:"):
            declared = body.split(b" ", 1)[0]
            version = int(declared) if declared.isdigit() and int(declared) in FIELDS else None
            if version is None:  # an unknown version: its records are told by their fields, if by anything
                lost += [line, body]
                yield damaged()
                continue
        yield {
            "kind": "filedesc" if line.startswith(b"filedesc:") else "record",
            "url": named["URL"], "ip": named["IP-address"], "date": named["Archive-date"], "mime": named["Content-type"], "body": body,
        }
    if lost:
        yield damaged()


def http_parts(body: bytes) -> tuple[bytes | None, bytes]:
    """HTTP head with its blank line, and payload; no head if the body is not an HTTP response."""
    if not body.startswith(b"HTTP/"):
        return None, body
    cut = body.find(b"\r\n\r\n")
    return (body, b"") if cut < 0 else (body[: cut + 4], body[cut + 4 :])


def http_header(head: bytes | None, name: str) -> str | None:
    found = re.search(rb"(?im)^%s:[ \t]*([^\r\n]*)" % name.encode(), head or b"")
    return found[1].decode("utf-8", "replace").strip() if found else None


def batches_of(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row.get("payload") or b"")
        if size > 1 << 23:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def read_arc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Rows of ARC_SCHEMA for all records and version blocks of the ARC files, and for damaged parts; without payloads it is an index."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for content in batch.column(0):
                for found in parse_arc(content.as_py()):
                    head, payload = http_parts(found.pop("body"))
                    order = http_header(head, ORDER)
                    yield found | {
                        "record_order": int(order) if order and re.fullmatch(r"-?\d{1,18}", order) else None,
                        "head": head,
                        "payload": payload if payloads else None,
                        "payload_bytes": len(payload),
                        "payload_digest": sha1_base32(payload),
                    }

    schema = arrow_schema(ARC_SCHEMA)
    return whole_files(spark, folder).mapInArrow(lambda batches: batches_of(rows(batches), schema), ARC_SCHEMA)


def rejects(spark: SparkSession, folder: str) -> DataFrame:
    """(payload, payload_bytes): the bytes of ARC files that belong to no whole record."""
    return read_arc(spark, folder).where("kind = 'damaged'").select(F.concat(F.coalesce("head", F.lit(b"")), "payload").alias("payload"), "payload_bytes")


def iso_date(date: Column) -> Column:
    """ARC's digits as an ISO timestamp; missing digits are those of the period's start."""
    full = F.concat(date, F.substring(F.lit("00000101000000"), F.length(date) + 1, F.lit(14)))
    return F.regexp_replace(full, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*$", "$1-$2-$3T$4:$5:$6Z")


def record_id(*parts: Column) -> Column:
    """A name-based URN: equal parts give equal identifiers, so reruns do."""
    digest = F.sha1(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    pieces = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), pieces[0], F.lit("-"), pieces[1], F.lit("-5"), pieces[2], F.lit("-a"), pieces[3], F.lit("-"), pieces[4])


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = 0, per_file: int = RECORDS_PER_FILE) -> None:
    """WARC files (gzip) equivalent to the ARC files.

    Version blocks become warcinfo, HTTP bodies response or revisit, other bodies resource. Damaged parts are left out:
    `rejects` returns them. HTTP heads are bytes of any encoding and stay as they are. Payloads under
    `least_bytes` are always responses. Records without an order come after all others; equal orders are alike.
    """
    order = F.coalesce("record_order", F.lit((1 << 63) - 1))
    records = read_arc(spark, arc_folder).where("kind <> 'damaged'")
    index = read_arc(spark, arc_folder, payloads=False).where("kind = 'record' and head is not null")
    firsts = index.groupBy("payload_digest").agg(F.min(F.struct(order.alias("o"), F.col("url").alias("u"), F.col("date").alias("d"))).alias("first"))
    joined = records.join(firsts, "payload_digest", "left")
    http = (F.col("kind") == "record") & F.col("head").isNotNull()
    revisit = http & (F.col("payload_bytes") >= least_bytes) & (F.col("first.o") < order)
    kind = F.when(F.col("kind") == "filedesc", "warcinfo").when(revisit, "revisit").when(http, "response").otherwise("resource")
    head = F.coalesce(F.col("head"), F.lit(b""))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    first_id = record_id(F.col("first.u"), F.col("first.d"), F.col("first.o"), F.col("payload_digest"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("url"), F.col("date"), order, F.col("payload_digest")), F.lit(">"))),
        line("WARC-Date", iso_date(F.col("date"))),
        F.when(kind != "warcinfo", line("WARC-Target-URI", F.col("url"))).otherwise(""),
        F.when(kind != "warcinfo", line("WARC-IP-Address", F.col("ip"))).otherwise(""),
        F.when(kind != "warcinfo", line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))).otherwise(""),
        F.when(
            revisit,
            F.concat(
                F.lit(f"WARC-Profile: {REVISIT}\r\n"),
                line("WARC-Refers-To", F.concat(F.lit("<"), first_id, F.lit(">"))),
                line("WARC-Refers-To-Target-URI", F.col("first.u")),
                line("WARC-Refers-To-Date", iso_date(F.col("first.d"))),
                line(LENGTH, F.col("payload_bytes").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.when(http, "application/http; msgtype=response").when(kind == "warcinfo", "application/warc-fields").otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    text = joined.withColumn("block", block).select(F.concat(header.cast("binary"), F.col("block")).cast("string").alias("value"))
    write_records(text, warc_folder, "\r\n\r\n", per_file)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of the records of one WARC file, gzipped or not."""
    file = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record has to begin with its version")
        fields = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = file.read(length := int(fields["content-length"]))
        if len(block) != length:
            raise ValueError("a WARC record ends before its declared length")
        yield fields, block


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of WARC_SCHEMA for all response, revisit and resource records.

    A response's payload is measured and digested anew and has to agree with its header; a revisit's size and digest
    are those its headers declare.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for content in batch.column(0):
                for fields, block in parse_warc(content.as_py()):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = http_parts(block)
                    declared = fields["warc-payload-digest"].removeprefix("sha1:")
                    order = http_header(head, ORDER)
                    order = order if order and re.fullmatch(r"-?\d{1,18}", order) else None
                    if kind == "revisit":
                        size, payload = int(fields[LENGTH.lower()]), None  # heads of old archives may declare none, or a wrong one
                    else:
                        size = len(payload)
                        if sha1_base32(payload) != declared:
                            raise ValueError(f"payload digest of {fields['warc-record-id']} does not agree")
                    yield {
                        "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "date": fields["warc-date"],
                        "target_uri": fields["warc-target-uri"], "record_order": int(order) if order else None, "payload": payload,
                        "payload_bytes": size, "payload_digest": declared, "refers_to_id": fields.get("warc-refers-to", "").strip("<>") or None,
                    }

    schema = arrow_schema(WARC_SCHEMA)
    return whole_files(spark, folder).mapInArrow(lambda batches: batches_of(rows(batches), schema), WARC_SCHEMA)


def page_records(records: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) with the order of the record a revisit refers to."""
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("record_order").alias("refers_to"))
    named = records.drop("payload").join(responses.distinct(), "refers_to_id", "left")
    return named.select(F.col("record_order").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
