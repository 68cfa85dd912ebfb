"""Legacy ARC archives read by their header lines and converted to WARC.

An ARC file begins with a version block that says which fields its header
lines have (version 1: five, version 2: ten); every record is one such line
and as many bytes as the line declares. WARC records are synthesised from
that: the identifier from the archive's name and the record's offset (so a
second conversion gives the same one), the date from the 14-digit time stamp,
the type from the scheme and the body, the digests from the bytes.

Records with equal payloads become revisits of the one with the least page
number, if the payload has REVISIT_BYTES or more. Archives are written and
read by Spark: one file per task, read back whole, each file's records
streamed out of its compressed bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.bpe_codec import slices
from fleetlens.llm.scratch import fresh_path, stored

# The fields of a header line by version.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_BYTES = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"
#: Bytes of records that a task gathers before it hands them on.
FLUSH_BYTES = 4 << 20


# -- ARC ---------------------------------------------------------------------


def _arc_record(version: str, url: str, ip: str, date: str, mime: str, status: int, body: bytes, offset: int, name: str) -> bytes:
    """One record, without the line end after it."""
    if version == "1":
        line = f"{url} {ip} {date} {mime} {len(body)}"
    else:
        checksum = hashlib.md5(body).hexdigest()
        line = f"{url} {ip} {date} {mime} {status} {checksum} - {offset} {name} {len(body)}"
    return line.encode() + b"\n" + body


def _version_block(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 fleetlens\n{ARC_FIELDS[version]}\n".encode()
    return _arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", 200, body, 0, name)


def arc_url(url: str | None) -> str:
    """The URL as one field of a header line: white space and control characters percent-encoded."""
    escaped = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), escaped) or "unknown:"


def http_response(page_id, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"{PAGE_HEADER}: {page_id}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> None:
    """One ARC record per row, one archive per task; even tasks write version 1, odd ones version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, offset = str(1 + part % 2), f"part-{part:05d}.arc", 0
        for batch in slices(batches):
            records = [] if offset else [_version_block(version, name, date)]
            offset += sum(len(r) + 1 for r in records)
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                body = http_response(page_id, (html or "").encode())
                records.append(_arc_record(version, arc_url(url), "0.0.0.0", date, "text/html", 200, body, offset, name))
                offset += len(records[-1]) + 1
            yield pa.RecordBatch.from_pydict({"record": pa.array(records, pa.binary())})

    rows = pages.select(pages[id_col], pages[url_col].cast("string"), pages[html_col].cast("string"))
    _write_text(rows.mapInArrow(run, "record binary"), path)


def _write_text(records: DataFrame, path: str) -> None:
    """Records and a line end after each, byte for byte: Spark's text writer does not look into strings."""
    records.select(F.col("record").cast("string")).write.option("compression", "gzip").text(path, lineSep="\n")


#: What a header line's fields look like; only the URL, the first one, may hold blanks.
_HEADER_LINE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:.* [0-9A-Fa-f.:]+ \d{4,14} \S+( \S+ \S+ \S+ \S+ \S+)? \d+")


def _header_line(line: bytes, fields: list[str]) -> list[str] | None:
    """The fields of a header line taken from its end, so that a URL may hold blanks; None if it is none."""
    text = line.decode("utf-8", "replace").rstrip("\r\n")
    parts = text.rsplit(" ", len(fields) - 1)
    return parts if len(parts) == len(fields) and _HEADER_LINE.fullmatch(text) and re.fullmatch(r"\d{4,14}", parts[2]) else None


def arc_records(stream: BinaryIO, on_bad: Callable[[int, str], None] | None = None) -> Iterator[dict]:
    """Records of one archive: the header line's fields by name (lower case), `version`, `offset`, `body`.

    Without `on_bad` a malformed archive is refused with a ValueError. With it
    each fault is told as (offset, what) and reading goes on: after a line that
    is no header line at the next one that is; a URL with blanks is no fault. A
    record cut short, a damaged compression and a missing or unknown version
    block end the archive, whose earlier records stay.
    """
    fields, version, offset, lost = None, "", 0, False

    def bad(at: int, what: str) -> None:
        if on_bad is None:
            raise ValueError(what)
        on_bad(at, what)

    try:
        while line := stream.readline():
            start, offset = offset, offset + len(line)
            if not line.strip():
                continue  # the line end after a body
            parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
            if fields is None and not parts[0].startswith("filedesc://"):
                return bad(start, "the archive does not begin with a version block")
            if fields is not None and on_bad is not None:
                parts = _header_line(line, fields)
                if parts is None:
                    if not lost:  # one fault, however many lines are passed
                        bad(start, f"not a version {version} header line")
                    lost = True
                    continue
                lost = False
            if fields is not None and len(parts) != len(fields):
                bad(start, f"a version {version} header line has {len(fields)} fields, not {len(parts)}")
            if not re.fullmatch(r"\d+", parts[-1], re.ASCII):
                return bad(start, "the record declares no length")
            length = int(parts[-1])
            body = stream.read(length)
            offset += length
            if len(body) != length:
                return bad(start, "the archive ends within a record")
            if fields is None:
                head = body.decode("utf-8", "replace").split("\n")
                version = head[0].split(" ")[0]
                if version not in ARC_FIELDS:
                    return bad(start, f"unknown ARC version {version!r}")
                fields = ARC_FIELDS[version].lower().split(" ")
                parts += [""] * (len(fields) - len(parts))
            yield dict(zip(fields, parts)) | {"version": version, "offset": start, "body": body}
    except (EOFError, OSError, zlib.error) as fault:
        if on_bad is None:
            raise
        on_bad(offset, f"damaged compression: {fault}")


# -- Conversion --------------------------------------------------------------


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its closing empty line, and payload; no header if the block has none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def http_field(header: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name).encode() + rb":[ \t]*([^\r\n]*)", header)
    return found[1].decode("utf-8", "replace") if found else None


def _whole_number(text: str | None) -> int | None:
    """The number that a header field states; None where another writer put something else there."""
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text.strip(), re.ASCII) else None


def warc_date(stamp: str) -> str:
    """ISO time of a 14-digit (or, in old archives, shorter) time stamp."""
    digits = (stamp + "00000101000000"[len(stamp) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_type(url: str, header: bytes, first: bool) -> str:
    if first and url.startswith("filedesc://"):
        return "warcinfo"
    return "response" if header else "resource"


def synthesised(archive: str, record: dict) -> dict:
    """What WARC needs of one ARC record."""
    header, payload = split_http(record["body"])
    kind = warc_type(record["url"], header, first=record["offset"] == 0)
    page = http_field(header, PAGE_HEADER)
    return {
        "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{record['offset']}")),
        "warc_type": kind,
        "uri": record["url"],
        "ip": record["ip-address"],
        "date": warc_date(record["archive-date"]),
        "content_type": "application/http; msgtype=response" if kind == "response" else record["content-type"],
        "page_id": _whole_number(page),
        "payload_bytes": len(payload),
        "payload_digest": hashlib.sha256(payload).hexdigest(),
    }


_META = "record_id string, warc_type string, uri string, ip string, date string, content_type string, page_id long, payload_bytes long, payload_digest string"


def _batches(rows: Iterable[dict], names: list[str], kinds: pa.Schema, weight: str | None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about FLUSH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append({n: row[n] for n in names})
        size += 500 + (len(row[weight]) if weight else 0)
        if size > FLUSH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=kinds)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in schema.split(", "))])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _parsed(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    """Rows that `parse(archive name, stream)` finds in each file."""
    kinds = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py().rpartition("/")[2]
                stream = io.BytesIO(batch.column(1)[k].as_buffer())
                opened = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if name.endswith(".gz") else stream
                yield from _batches(parse(name, opened), kinds.names, kinds, "body" if "body" in kinds.names else None)

    return _files(spark, path).mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str, *, bodies: bool = True, strict: bool = False) -> DataFrame:
    """Every record of the archives under `path` with what WARC needs of it, and its `body`.

    Faulty records are left out (``arc_faults`` tells them); with `strict` they
    end the job.
    """

    def parse(name: str, stream: BinaryIO) -> Iterator[dict]:
        for record in arc_records(stream, None if strict else lambda at, what: None):
            yield synthesised(name, record) | {"body": record["body"]}

    return _parsed(spark, path, _META + ", body binary" * bodies, parse)


def arc_faults(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, fault) of all that ``read_arc`` leaves out; no rows if all archives are sound."""

    def parse(name: str, stream: BinaryIO) -> Iterator[dict]:
        told: list[dict] = []
        for _ in arc_records(stream, lambda at, what: told.append({"archive": name, "offset": at, "fault": what})):
            yield from told
            told.clear()
        yield from told

    return _parsed(spark, path, "archive string, offset long, fault string", parse)


def warc_record(row: dict) -> bytes:
    """One record without its last line end. `first_*` name the response that a revisit refers to."""
    kind, block = row["warc_type"], row["body"]
    revisit = row["first_id"] is not None and row["first_id"] != row["record_id"]
    if revisit:
        kind, block = "revisit", split_http(block)[0]
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{row['record_id']}>"),
        ("WARC-Date", row["date"]),
        ("WARC-Filename" if kind == "warcinfo" else "WARC-Target-URI", row["uri"]),
        ("WARC-IP-Address", row["ip"]),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("Content-Type", row["content_type"]),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[4:4] = [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<urn:uuid:{row['first_id']}>"),
            ("WARC-Refers-To-Target-URI", row["first_uri"]),
            ("WARC-Refers-To-Date", row["first_date"]),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode() + b"\r\n" + block + b"\r\n\r"


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, strict: bool = False) -> None:
    """Convert all archives under `arc_path`; WARC files go to `warc_path`.

    Faulty records are left out and told by ``arc_faults``; with `strict` they
    end the job.
    """
    met = read_arc(spark, arc_path, bodies=False, strict=strict).where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= REVISIT_BYTES))
    one = F.struct(F.col("page_id").isNull(), "page_id", "record_id", "uri", "date")
    groups = met.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("first")).where("n > 1")
    # Only payloads that occur again. Stored, so that the join may split the bodies of a hot one.
    firsts = groups.select(
        F.col("payload_digest").alias("_digest"), F.col("first.record_id").alias("first_id"), F.col("first.uri").alias("first_uri"), F.col("first.date").alias("first_date")
    )
    firsts = stored(firsts, "repeats")
    rows = read_arc(spark, arc_path, strict=strict)
    again = (F.col("payload_digest") == F.col("_digest")) & (F.col("warc_type") == "response")
    joined = rows.join(firsts, again, "left").drop("_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"record": pa.array([warc_record(r) for r in batch.to_pylist()], pa.binary())})

    _write_text(joined.mapInArrow(run, "record binary"), warc_path)


# -- WARC --------------------------------------------------------------------


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of every record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the archive ends within a record")
        yield fields, block


def _bare(value: str | None) -> str | None:
    return value and re.sub(r"^<urn:uuid:|>$|^sha256:", "", value)


def read_warc(spark: SparkSession, path: str, *, bodies: bool = False) -> DataFrame:
    """Every record under `path`: identifier, type, URI, date, the record referred to, page number, payload bytes and digest.

    Of a response, bytes and digest are measured on the payload read back; a
    revisit has no payload and states those of the full one.
    """
    schema = "record_id string, record_type string, uri string, date string, refers_to string, page_id long, payload_bytes long, payload_digest string"

    def parse(_: str, stream: BinaryIO) -> Iterator[dict]:
        for fields, block in warc_records(stream):
            header, payload = split_http(block)
            page, kind = http_field(header, PAGE_HEADER), fields["warc-type"]
            revisit = kind == "revisit"
            digest = hashlib.sha256(payload).hexdigest()
            if not revisit and digest != _bare(fields["warc-payload-digest"]):
                raise ValueError("the payload does not match its digest")
            yield {
                "record_id": _bare(fields["warc-record-id"]),
                "record_type": kind,
                "uri": fields.get("warc-target-uri"),
                "date": fields["warc-date"],
                "refers_to": _bare(fields.get("warc-refers-to")),
                "page_id": _whole_number(page),
                "payload_bytes": _whole_number(http_field(header, "Content-Length")) if revisit else len(payload),
                "payload_digest": _bare(fields["warc-payload-digest"]) if revisit else digest,
                "body": block,
            }

    return _parsed(spark, path, schema + ", body binary" * bodies, parse)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every row as ARC, convert to WARC and read that back.

    Returns one row per row of `pages`: page_id (long), payload_bytes,
    payload_digest (bare SHA-256), record_type and refers_to (the page_id of
    the response that a revisit refers to).

    Null html is an empty payload; null URLs are archived as ``unknown:``.
    Of equal payloads the least page_id is the response (null ids come last);
    where repeated rows share it, one of them is. Payloads of any length are
    written whole. Other columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, id_col=id_col, url_col=url_col, html_col=html_col)
    convert(spark, arc, warc, strict=True)  # every page must come back
    back = read_warc(spark, warc).where(F.col("record_type").isin("response", "revisit")).drop("uri", "date")
    back = stored(back, "warc")
    first = back.where(F.col("record_type") == "response").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"))
    joined = back.join(first, F.col("refers_to") == F.col("_id"), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("_page").alias("refers_to"))
