"""Legacy archives to WARC: parse ARC header lines and declared lengths, and write and read equivalent WARC records."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, slim
from sitelake.session import checkpoint_folder

# Fixed values of the formats: the field lines of both ARC versions, the WARC line ends.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = "\r\n"
#: Records in an archive file; with the longest text it bounds what a reader holds at once.
RECORDS_PER_FILE = 2_000
#: Archives are packed fast; both forms are read once and thrown away or kept cold.
PACKING = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
CAPTURED = "20250101000000"
ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place_in_file() -> F.Column:
    """0 for the first record of each file: the writer starts a new file after so many records of a task."""
    return F.monotonically_increasing_id() % (1 << 33) % RECORDS_PER_FILE


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> str:
    """Write pages as ARC files, a file head and then a record per row, with Spark's text writer alone.

    A record is its header line, the HTTP response and a line end, which is also what the writer puts after each row. Null html is an
    empty payload, a null url `-`; blanks in a url are percent-encoded, as the header line is split at blanks. A null id stays empty.
    """
    url = F.coalesce(F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20"), F.lit("-"))
    body = F.coalesce("html", F.lit(""))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body,
    )
    length = F.octet_length("http").cast("string")
    middle = {1: [F.lit("0.0.0.0"), F.lit(CAPTURED), F.lit("text/html")], 2: [*map(F.lit, ("0.0.0.0", CAPTURED, "text/html", "200", "-", "-", "0", "pages.arc"))]}
    line = F.concat_ws(" ", "link", *middle[version], length)
    about = f"{version} 0 sitelake\n{ARC_FIELDS[version]}\n"
    head_fields = {1: "text/plain", 2: "text/plain 200 - - 0 pages.arc"}[version]
    head = f"filedesc://pages.arc 0.0.0.0 {CAPTURED} {head_fields} {len(about)}\n{about}\n"
    records = slim(pages, page_id=id_col, url=url_col, html=html_col).select(url.alias("link"), http.alias("http"))
    text = F.concat(F.when(_place_in_file() == 0, F.lit(head)).otherwise(F.lit("")), line, F.lit("\n"), F.col("http"))
    records.select(text.alias("value")).write.options(**PACKING, maxRecordsPerFile=RECORDS_PER_FILE, lineSep="\n").text(path)
    return path


def unpack(content: bytes) -> bytes:
    """The bytes of a plain file or of one or many gzip members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = io.BytesIO()
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.write(member.decompress(content))
        content = member.unused_data
    return out.getvalue()


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """Header fields, offset, content and whether the content is cut short, for each record of an ARC file.

    The file head declares the version and, in its third line, the names of the fields of every header line. Only the declared length
    says where a record ends. The url may hold blanks in files of careless writers: fields are taken from the right.
    """
    at, names = 0, ARC_FIELDS[1].split()
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if parts[0].startswith("filedesc://"):
            version = data[end + 1 : end + 3].decode("ascii", "replace").strip()
            names = ARC_FIELDS[2 if version == "2" else 1].split()
        if len(parts) < len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        cut = len(parts) - len(names) + 1
        fields = dict(zip(names, [" ".join(parts[:cut]), *parts[cut:]]))
        length = int(fields["Archive-length"])
        content = data[end + 1 : end + 1 + length]
        if parts[0].startswith("filedesc://"):
            lines = content.decode("utf-8", "replace").split("\n")
            names = lines[1].split() if len(lines) > 1 and lines[1].strip() else names
        yield fields, at, content, len(content) < length
        at = end + 1 + length


def split_http(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case and body of an HTTP message; a content that is none is all body."""
    if not content.startswith(b"HTTP/"):
        return {}, content
    found = re.search(rb"\r?\n\r?\n", content)
    head, body = (content[: found.start()], content[found.end() :]) if found else (content, b"")
    fields = (line.split(":", 1) for line in head.decode("utf-8", "replace").splitlines()[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in fields}, body


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(stamp: str) -> str:
    """`YYYYMMDDhhmmss`, or as many of its digits as are given, as a WARC date."""
    s = (re.sub(r"\D", "", stamp) + "00010101000000"[min(len(re.sub(r"\D", "", stamp)), 14) :])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


CONVERTED = (
    "record_id string, warc_type string, target string, date string, ip string, http string, page_id bigint, payload binary, "
    "payload_bytes bigint, payload_digest string, truncated boolean"
)


def convert_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the ARC files under `path` with the WARC fields they lack: identifier, date, type and digests.

    Identifiers are name-based UUIDs of archive and offset, so a rerun gives the same ones. File heads become `warcinfo`, HTTP content
    `response`, other content `resource`. `truncated` marks a record whose file ends before its declared length.
    """
    out = arrow_schema(CONVERTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for fields, at, body, cut in arc_records(unpack(content.as_py())):
                    http, data = split_http(body)
                    kind = "warcinfo" if fields["URL"].startswith("filedesc://") else "response" if body.startswith(b"HTTP/") else "resource"
                    page = http.get("x-page-id", "")
                    rows.append((
                        uuid.uuid5(ID_SPACE, f"{name.rsplit('/', 1)[-1]}#{at}").urn, kind, fields["URL"], warc_date(fields["Archive-date"]), fields["IP-address"],
                        body[: len(body) - len(data)].decode("utf-8", "replace"), int(page) if re.fullmatch(r"-?\d+", page) else None,
                        data if payload else None, len(data), sha1_base32(data), cut,
                    ))
                    held += len(data)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CONVERTED)


def with_revisits(records: DataFrame) -> DataFrame:
    """record_id, refers_to and refers_page for every record whose payload an earlier one has.

    Of records with equal payloads (by length and digest) the one with the smallest page id, null last, then the smallest identifier,
    is the response. Only the identifiers and digests travel; the first of a digest is an aggregate combined before the shuffle.
    """
    slim_rows = records.where("warc_type != 'warcinfo'").select("record_id", "page_id", "payload_digest", "payload_bytes")
    key = F.struct(F.col("page_id").isNull(), "page_id", "record_id")
    firsts = slim_rows.groupBy("payload_digest", "payload_bytes").agg(
        F.min_by(F.struct("record_id", "page_id"), key).alias("first"), F.count("*").alias("n")
    ).where("n > 1")
    return slim_rows.join(firsts, ["payload_digest", "payload_bytes"]).where("record_id != first.record_id").select(
        "record_id", F.col("first.record_id").alias("refers_to"), F.col("first.page_id").alias("refers_page")
    )


def write_warc(records: DataFrame, path: str) -> str:
    """Write converted records as WARC files with Spark's text writer, whose separator is the end of a WARC record.

    A repeated payload becomes a `revisit` without its body, which keeps the HTTP header, the digest and the record it refers to.
    """
    marks = with_revisits(records)
    rows = records.where("warc_type != 'warcinfo'").join(marks, "record_id", "left")
    again = F.col("refers_to").isNotNull()
    http = F.col("http")
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    rows = rows.select(
        F.when(again, "revisit").otherwise(F.col("warc_type")).alias("kind"), "record_id", "target", "date", "ip", "payload_digest", "payload_bytes", "page_id",
        "refers_to", "refers_page", block.alias("block"),
    )

    def field(name: str, value: F.Column) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))

    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}"), field("WARC-Type", F.col("kind")), field("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        field("WARC-Date", F.col("date")), field("WARC-Target-URI", F.col("target")), field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), field("X-Payload-Length", F.col("payload_bytes")), field("X-Page-Id", F.col("page_id")),
        field("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))), field("X-Refers-To-Page-Id", F.col("refers_page")),
        field("WARC-Profile", F.when(F.col("kind") == "revisit", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        field("Content-Type", F.when(F.col("kind") == "resource", "application/octet-stream").otherwise("application/http; msgtype=response")),
        field("Content-Length", F.octet_length("block")), F.lit(CRLF),
    )
    about = f"software: sitelake{CRLF}format: WARC File Format 1.0{CRLF}"
    info = (
        f"WARC/1.0{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <{uuid.uuid5(ID_SPACE, about).urn}>{CRLF}WARC-Date: {warc_date(CAPTURED)}{CRLF}"
        f"Content-Type: application/warc-fields{CRLF}Content-Length: {len(about)}{CRLF}{CRLF}{about}{CRLF}{CRLF}"
    )
    text = F.concat(F.when(_place_in_file() == 0, F.lit(info)).otherwise(F.lit("")), head, F.col("block"))
    rows.select(text.alias("value")).write.options(**PACKING, maxRecordsPerFile=RECORDS_PER_FILE, lineSep=CRLF * 2).text(path)
    return path


READ = (
    "record_id string, record_type string, target string, date string, page_id bigint, refers_to string, refers_page bigint, payload binary, "
    "payload_bytes bigint, payload_digest string, valid boolean"
)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields in lower case and block of each record; only the declared length says where a record ends."""
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:] if ":" in line)}
        length = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of WARC files but the file heads. The digest of a record that carries its payload is computed anew and compared."""
    out = arrow_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda text: int(text) if text else None
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for fields, block in warc_records(unpack(content.as_py())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    data = split_http(block)[1]
                    whole = kind != "revisit"
                    n, digest = (len(data), sha1_base32(data)) if whole else (int(fields["x-payload-length"]), declared)
                    rows.append((
                        fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), number(fields.get("x-page-id")),
                        fields.get("warc-refers-to", "").strip("<>") or None, number(fields.get("x-refers-to-page-id")), data if payload and whole else None,
                        n, digest, digest == declared,
                    ))
                    held += len(data)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> DataFrame:
    """Pages written as legacy archives, converted to WARC files in the shared folder, and those read back; payloads are left out.

    A row for each input row: page_id, payload_bytes, payload_digest, record_type, refers_to (page of the response, for revisits),
    record_id, date, valid. Null html is an empty payload, equal to other empty ones; a null id stays null and comes after all others;
    repeated rows revisit the first; an empty table gives an empty result. Other columns are left out.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "archives")
    arc = write_arc(pages, f"{folder}/arc", id_col, url_col, html_col, version)
    read = read_warc(spark, write_warc(convert_arc(spark, arc), f"{folder}/warc"), payload=False)
    return read.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"), "record_id", "date", "valid"
    )
