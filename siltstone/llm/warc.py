"""Legacy archive converter: ARC files to WARC files, and readers and writers of both.

An ARC file opens with a version block (``filedesc:``) that names the fields of its
header lines: five in version 1, ten in version 2. Records are found by their declared
lengths alone, so a payload may hold anything. The converter synthesises what ARC
lacks: record identifiers, ISO timestamps, record types and digests; repeated payloads
become revisits of one response. Files are written by Spark's committed text writer
(the record separator is its line separator) and read by its binary reader.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.skew import lookup
from siltstone.session import cut, scratch

# Fields of the two versions of ARC header lines.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive file, about.
FILE_BYTES = 32 << 20
_SPACE = re.compile(r"[\x00-\x20\x7f]")
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:siltstone:arc-record")


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_url(url: str | None) -> str:
    """A URL as one field of a header line: spaces and controls escaped, null a dash."""
    return _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-" if url is not None else "-"


def http_response(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and body."""
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def arc_version_block(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 siltstone\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(version: str, url: str, date: str, block: bytes, offset: int, name: str) -> bytes:
    fields = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": digest(block), "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + block


def arc_records(content: memoryview) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(version, header fields, block) of each record after the version block."""
    data, at, version, names = bytes(content), 0, None, None
    size = len(data)
    while at < size:
        if data[at] == 0x0A:  # separators
            at += 1
            continue
        stop = data.find(b"\n", at)
        stop = size if stop < 0 else stop
        line = data[at:stop].decode("utf-8").split(" ")
        if version is None:
            if not line[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with its version block")
            body = data[stop + 1 : stop + 1 + int(line[-1])]
            version = body.split(b" ", 1)[0].decode()
            names = body.split(b"\n")[1].decode().split(" ")
            if names != ARC_FIELDS.get(version):
                raise ValueError(f"unknown ARC version {version}")
        else:
            if len(line) != len(names):
                raise ValueError(f"{len(line)} fields where version {version} has {len(names)}")
            fields = dict(zip(names, line, strict=True))
            yield version, fields, data[stop + 1 : stop + 1 + int(fields["Archive-length"])]
        at = stop + 1 + int(line[-1])


def warc_date(arc_date: str) -> str:
    """ARC's digits (a short date is filled up) as an ISO timestamp."""
    d = (arc_date + "00000101000000"[len(arc_date) :]) if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(url: str, block: bytes) -> tuple[str, str]:
    """Record and content type that an ARC record is converted to."""
    if url.startswith("filedesc:"):
        return "warcinfo", "application/warc-fields"
    if block.startswith(b"HTTP/"):
        return "response", "application/http;msgtype=response"
    return "resource", "text/dns" if url.startswith("dns:") else "application/octet-stream"


def record_id(url: str, date: str, page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {page_id} {payload_digest}')}>"


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(block))}).items() if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def warc_records(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record, by declared lengths."""
    at, size = 0, len(content)
    while at < size:
        step = 1 << 12
        while (stop := bytes(content[at : at + step]).find(b"\r\n\r\n")) < 0:
            if at + step >= size:
                raise ValueError(f"no record header at byte {at}")
            step *= 2
        lines = bytes(content[at : at + stop]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = at + stop + 4
        end = begin + int(fields["content-length"])
        yield fields, bytes(content[begin:end])
        at = end + 4


def rows_per_file(sizes: DataFrame) -> int:
    """Rows of column ``n`` bytes that make a file of about FILE_BYTES; two at least."""
    mean = sizes.agg(F.avg(F.coalesce("n", F.lit(0)))).first()[0] or 0
    return int(max(2, FILE_BYTES // (mean + 600)))


def _write(rows: DataFrame, path: str, separator: str, each: int) -> None:
    """Gzip files of ``each`` rows: the records are text, the separator ends each. The fastest level makes files an eighth
    larger in a third of the time."""
    written = rows.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    written.option("maxRecordsPerFile", each).text(path)


def _opened(content: pa.Scalar) -> memoryview:
    return memoryview(gzip.decompress(content.as_buffer()))


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> int:
    """ARC files of about FILE_BYTES, in turn of version 1 and 2 (null payload: empty; null URL: a dash); returns rows a file."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("html"))
    each = rows_per_file(rows.select(F.octet_length("html").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        version, name, at, rows_out = str(1 + number % 2), f"siltstone-{number:05d}.arc", 0, 0
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows_out % each == 0:  # the writer begins a file
                    out.append(arc_version_block(version, name, date))
                    at, rows_out = len(out[-1]) + 1, rows_out + 1
                rows_out += 1
                out.append(arc_record(version, plain_url(url), date, http_response(page_id, (html or "").encode()), at, name))
                at += len(out[-1]) + 1
            yield pa.record_batch({"value": pa.array([x.decode() for x in out], pa.string())})

    _write(rows.mapInArrow(run, "value string"), path, "\n", each)
    return each


LIGHT = "page_id long, record_id string, url string, date string, type string, content_type string, payload_bytes long, payload_digest string"
RECORDS = LIGHT + ", head string, payload string"


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in schema.split(", "))])


def _converted(content: pa.Scalar) -> Iterator[dict]:
    """The records of an ARC file with what a WARC record needs."""
    for _, fields, block in arc_records(_opened(content)):
        url, date = fields["URL"], warc_date(fields["Archive-date"])
        kind, content_type = warc_type(url, block)
        head, payload = split_http(block) if kind == "response" else (b"", block)
        own = http_fields(head).get("x-page-id")
        page_id, d = int(own) if own else None, digest(payload)
        light = {"page_id": page_id, "record_id": record_id(url, date, page_id, d), "url": url, "date": date, "type": kind, "content_type": content_type}
        yield light | {"payload_bytes": len(payload), "payload_digest": d, "head": head, "payload": payload}


def _files(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(*columns)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files with their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out: list[dict] = []
                held = 0
                for r in _converted(content):
                    out.append(r | {"head": r["head"].decode(), "payload": r["payload"].decode()})
                    held += r["payload_bytes"]
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, _arrow(RECORDS))
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, _arrow(RECORDS))

    return _files(spark, path, "content").mapInArrow(run, RECORDS)


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files without their payloads, by ``path`` of the file and place ``at`` in it."""
    schema = f"path string, at long, {LIGHT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out = [{"path": name, "at": i} | {k: x for k, x in r.items() if k not in ("head", "payload")} for i, r in enumerate(_converted(content))]
                yield pa.RecordBatch.from_pylist(out, _arrow(schema))

    return _files(spark, path, "path", "content").mapInArrow(run, schema)


def revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``path, at, kept`` of records that revisit another one: of responses with equal payloads of at least ``least_bytes``
    all but those with the largest page_id, which is ``kept``. Only rows without payloads meet here."""
    light = index.filter(F.col("type") == "response").filter(F.col("payload_bytes") >= least_bytes)
    kept = light.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("kept_id"), F.max_by(F.struct("record_id", "url", "date"), "page_id").alias("kept")
    )
    found = lookup(light.select("path", "at", "page_id", "payload_digest", "payload_bytes"), kept.filter("kept_id IS NOT NULL"), ["payload_digest", "payload_bytes"])
    return found.filter(F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))).select("path", "at", "kept")


def convert(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0, each: int = 4096) -> None:
    """ARC files to WARC files of ``each`` records. Files are parsed once for an index without payloads, which decides
    what revisits what, and once to be written: payloads stay in their files, which alone travel, compressed."""
    again = revisits(cut(arc_index(spark, arc)), least_bytes)
    # a file has a bounded number of records
    by_file = again.groupBy("path").agg(F.collect_list("at").alias("at"), F.collect_list("kept").alias("kept"))
    files = _files(spark, arc, "path", "content").join(by_file, "path", "left").select("content", "at", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at, kept in zip(batch.column("content"), batch.column("at").to_pylist(), batch.column("kept").to_pylist(), strict=True):
                other = dict(zip(at or [], kept or [], strict=True))
                out, held = [], 0
                for i, r in enumerate(_converted(content)):
                    k = other.get(i)
                    block = r["head"] + (b"" if k else r["payload"])
                    fields = {"WARC-Type": "revisit" if k else r["type"], "WARC-Record-ID": r["record_id"], "WARC-Date": r["date"], "WARC-Target-URI": r["url"]}
                    if k:
                        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": k["record_id"], "WARC-Refers-To-Target-URI": k["url"], "WARC-Refers-To-Date": k["date"]}
                    fields |= {"WARC-Payload-Digest": f"sha1:{r['payload_digest']}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": r["content_type"]}
                    out.append(warc_record(fields, block).decode())
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.record_batch({"value": pa.array(out, pa.string())})
                        out, held = [], 0
                yield pa.record_batch({"value": pa.array(out, pa.string())})

    _write(files.mapInArrow(run, "value string"), warc, "\r\n\r\n", each)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_id, record_type, payload_bytes, payload_digest, refers_to_id`` of the files' records.

    Block digests are verified, and payload digests of responses.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for fields, block in warc_records(_opened(content)):
                    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    head, payload = split_http(block) if "application/http" in fields["content-type"] else (b"", block)
                    own = http_fields(head)
                    if f"sha1:{digest(block)}" != fields["warc-block-digest"] or kind != "revisit" and digest(payload) != said:
                        raise ValueError(f"digest mismatch in {fields['warc-record-id']}")
                    page_id = own.get("x-page-id")
                    n = int(own["content-length"]) if kind == "revisit" else len(payload)
                    out.append({"page_id": int(page_id) if page_id else None, "record_id": fields["warc-record-id"], "record_type": kind, "payload_bytes": n, "payload_digest": said, "refers_to_id": fields.get("warc-refers-to")})
                yield pa.RecordBatch.from_pylist(out, schema)

    kinds = "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string"
    return _files(spark, path, "content").mapInArrow(run, kinds)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read back:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null payloads are empty ones; repeated rows give a record each; a null page_id is
    never the response of a group that has another. No pages give no rows.
    """
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    each = write_arc(pages, arc)
    convert(spark, arc, warc, least_bytes, each)
    found = cut(read_warc(spark, warc))  # a few fields a record
    ids = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    return lookup(found, ids, ["refers_to_id"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
