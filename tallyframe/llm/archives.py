"""Legacy web archives: ARC records read by the header lines of their version and their
declared lengths, and the WARC records that say the same.

ARC version 1 has five fields in a record's line, version 2 ten; the version stands in
the file's first record (``filedesc://``). A converted record gets an identifier derived
from its archive's name and its place there, the time, a type (response, or revisit of an
equal payload) and digests.

The job has three steps over files in a store that all executors reach: ARC files are
listed record by record (place, size, digest), records with equal payloads find their
first by one aggregate, and every file is converted to a WARC file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_arrow, fresh_path, partitions, text_or_empty, written
from tallyframe.llm.token_files import filesystem

#: The fields of a record's line, by version of the format. Fixed values.
FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"],
}
#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 100


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes
    #: Where the record's line begins in the uncompressed file.
    at: int = 0


def arc_file_record(version: int, name: str, date: str) -> bytes:
    """The record that opens an ARC file and declares its version."""
    lines = f"{version} 0 tallyframe\n" + ("URL IP-address Archive-date Content-type Archive-length\n" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n")
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", lines.encode(), code="200", name=name)


def arc_record(version: int, url: str, ip: str, date: str, kind: str, body: bytes, code: str = "200", name: str = "-", offset: int = 0) -> bytes:
    url = re.sub(r"\s", "%20", url) or "-"  # fields stand between spaces
    values = {"url": url, "ip": ip, "date": date, "type": kind, "code": code, "checksum": hashlib.md5(body).hexdigest(), "location": "-", "offset": str(offset), "filename": name, "length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def read_arc(stream: BinaryIO | bytes) -> Iterator[ArcRecord]:
    """The records of an open, uncompressed ARC file, one at a time, without the version
    record that may open it. A line that does not fit the version's fields, or a length
    beyond the file, raises ValueError."""
    stream = io.BytesIO(stream) if isinstance(stream, bytes) else stream
    version, at, first = 0, 0, True
    while line := stream.readline():
        begin, at = at, at + len(line)
        if not line.strip(b"\r\n"):  # blank lines between records
            continue
        if not line.endswith(b"\n"):
            raise ValueError("a record's line does not end")
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if first:
            version = 2 if len(parts) == len(FIELDS[2]) else 1
        names = FIELDS[version]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no record line of version {version}: {line[:80]!r}")
        body = stream.read(int(parts[-1]))
        at += len(body)
        if len(body) < int(parts[-1]):
            raise ValueError("a record is cut off")
        fields = dict(zip(names, parts, strict=True))
        opens, first = first and fields["url"].startswith("filedesc://"), False
        if opens:
            version = int(body[:1]) if body[:1] in (b"1", b"2") else version
        else:
            yield ArcRecord(version, fields, body, begin)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; without a head, none and the body."""
    if body[:5] == b"HTTP/":
        end = body.find(b"\r\n\r\n")
        if end >= 0:
            return body[: end + 4], body[end + 4 :]
        end = body.find(b"\n\n")
        if end >= 0:
            return body[: end + 2], body[end + 2 :]
    return b"", body


def _warc(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def record_id(archive: str, at: int) -> str:
    """The identifier of the record that begins ``at`` in the archive of that name."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}>"


def warc_date(date: str) -> str:
    """An ARC date (14 digits, or fewer from the left) as a WARC date."""
    digits = re.sub(r"\D", "", date)[:14].ljust(8, "0")
    digits = digits[:4] + (digits[4:6] if digits[4:6] > "00" else "01") + (digits[6:8] if digits[6:8] > "00" else "01") + digits[8:].ljust(6, "0")
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def convert(record: ArcRecord, archive: str, refers_to: dict[str, str] | None = None) -> bytes:
    """The WARC record of a record of ``archive``; with ``refers_to`` (headers that name
    the record with the same payload) a revisit that carries the HTTP head alone."""
    head, payload = split_http(record.body)
    block = head if refers_to is not None else record.body
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(archive, record.at)),
        ("WARC-Date", warc_date(record.fields["date"])),
        ("WARC-Target-URI", record.fields["url"]),
        ("WARC-IP-Address", record.fields["ip"]),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response" if head else record.fields["type"]),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *refers_to.items()]
    return _warc(headers, block)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an open, uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("a record is cut off")
        yield headers, block


def _page(head: bytes) -> int | None:
    """The page id that an HTTP head names."""
    found = re.search(rb"(?im)^x-page-id: *(-?\d+)\r?$", head)
    return int(found[1]) if found else None


def _opened(path: str, mode: str):
    store, place = filesystem(path)
    if mode == "w":
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(place, compression=None)
    return store.open_input_stream(place, compression=None)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def write_arcs(pages: DataFrame, path: str, version: int = 2, date: str = "20240607120000") -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as compressed ARC files, one a task, and
    returns the manifest (path, n). The files of tasks that ended well are listed.

    A null html is an empty payload, a null or empty url ``-``, white space in urls is
    written as %20; rows with null or equal page_ids give a record each. A payload of any
    size is one record. Other columns are not written; an empty table gives no file.
    """
    bounded_arrow(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("-")).alias("url"), text_or_empty("html").alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arc.gz"
        out, n = None, 0
        for batch in batches:
            if out is None:
                out = _opened(at, "w")
                out.write(gzip.compress(arc_file_record(version, _name(at), date), 1, mtime=0))
            for page, url, html in zip(*batch.columns, strict=True):
                payload = html.as_py().encode("utf-8", "surrogatepass")
                named = "" if page.as_py() is None else f"X-Page-ID: {page.as_py()}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n"
                out.write(gzip.compress(arc_record(version, url.as_py(), "0.0.0.0", date, "text/html", head.encode() + payload), 1, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [at], "n": [n]})

    return written(rows.mapInArrow(write, "path string, n long"), "arcs")


def listed(arcs: DataFrame) -> DataFrame:
    """(path, at, page, url, date, digest, size) of every record of the ARC files ``arcs`` (path)."""
    schema = "path string, at long, page long, url string, date string, digest string, size long"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _opened(path, "r") as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for r in read_arc(stream):
                        head, payload = split_http(r.body)
                        rows.append((path, r.at, _page(head), r.fields["url"], warc_date(r.fields["date"]), hashlib.sha256(payload).hexdigest(), len(payload)))
                        if len(rows) == 5000:
                            yield _batch(rows, kinds, schema)
                            rows = []
                if rows:
                    yield _batch(rows, kinds, schema)

    return arcs.select("path").repartition(partitions(arcs.sparkSession), "path").mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])


def revisits(records: DataFrame) -> DataFrame:
    """(path, at, first) of every record of ``listed`` whose payload of ``LEAST_REVISIT``
    bytes or more is that of an earlier record, ``first``: the one of the smallest page
    (records of pages without a number come last), then of the smallest archive and place.

    Only digests that stand more than once are joined: a map-side combined minimum finds
    them, and a digest that many records share is split like any skewed join.
    """
    order = F.struct(F.coalesce("page", F.lit(2**63 - 1).cast("long")).alias("o"), "path", "at", "page", "url", "date")
    long = records.filter(F.col("size") >= LEAST_REVISIT)
    shared = long.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    same = (F.col("path") == F.col("first.path")) & (F.col("at") == F.col("first.at"))
    # Rows that share the smallest page are all responses: a page does not revisit itself.
    same = same | F.col("page").eqNullSafe(F.col("first.page")) & F.col("page").isNotNull()
    return long.join(written(shared, "originals"), "digest").filter(~same).select("path", "at", "first")


def convert_archives(arcs: DataFrame, path: str) -> DataFrame:
    """Converts the ARC files ``arcs`` (path) to compressed WARC files in the folder
    ``path`` and returns the manifest (path, n). Payloads of ``LEAST_REVISIT`` bytes or
    more are stored once among all files."""
    again = revisits(written(listed(arcs), "records"))
    lists = again.groupBy("path").agg(F.collect_list(F.struct("at", "first")).alias("again"))  # no more than a file has records
    todo = arcs.select("path").join(lists, "path", "left").repartition(partitions(arcs.sparkSession), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, again in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                firsts = {x["at"].as_py(): x["first"] for x in again.values} if again.is_valid else {}
                at, n = f"{path}/{_name(source).removesuffix('.arc.gz')}-{uuid.uuid4().hex}.warc.gz", 0
                with _opened(source, "r") as raw, gzip.GzipFile(fileobj=raw) as stream, _opened(at, "w") as out:
                    for r in read_arc(stream):
                        first = firsts[r.at].as_py() if r.at in firsts else None
                        refers = first and {
                            "WARC-Refers-To": record_id(_name(first["path"]), first["at"]),
                            "WARC-Refers-To-Target-URI": first["url"],
                            "WARC-Refers-To-Date": first["date"],
                            **({} if first["page"] is None else {"WARC-Refers-To-Page": str(first["page"])}),
                        }
                        out.write(gzip.compress(convert(r, _name(source), refers), 3, mtime=0))
                        n += 1
                yield pa.RecordBatch.from_pydict({"path": [at], "n": [n]})

    return written(todo.mapInArrow(run, "path string, n long"), "warcs")


def _described(records: Iterable[tuple[dict[str, str], bytes]]) -> Iterator[tuple]:
    for headers, block in records:
        head, payload = split_http(block)
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        kind = headers["warc-type"]
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        size = int(http["content-length"]) if kind == "revisit" else len(payload)
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{headers['warc-record-id']}: the payload does not have its digest")
        if hashlib.sha256(block).hexdigest() != headers["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError(f"{headers['warc-record-id']}: the block does not have its digest")
        original = headers.get("warc-refers-to-page")
        yield (_page(head), size, digest, kind, int(original) if original else None)


def read_warcs(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record; a
    block or payload without its digest raises ValueError."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path, "r") as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows = []
                    for row in _described(read_warc(stream)):
                        rows.append(row)
                        if len(rows) == 5000:
                            yield _batch(rows, kinds, schema)
                            rows = []
                    if rows:
                        yield _batch(rows, kinds, schema)

    return manifest.select("path").repartition(partitions(manifest.sparkSession), "path").mapInArrow(read, schema)


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return read_warcs(convert_archives(write_arcs(pages, fresh_path(spark, "arcs")), fresh_path(spark, "warcs")))


def query_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g"""
