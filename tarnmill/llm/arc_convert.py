"""WARC: a converter from legacy ARC archives, with revisit records for repeated payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnmill.llm import textbytes as tb
from tarnmill.llm.common import materialise, new_path

#: Fields of an ARC header line by version of the archive; a URL never holds a blank.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A content type may hold blanks after its first part; dates have 14 digits, or fewer pairs, or 17.
_DATE, _TYPE = rb"\d{4}(?:\d\d){0,5}(?:\d{3})?", rb"[^ /]+/[^ ]+(?: [^ ]+)*|[^ ]+"
_HEADER = {
    1: re.compile(rb"^(\S+) (\S+) (" + _DATE + rb") (" + _TYPE + rb") (\d+)$"),
    2: re.compile(rb"^(\S+) (\S+) (" + _DATE + rb") (" + _TYPE + rb") (\S+) (\S+) (\S+) (\d+) (\S+) (\d+)$"),
}
#: An archive is closed once it holds so many bytes of content, or so many records.
ROLL_BYTES, ROLL_RECORDS = 8 << 20, 20_000


@dataclass
class ArcRecord:
    """``offset``: place of the header line in the uncompressed archive; ``problem``: why there is no whole content."""

    offset: int
    fields: dict[str, str]
    content: bytes
    problem: str | None = None
    version_block: bool = False


def open_read(path: str):
    """The archive at a path of any store that pyarrow knows, as a stream without its compression."""
    store, name = pafs.FileSystem.from_uri(path)
    return gzip.GzipFile(fileobj=store.open_input_stream(name, compression=None))


class ArchiveWriter:
    """An archive of one gzip member per record. ``path`` names the task's attempt, so that none overwrites another."""

    def __init__(self, path: str) -> None:
        self.path, self.records, self.bytes, self.offset = path, 0, 0, 0
        store, name = pafs.FileSystem.from_uri(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.stream = store.open_output_stream(name, compression=None)

    def write(self, record: bytes) -> None:
        self.stream.write(gzip.compress(record, 1, mtime=0))
        self.offset += len(record)

    def close(self) -> None:
        self.stream.close()


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ARC


def arc_version_block(version: int, name: str, date: str) -> bytes:
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 tarnmill\n{names[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain" + (f" 200 - - 0 {name}" if version == 2 else "")
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, content_type: str, status: str, name: str, offset: int, content: bytes) -> bytes:
    line = f"{url} {ip} {date} {content_type}" + (f" {status} - - {offset} {name}" if version == 2 else "")
    return f"{line} {len(content)}\n".encode() + content + b"\n"


class _Lines:
    """A stream that takes back bytes already read."""

    def __init__(self, stream) -> None:
        self.stream, self.back, self.offset = stream, b"", 0

    def readline(self) -> bytes:
        if self.back:
            at = self.back.find(b"\n") + 1
            line, self.back = (self.back[:at], self.back[at:]) if at else (self.back + self.stream.readline(), b"")
        else:
            line = self.stream.readline()
        self.offset += len(line)
        return line

    def read(self, n: int) -> bytes:
        out, self.back = self.back[:n], self.back[n:]
        if len(out) < n:
            out += self.stream.read(n - len(out))
        self.offset += len(out)
        return out

    def unread(self, data: bytes) -> None:
        self.back = data + self.back
        self.offset -= len(data)


def read_arc(stream) -> Iterator[tuple[int, ArcRecord]]:
    """(version, record) of an uncompressed ARC stream; the first record is the version block, and no later one is,
    whatever its URL.

    The version block is a version-1 or version-2 line by its number of fields; its content begins with the
    version, which tells how the lines of all other records are read. A record whose declared length passes the
    end of the archive or does not end at a line's end, and bytes that are no header line, give a record with
    ``problem``. After a wrong length reading goes on at the first header line behind the record's own, so that no
    later record is lost; what lies between is the record's content.
    """
    version, first, lines = 1, True, _Lines(stream)
    while True:
        at, line = lines.offset, lines.readline()
        if not line:
            return
        bare = line.rstrip(b"\r\n")
        if not bare:
            continue
        found = next((v for v in (2, 1) if _HEADER[v].match(bare)), None) if first else version if _HEADER[version].match(bare) else None
        if found is None:
            yield version, ArcRecord(at, {}, bare, "not a header line")
            continue
        fields = dict(zip(ARC_FIELDS[found], (x.decode("utf-8", "replace") for x in _HEADER[found].match(bare).groups())))
        length = int(fields["length"])
        content, problem = lines.read(length), None
        block = first and fields["url"].startswith("filedesc:")
        if first:
            version, first = int(content[:1]) if block and content[:1] in (b"1", b"2") else found, False
        if len(content) < length:
            problem = "shorter than its declared length"
        else:
            after = lines.read(1)
            lines.unread(after)
            if after not in (b"", b"\n", b"\r") and not content.endswith(b"\n"):
                problem = "its declared length ends inside a line"
        if problem:
            lines.unread(content)
            content = b""
            while line := lines.readline():
                if _HEADER[version].match(line.rstrip(b"\r\n")):
                    lines.unread(line)
                    break
                content += line
        yield version, ArcRecord(at, fields, content, problem, block)


# WARC


def warc_date(date: str) -> str:
    """A missing month or day is the first one, a missing time midnight; milliseconds are left out."""
    d = date[:14] + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    """The same for the same place in the same ARC, so that a repeated conversion gives the same identifiers."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(header block with its blank line, payload); content that is no HTTP message is all payload."""
    if content.startswith(b"HTTP/"):
        at = content.find(b"\r\n\r\n")
        if at >= 0:
            return content[: at + 4], content[at + 4 :]
    return b"", content


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def arc_to_warc(version: int, record: ArcRecord, archive: str, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record.

    The version block gives a warcinfo record, HTTP content a response, other content a resource. With
    ``refers_to`` (identifier, URI and date of the response with the same payload) a revisit is written, which
    holds the HTTP header alone.
    """
    f = record.fields
    headers = [("WARC-Type", ""), ("WARC-Record-ID", record_id(archive, record.offset)), ("WARC-Date", warc_date(f["date"]))]
    if record.version_block:
        headers[0] = ("WARC-Type", "warcinfo")
        return warc_record([*headers, ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], f"format: WARC File Format 1.1\r\nconverted-from: ARC/{version}\r\n".encode())
    http, payload = split_http(record.content)
    headers.append(("WARC-Target-URI", f["url"]))
    if re.fullmatch(r"[0-9.]{7,15}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*", f["ip"]) and f["ip"] != "0.0.0.0":
        headers.append(("WARC-IP-Address", f["ip"]))
    headers.append(("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)))
    if refers_to is not None:
        headers[0] = ("WARC-Type", "revisit")
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to[0]), ("WARC-Refers-To-Target-URI", refers_to[1]), ("WARC-Refers-To-Date", warc_date(refers_to[2])), ("WARC-Truncated", "length")]
        block = http
    else:
        headers[0] = ("WARC-Type", "response" if http else "resource")
        block = record.content
    headers += [("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Type", "application/http; msgtype=response" if http else f["content_type"])]
    return warc_record(headers, block)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k.lower()] = v
        yield headers, stream.read(int(headers["content-length"]))


# Spark jobs

_MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])
_CONVERTED = T.StructType([*_MANIFEST.fields, T.StructField("refused", T.LongType())])


def _spread(archives: DataFrame, n: int) -> DataFrame:
    """The list of ``n`` archives dealt out to tasks: one each, or several where the archives are many."""
    most = 4 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(max(1, min(n, most)))


def _attempt(kind: str, number: int) -> str:
    t = TaskContext.get()
    return f"part-{t.partitionId():05d}-{number:05d}-a{t.taskAttemptId()}.{kind}.gz"


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20080101000000") -> DataFrame:
    """Writes the pages as ARC archives of versions 1 and 2 in turn; returns their manifest (path, records).

    The archives lie in the shared folder. A task's attempt writes files of its own, and the manifest, a table with
    Spark's commit protocol, names only those of attempts that succeeded. A page's id travels in an HTTP header.
    Blanks in URLs are escaped; a null URL is written "-". Null html is an empty payload; a null id has no header and
    is read back as null; other columns are dropped; an empty table gives an empty manifest.
    """
    folder = new_path(pages.sparkSession, "arc")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("-")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    arrow = to_arrow_schema(_MANIFEST)

    def write(batches):
        out, number, done = None, 0, []
        for batch in batches:
            for piece in tb.slices(batch, "html"):
                for page, url, html in zip(*(piece.column(k).to_pylist() for k in range(3))):
                    if out is None:
                        version = 1 + (TaskContext.get().partitionId() + number) % 2
                        out = ArchiveWriter(f"{folder}/{_attempt('arc', number)}")
                        name = out.path.rpartition("/")[2]
                        out.write(arc_version_block(version, name, date))
                    body = html.encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + "\r\n"
                    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) or "-"
                    out.write(arc_record(version, url, "192.0.2.1", date, "text/html", "200", name, out.offset, head.encode() + body))
                    out.records, out.bytes = out.records + 1, out.bytes + len(body)
                    if out.bytes >= ROLL_BYTES or out.records >= ROLL_RECORDS:
                        out.close()
                        done.append((out.path, out.records))
                        out, number = None, number + 1
        if out is not None:
            out.close()
            done.append((out.path, out.records))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records"), x)) for x in done], schema=arrow)

    return materialise(rows.mapInArrow(write, _MANIFEST), "arc-manifest")


def index_arcs(manifest: DataFrame) -> DataFrame:
    """(path, offset, url, date, page, digest, payload_bytes, problem) of each content record of the archives."""
    schema = T.StructType(
        [T.StructField("path", T.StringType()), T.StructField("offset", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("url", "date", "page", "digest")]
        + [T.StructField("payload_bytes", T.LongType()), T.StructField("problem", T.StringType())]
    )
    arrow = to_arrow_schema(schema)

    def index(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_read(path) as stream:
                    for _, r in read_arc(stream):
                        if r.version_block:
                            continue
                        http, payload = split_http(r.content)
                        page = re.search(rb"\r\nX-Page-Id: ([^\r]*)\r\n", http)
                        rows.append(
                            {"path": path, "offset": r.offset, "url": r.fields.get("url"), "date": r.fields.get("date"), "page": page and page[1].decode(),
                             "digest": sha1_base32(payload), "payload_bytes": len(payload), "problem": r.problem}
                        )
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return manifest.select("path").mapInArrow(index, schema)


def convert_arcs(manifest: DataFrame, min_payload: int = 0) -> DataFrame:
    """Converts the ARC archives of a manifest, one WARC for each, and returns the manifest (path, records, refused) of
    the WARCs.

    Records with equal payloads of at least ``min_payload`` bytes become one response, that of the smallest page
    number (then page text, archive and place), and revisits that refer to it. Only index rows (no content) are
    grouped by digest, with a map-side combined minimum; each archive is then rewritten by one task from a list of
    its own revisits, which an archive's size bounds. Records with a problem are not converted but counted as
    ``refused``; ``index_arcs`` lists them. An empty manifest gives an empty one.
    """
    n = manifest.count()
    index = materialise(index_arcs(_spread(manifest, n)).filter("problem IS NULL"), "arc-index")
    place = F.struct(F.col("page").isNull().alias("none"), F.expr("try_cast(page AS DECIMAL(38,0))").alias("number"), "page", "path", "offset", "url", "date")
    first = index.filter(F.col("payload_bytes") >= min_payload).groupBy("digest", "payload_bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = (
        index.join(first, ["digest", "payload_bytes"]).filter((F.col("path") != F.col("first.path")) | (F.col("offset") != F.col("first.offset")))
        .groupBy("path").agg(F.collect_list(F.struct("offset", F.col("first.path").alias("to_path"), F.col("first.offset").alias("to_offset"), F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"))).alias("revisits"))
    )
    folder = new_path(manifest.sparkSession, "warc")
    plan = manifest.select("path").join(revisits, "path", "left")
    arrow = to_arrow_schema(_CONVERTED)

    def convert(batches):
        number = 0
        for batch in batches:
            for path, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                archive = path.rpartition("/")[2]
                to = {r["offset"]: (record_id(r["to_path"].rpartition("/")[2], r["to_offset"]), r["to_url"], r["to_date"]) for r in own or ()}
                out, refused = ArchiveWriter(f"{folder}/{_attempt('warc', number)}"), 0
                number += 1
                with open_read(path) as stream:
                    for version, r in read_arc(stream):
                        if r.problem is None:
                            out.write(arc_to_warc(version, r, archive, to.get(r.offset)))
                            out.records += 1
                        else:
                            refused += 1
                out.close()
                yield pa.RecordBatch.from_pylist([{"path": out.path, "records": out.records, "refused": refused}], schema=arrow)

    return materialise(_spread(plan, n).mapInArrow(convert, _CONVERTED), "warc-manifest")


def read_warcs(manifest: DataFrame) -> DataFrame:
    """The records of the archives but warcinfo: record id, type, URI, date, page, digest, payload_bytes, refers_to.

    Of a response, digest and length are those of the payload as read; a digest that differs from the header's
    raises an error. A revisit holds no payload; its
    HTTP header has the length, which is null without one. An empty manifest gives no rows.
    """
    names = ("record_id", "record_type", "uri", "date", "page", "payload_digest", "refers_to_id")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in names), T.StructField("payload_bytes", T.LongType())])
    arrow = to_arrow_schema(schema)

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_read(path) as stream:
                    for h, block in read_warc(stream):
                        kind = h["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, payload = split_http(block)
                        page = re.search(rb"\r\nX-Page-Id: ([^\r]*)\r\n", http)
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        size = len(payload)
                        if kind == "revisit":
                            length = re.search(rb"\r\nContent-Length: ([0-9]+)\r\n", http)
                            size = int(length[1]) if length else None
                        elif sha1_base32(payload) != digest:
                            raise ValueError(f"{path}: the payload of {h['warc-record-id']} does not have its digest")
                        rows.append(dict(zip(names, (h["warc-record-id"], kind, h["warc-target-uri"], h["warc-date"], page and page[1].decode(), digest, h.get("warc-refers-to")))) | {"payload_bytes": size})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return _spread(manifest.select("path"), manifest.count()).mapInArrow(read, schema)


def op2_arc_convert(spark, sf_dir: str) -> DataFrame:
    """Pages -> ARC archives -> WARC archives -> rows read back.

    Null html is an empty payload, a null page_id stays null and comes last in the choice of the response; equal
    pages with one page_id are one response and revisits of it; an empty table gives an empty table.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = materialise(read_warcs(convert_arcs(write_arcs(pages))), "warc-rows")
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page").alias("to_page"))
    out = records.join(responses, "refers_to_id", "left")
    return out.select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("to_page").cast("long").alias("refers_to")
    )


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS k,
  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, sha1(h) AS x FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM d"""
