"""Legacy archive converter: ARC files to WARC files.

An ARC file begins with a version block whose second line names the fields of
the header lines that follow; version 1 and 2 differ there.  Each record is a
header line and as many bytes as it declares.  The converter reads the fields
by name, synthesises the equivalent WARC record (identifier, date, type, payload
and block digests) and writes revisits for payloads that another record holds.
Records with an HTTP status line become responses, all others (``dns:``, FTP, bodies
without a header) resources, and the version block a warcinfo record.

Archives may be plain, gzipped with a member per record, or gzipped as a whole; those
written here have a member per record.  Pass one reads the archives and keeps
identifiers and digests only; equal payloads are grouped by digest; pass two
reads the archives again and writes WARC, so payloads are never shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import ipaddress
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, scratch_path, stored
from .files import read_file, write_file

# The header fields of both ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: Bytes of an archive before the next one is begun.
FILE_BYTES = 32 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: RFC 4122 name space of URLs
_GAPS = re.compile(r"[\x00-\x20\x7f\udc80-\udcff]")  # with the bytes that are no UTF-8, as decoded by _text
_BLANK = re.compile(rb"\r?\n\r?\n")
_DATE = re.compile(r"[0-9]{4,17}").fullmatch
# Digits of an ARC date that a WARC date may keep, and its form with them.
DATES = [(14, "%Y%m%d%H%M%S", "%Y-%m-%dT%H:%M:%SZ"), (12, "%Y%m%d%H%M", "%Y-%m-%dT%H:%MZ"), (8, "%Y%m%d", "%Y-%m-%d"),
         (6, "%Y%m", "%Y-%m"), (4, "%Y", "%Y")]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def _text(line: bytes) -> str:
    """Header lines of old archives may hold bytes of other character sets; they are kept."""
    return line.decode("utf-8", "surrogateescape")


def escaped(url: str) -> str:
    """White space, control characters and bytes that are no UTF-8 as %XX."""
    return _GAPS.sub(lambda m: f"%{ord(m[0]) & 0xFF:02X}", url)


def warc_date(*dates: str) -> str:
    """The first of ``dates`` (ARC digits) that is a time, to as many digits as are valid."""
    for d in dates:
        for digits, read, written in DATES:
            try:
                return datetime.strptime(d[:digits] if len(d) >= digits else "", read).strftime(written)
            except ValueError:
                continue
    raise ValueError(f"none of {dates} is a time")


# --------------------------------------------------------------------- ARC --
def arc_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    return _arc_line(version, fields, body, name) + body + b"\n"


def _arc_line(version: int, fields: dict[str, str], body: bytes, name: str) -> bytes:
    full = {"Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name,
            "Archive-length": str(len(body))} | fields
    return " ".join(full[k] for k in ARC_FIELDS[version].split()).encode("utf-8", "surrogatepass") + b"\n"


def arc_record(version: int, name: str, url: str | None, date: str, http: bytes) -> bytes:
    """A record; white space and control characters of the URL are escaped, a null or empty one is '-'."""
    fields = {"URL": escaped(url or "") or "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
              "Checksum": hashlib.md5(http).hexdigest() if version == 2 else "-"}
    return _arc_line(version, fields, http, name) + http + b"\n"


@dataclass
class ArcRecord:
    """``offset`` is the record's place in the uncompressed archive, ``made`` the archive's own date."""
    offset: int
    fields: dict[str, str]
    content: bytes
    made: str = ""

    @property
    def kind(self) -> str:
        """The equivalent WARC type: told by the content, as any scheme may have been fetched through a proxy."""
        if self.fields["URL"].startswith("filedesc://"):
            return "warcinfo"
        return "response" if self.content.startswith(b"HTTP/") else "resource"

    def http(self) -> tuple[bytes, bytes]:
        """HTTP header with its blank line, and payload; all is payload in records of another kind."""
        return split_http(self.content) if self.kind == "response" else (b"", self.content)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, which old servers end with line feeds alone, and payload; without one all is header."""
    cut = _BLANK.search(content)
    return (content[: cut.end()], content[cut.end():]) if cut else (content, b"")


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; fed in short pieces, as what is
    left over of a piece is copied."""
    at = 0
    while at < len(data):
        z, out, pos = zlib.decompressobj(31), [], at
        while not z.eof:
            if pos >= len(data):
                raise ValueError(f"member at {at} is cut off")
            out.append(z.decompress(data[pos: pos + (1 << 15)]))
            pos += 1 << 15
        yield at, b"".join(out)
        at = min(pos, len(data)) - len(z.unused_data)


def _fields(names: list[str], line: str) -> dict[str, str] | None:
    """A header line's fields.  The URL, its first one, and the content type, the one behind
    the date, may hold spaces, so both ends are counted from the date."""
    values = line.split(" ")
    date = names.index("Archive-date")
    behind = len(names) - 1 - date
    at = len(values) - 1 - behind  # unless the content type holds spaces
    if at < date or not _DATE(values[at]):
        at = max((k for k in range(date, at) if _DATE(values[k])), default=-1)
        if at < 0:
            return None
    url, kind = at - date + 1, len(values) - behind + 1  # where the URL and the content type end
    found = [" ".join(values[:url]), *values[url: at + 1], " ".join(values[at + 1: kind]), *values[kind:]]
    return dict(zip(names, found, strict=True))


def read_arc(data: bytes, info: bool = False) -> Iterator[ArcRecord]:
    """Records after the version block (with ``info`` also that), with the header fields by name.

    ``data`` is a whole archive, plain or gzipped; no other record is held beside it and one member."""
    names, base, made = [], 0, ""
    gzipped = data.startswith(b"\x1f\x8b")
    for block in (block for _, block in members(data)) if gzipped else [data]:
        pos = 0
        while True:
            while pos < len(block) and block[pos] in b"\r\n":
                pos += 1
            if pos == len(block):
                break
            end = block.find(b"\n", pos)
            line = _text(block[pos: end if end >= 0 else len(block)]).rstrip("\r")
            at, last = base + pos, line.rpartition(" ")[2]
            if not re.fullmatch("[0-9]+", last):
                raise ValueError(f"record at {at} declares no length")
            body = block[end + 1: end + 1 + int(last)] if end >= 0 else b""
            if len(body) < int(last):
                raise ValueError(f"record at {at} declares {last} bytes and has {len(body)}")
            pos = end + 1 + len(body) if end >= 0 else len(block)
            head = line.startswith("filedesc://")
            if head:
                names = _text(body).splitlines()[1].split()
            fields = _fields(names, line) if names else None
            if fields is None:
                raise ValueError(f"record at {at} lacks fields that its version block names: {names}")
            if head:
                made = fields["Archive-date"]
            if info or not head:
                yield ArcRecord(at, fields, body, made)
        base += len(block)


def found_arcs(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest (file) of the archives that lie in a folder, listed by Spark's reader; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").load(folder)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"))


def _write_arcs(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, size, out = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([write_file(folder, f"pages-{part:06d}-{made:06d}", out, ".arc.gz")])], ["file"])

        version = 1 + part % 2  # both versions are written, and so both are read
        name = f"pages-{part:06d}.arc"
        for b in batches:
            for page, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                own = f"X-Page-Id: {page}\r\n" if page is not None else ""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                if not out:
                    out.append(_member(arc_header(version, name, date)))
                out.append(_member(arc_record(version, name, url, date, http)))
                size += len(out[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    made, size, out = made + 1, 0, []
        if out:
            yield flush()
    return run


def write_arcs(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               date: str = "20240101000000") -> DataFrame:
    """Write pages as ARC files (versions 1 and 2 by turns of partitions); returns the manifest (file)."""
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return stored(rows.mapInArrow(_write_arcs(folder, date), "file string"), "arcs")


# -------------------------------------------------------------------- WARC --
def _page_id(http: bytes) -> int | None:
    m = re.search(rb"(?m)^X-Page-Id: (-?[0-9]+)\r$", http)
    return int(m[1]) if m else None


def _stem(name: str) -> str:
    """An archive's name without its suffix and what tells attempts of write_file apart."""
    return re.sub(r"(-[0-9a-f]{12})?\.arc(\.gz)?$", "", name)


def record_id(r: ArcRecord, archive: str, digest: str) -> str:
    """From the record's place, so the same in every run over the same archives."""
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive} {r.offset} {escaped(r.fields['URL'])} {r.fields['Archive-date']} {digest}')}"


def _warc(head: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *head, f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _known_address(ip: str) -> bool:
    """ARC writes 0.0.0.0 where no address is known."""
    try:
        return not ipaddress.ip_address(ip).is_unspecified
    except ValueError:
        return False


def warcinfo_record(r: ArcRecord, archive: str) -> bytes:
    """The version block as a warcinfo record; its first two lines and the archive's name are kept as fields."""
    version, names = (_text(r.content).splitlines() + ["", ""])[:2]
    block = "".join(f"{k}: {v}\r\n" for k, v in [
        ("format", "WARC File Format 1.1"), ("conformsTo", "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/"),
        ("isPartOf", r.fields["URL"].removeprefix("filedesc://")), ("arc-version", version), ("arc-fields", names)])
    block = block.encode("utf-8", "surrogateescape")
    return _warc(["WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(r, archive, sha1_base32(block))}>",
                  f"WARC-Date: {warc_date(r.made)}", "Content-Type: application/warc-fields"], block)


def warc_record(r: ArcRecord, archive: str, refers: tuple[int | None, str] | None) -> bytes:
    """The equivalent WARC/1.1 record; ``refers`` (page, record id) makes it a revisit, which keeps the HTTP header only."""
    if r.kind == "warcinfo":
        return warcinfo_record(r, archive)
    http, payload = r.http()
    digest = sha1_base32(payload)
    head = [
        f"WARC-Type: {'revisit' if refers else r.kind}", f"WARC-Record-ID: <{record_id(r, archive, digest)}>",
        f"WARC-Date: {warc_date(r.fields['Archive-date'], r.made)}", f"WARC-Target-URI: {escaped(r.fields['URL'])}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if _known_address(r.fields["IP-address"]):
        head.append(f"WARC-IP-Address: {r.fields['IP-address']}")
    if refers:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers[1]}>"] + ([f"X-Refers-To-Page: {refers[0]}"] if refers[0] is not None else [])
    if r.kind == "response":
        head += [f"WARC-Identified-Payload-Type: {r.fields['Content-type']}", "Content-Type: application/http; msgtype=response"]
    else:
        head.append(f"Content-Type: {r.fields['Content-type'].strip() or 'application/octet-stream'}")
    return _warc(head, http if refers else http + payload)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record."""
    for at, rec in members(data):
        head, _, rest = rec.partition(b"\r\n\r\n")
        lines = _text(head).split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        h = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(h["Content-Length"])]
        if h["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"block digest differs at {at}")
        yield h, block


def _digests(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for r in read_arc(read_file(folder, name)):
                    http, payload = r.http()
                    digest, page = sha1_base32(payload), _page_id(http)
                    rows.append((name, r.offset, page, digest, len(payload), record_id(r, _stem(name), digest), r.kind))
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 ["file", "at", "page", "digest", "bytes", "record", "kind"])
    return run


def _convert(arcs: str, warcs: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, revisits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                refers = {x["at"]: (x["page"], x["record"]) for x in revisits or []}
                out = [_member(warc_record(r, _stem(name), refers.get(r.offset))) for r in read_arc(read_file(arcs, name), info=True)]
                yield pa.RecordBatch.from_arrays([pa.array([write_file(warcs, _stem(name), out, ".warc.gz")])], ["file"])
    return run


def convert(arcs: str, manifest: DataFrame, warcs: str, least_bytes: int = 0) -> DataFrame:
    """ARC files -> WARC files; returns their manifest (file).  ``manifest`` names files in
    the folder ``arcs``, such as write_arcs or found_arcs give; an archive is read whole by one task.

    Resources are never revisits.  Of responses with equal payloads of at least ``least_bytes`` the one with the
    smallest page id is written as response (null ids last, then by place in
    the archives), the others as revisits of it."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    files = manifest.repartition(n, "file")
    seen = stored(files.mapInArrow(_digests(arcs), "file string, at long, page long, digest string, bytes long, record string, kind string"), "digests")
    first = seen.filter((F.col("kind") == "response") & (F.col("bytes") >= least_bytes)).groupBy("digest", "bytes").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("page").isNull().alias("none"), "page", "file", "at", "record")).alias("f")).filter("n > 1")
    again = seen.filter("kind = 'response'").join(first, ["digest", "bytes"]).filter("not (file = f.file and at = f.at)") \
        .groupBy("file").agg(F.collect_list(F.struct("at", F.col("f.page").alias("page"), F.col("f.record").alias("record"))).alias("revisits"))
    todo = stored(manifest.join(again, "file", "left"), "revisits").repartition(n, "file")  # an archive's revisits: bounded by FILE_BYTES
    return stored(todo.select("file", "revisits").mapInArrow(_convert(arcs, warcs), "file string"), "warcs")


def _records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for h, block in read_warc(read_file(folder, name)):
                    kind = h["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = (b"", block) if kind == "resource" else split_http(block)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and (digest != sha1_base32(payload) or len(payload) != int(h["X-Payload-Length"])):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its header")
                    to = h.get("X-Refers-To-Page")
                    rows.append((_page_id(http), int(h["X-Payload-Length"]), digest, kind, None if to is None else int(to),
                                 h["WARC-Record-ID"].strip("<>"), h["WARC-Target-URI"]))
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"])
    return run


def read_warcs(folder: str, manifest: DataFrame) -> DataFrame:
    """A row for each record of the WARC files but warcinfo; digests and lengths are checked."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "file").mapInArrow(
        _records(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string")


def pages_to_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = 0) -> DataFrame:
    """Pages -> ARC archives -> WARC archives -> a row for each page, read from the latter.

    Null html is an empty payload, a null URL is '-'; a page without id is
    read back without one and ranks last among equal payloads.  Repeated rows
    each get a record, all but one of them revisits.  No page gives no file.
    Texts may have any length; archives end behind the record that takes them over
    FILE_BYTES.  Other columns are ignored, whatever their names; ids are cast to long."""
    spark = prepare(pages.sparkSession)
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    manifest = write_arcs(pages, arcs, id_col, url_col, html_col)
    return read_warcs(warcs, convert(arcs, manifest, warcs, least_bytes))
