"""Archives as old crawlers wrote them: lines by hand, not from the library's own writer."""

import gzip

import pytest
from pyspark.sql import functions as F

from reviewloom.llm.arc_to_warc import convert, found_arcs, read_arc, read_warc, read_warcs, sha1_base32, split_http, warc_date, warc_record
from reviewloom.llm.common import prepare, stored
from reviewloom.llm.files import open_folder, read_file

V1 = b"URL IP-address Archive-date Content-type Archive-length"
V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
DNS = b"19960923142103\nwww.a.org.\t3600\tIN\tA\t10.1.2.3\n"
PAGE = b"HTTP/1.0 200 OK\nServer: old\n\n<html>caf\xe9\r\n\r\nend</html>"
GONE = b"HTTP/1.1 404 Not Found\r\nServer: x\r\n"


def record(line: bytes, body: bytes) -> bytes:
    return line + b" %d\n" % len(body) + body + b"\n"


def first(version: bytes, names: bytes, tail: bytes = b"") -> bytes:
    block = version + b" 0 Some Archive\n" + names + b"\n"
    return record(b"filedesc://IA-001102.arc 0.0.0.0 19960923142103 text/plain" + tail, block)


def parts(version: int) -> list[bytes]:
    if version == 1:
        return [first(b"1", V1),
                record(b"dns:www.a.org 10.9.9.9 19960923142103 text/dns", DNS),
                record(b"http://www.a.org/a file with spaces.html 10.1.2.3 199609231421 text/html", PAGE),
                record(b"http://www.a.org/caf\xe9 10.1.2.3 19960923142105 text/html; charset=latin1", PAGE),
                record(b"ftp://a.org/x.bin 0.0.0.0 19969923142105 application/octet-stream", bytes(range(256))),
                record(b"http://www.a.org/gone 10.1.2.3 19960923142107 ", GONE),
                record(b"gopher://a.org/0 10.1.2.3 19960923142108 text/plain", b"")]
    tail = b" 200 - - %d IA-001102.arc"
    return [first(b"2", V2, tail % 0),
            record(b"dns:www.a.org 10.9.9.9 19960923142103 text/dns" + tail % 9, DNS),
            record(b"http://www.a.org/a file with spaces.html 10.1.2.3 199609231421 text/html" + tail % 99, PAGE),
            record(b"http://www.a.org/caf\xe9 10.1.2.3 19960923142105 text/html; charset=latin1" + tail % 20010101000000, PAGE),
            record(b"ftp://a.org/x.bin 0.0.0.0 19969923142105 application/octet-stream" + tail % 1, bytes(range(256))),
            record(b"http://www.a.org/gone 10.1.2.3 19960923142107 " + tail % 2, GONE),
            record(b"gopher://a.org/0 10.1.2.3 19960923142108 text/plain" + tail % 3, b"")]


BODIES = [DNS, PAGE, PAGE, bytes(range(256)), GONE, b""]
KINDS = ["resource", "response", "response", "resource", "response", "resource"]
URLS = ["dns:www.a.org", "http://www.a.org/a%20file%20with%20spaces.html", "http://www.a.org/caf%E9", "ftp://a.org/x.bin", "http://www.a.org/gone", "gopher://a.org/0"]
DATES = ["1996-09-23T14:21:03Z", "1996-09-23T14:21Z", "1996-09-23T14:21:05Z", "1996", "1996-09-23T14:21:07Z", "1996-09-23T14:21:08Z"]


def packings(version: int) -> dict[str, bytes]:
    rows = parts(version)
    return {"plain": b"".join(rows), "members": b"".join(gzip.compress(x) for x in rows), "whole": gzip.compress(b"".join(rows))}


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packing", ["plain", "members", "whole"])
def test_legacy_records(version, packing):
    records = list(read_arc(packings(version)[packing], info=True))
    assert [r.kind for r in records] == ["warcinfo", *KINDS] and [r.content for r in records[1:]] == BODIES
    assert len({r.offset for r in records}) == len(records)
    assert records[2].fields["URL"].endswith("/a file with spaces.html") and records[3].fields["Content-type"] == "text/html; charset=latin1"
    assert ("Filename" in records[3].fields) == (version == 2)
    warc = [next(read_warc(gzip.compress(warc_record(r, "IA-001102", None)))) for r in records]
    (info, block), *rest = warc
    assert info["WARC-Type"] == "warcinfo" and info["Content-Type"] == "application/warc-fields" and b"isPartOf: IA-001102.arc\r\n" in block
    assert [h["WARC-Type"] for h, _ in rest] == KINDS and [b for _, b in rest] == BODIES
    assert [h["WARC-Target-URI"] for h, _ in rest] == URLS and [h["WARC-Date"] for h, _ in rest] == DATES
    assert [h["Content-Type"] for h, _ in rest] == ["text/dns", *["application/http; msgtype=response"] * 2, "application/octet-stream",
                                                    "application/http; msgtype=response", "text/plain"]
    assert ["WARC-IP-Address" in h for h, _ in rest] == [True, True, True, False, True, True]
    payloads = [DNS, PAGE.partition(b"\n\n")[2], PAGE.partition(b"\n\n")[2], bytes(range(256)), b"", b""]
    assert [h["WARC-Payload-Digest"] for h, _ in rest] == [f"sha1:{sha1_base32(x)}" for x in payloads]


def test_broken_archives():
    good = parts(1)
    for bad in [good[1], good[0] + b"http://x 1.2.3.4 text/html 3\nabc\n", good[0] + b"no length here\n", good[0] + good[2][:-9], good[0] + b"http://x 5"]:
        with pytest.raises(ValueError):
            list(read_arc(bad))
    assert list(read_arc(b"")) == [] and list(read_arc(good[0])) == []
    assert split_http(b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\n\nx") == (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"\n\nx")


def test_dates():
    assert warc_date("20240229235959") == "2024-02-29T23:59:59Z" and warc_date("20230229") == "2023-02"
    assert warc_date("00000000000000", "1997") == "1997" and warc_date("2024022923595977") == "2024-02-29T23:59:59Z"
    with pytest.raises(ValueError):
        warc_date("-", "")


def test_folder_of_archives(spark, tmp_path):
    """Two archives in different packings: equal responses become revisits of one, resources and warcinfo stay."""
    prepare(spark)
    folder, out = tmp_path / "arcs", str(tmp_path / "warcs")
    folder.mkdir()
    (folder / "IA-001102.arc").write_bytes(packings(1)["plain"])
    (folder / "IA-001103.arc.gz").write_bytes(packings(2)["whole"])
    (folder / "notes.txt").write_bytes(b"no archive")
    manifest = convert(str(folder), stored(found_arcs(spark, str(folder)), "found"), out)
    got = read_warcs(out, manifest)
    counts = {(r.record_type, r.payload_digest): r["count"] for r in got.groupBy("record_type", "payload_digest").count().collect()}
    page = sha1_base32(PAGE.partition(b"\n\n")[2])
    assert counts == {("resource", sha1_base32(DNS)): 2, ("resource", sha1_base32(bytes(range(256)))): 2, ("resource", sha1_base32(b"")): 2,
                      ("response", page): 1, ("revisit", page): 3, ("response", sha1_base32(b"")): 1, ("revisit", sha1_base32(b"")): 1}
    assert got.select("record_id").distinct().count() == 12 and got.filter(F.col("page_id").isNotNull()).count() == 0
    names = [r.file for r in manifest.collect()]
    assert sorted(n.rsplit("-", 1)[0] for n in names) == ["IA-001102", "IA-001103"] and open_folder(out)[1] == out
    for n in names:
        kinds = [h["WARC-Type"] for h, _ in read_warc(read_file(out, n))]
        assert kinds[0] == "warcinfo" and len(kinds) == 7
