import gzip
import hashlib

import pytest

from patchmetrics.llm import arc_convert as arc
from patchmetrics.llm.common import Scratch

from .data import SF, small


def brute(pages):
    payload = {p: (h or "").encode() for p, _, h in pages}
    best = {}
    for p, b in payload.items():
        if len(b) >= 1000:
            best[b] = max(best.get(b, p), p)
    return {p: (len(b), hashlib.sha1(b).hexdigest(), "revisit" if best.get(b, p) != p else "response",
                best[b] if best.get(b, p) != p else None) for p, b in payload.items()}


def convert(spark, pages):
    s = Scratch(spark, "test-arc")
    arcs = arc.write_arc(spark.createDataFrame(pages, "page_id long, url string, html string"), s)
    revisits = arc.choose_responses(arc.index_arc(arcs, s), s)
    warcs = arc.convert(arcs, revisits, s)
    return {r["page_id"]: tuple(r)[1:] for r in arc.read_warc(warcs, s).collect()}, arcs, warcs


def test_query_is_the_brute_force_result(spark):
    pages = small("pages")
    got = {r["page_id"]: tuple(r)[1:] for r in arc.op6_arc_to_warc(spark, SF).collect()}
    assert got == brute(list(zip(pages["page_id"], pages["url"], pages["html"])))


def test_equal_payloads_are_revisits(spark, monkeypatch):
    monkeypatch.setattr(arc, "ARCHIVE_BYTES", 4000)
    big, edge, small_ = "é" * 700, "x" * 1000, "y" * 999
    pages = [(i, f"http://a.example/{i} b\tc", big) for i in range(60)] + [(100 + i, None, edge) for i in range(3)]
    pages += [(200 + i, "http://s.example/", small_) for i in range(4)] + [(300, "", None), (301, "u", ""), (302, "u", "\r\n\r\n" * 400)]
    got, arcs, warcs = convert(spark, pages)
    assert got == brute(pages)
    files = arcs.collect()
    assert {r["version"] for r in files} == {1, 2} and sum(r["records"] for r in files) == len(pages)
    first = gzip.decompress(arc.read_file(files[0]["path"]))
    assert first.startswith(b"filedesc://") and arc.ARC_FIELDS[files[0]["version"]].encode() in first
    types = [h["warc-type"] for r in warcs.collect() for h, _ in arc.parse_warc(gzip.decompress(arc.read_file(r["path"])))]
    assert types.count("revisit") == 59 + 2 and types.count("warcinfo") == len(files)


def test_header_lines_of_both_versions():
    for version in (1, 2):
        data = arc.arc_head(version, "n.arc") + b"\n" + arc.arc_record(version, "n.arc", 0, "http://x/ y", b"HTTP/1.1 200 OK\r\n\r\n\n\nz")
        (header, body), = arc.parse_arc(data)
        assert header["URL"] == "http://x/ y" and body.endswith(b"\n\nz")
        with pytest.raises(ValueError):
            list(arc.parse_arc(data[:-4]))


def test_synthesised_headers():
    header = {"URL": "http://x/", "IP-address": "1.2.3.4", "Archive-date": "20010203040506"}
    body = arc.http_message(7, b"payload")
    (full, block), = arc.parse_warc(arc.convert_record(header, body, None, False))
    assert full["warc-date"] == "2001-02-03T04:05:06Z" and full["warc-type"] == "response" and block == body
    assert full["warc-record-id"] == f"<{arc.record_id(7, arc.sha1(b'payload'))}>"
    (again, rest), = arc.parse_warc(arc.convert_record(header, body, 9, True))
    assert again["warc-refers-to"] == f"<{arc.record_id(9, arc.sha1(b'payload'))}>"
    assert again["warc-payload-digest"] == full["warc-payload-digest"] and rest.endswith(b"\r\n\r\n")


def test_odd_rows_and_empty_table(spark):
    same = "z" * 2000
    pages = [(None, None, None), (1, None, same), (1, "u", same), (2, "u v", same), (None, "w", same)]
    s = Scratch(spark, "test-arc")
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, path string, record int")
    arcs = arc.write_arc(df, s)
    rows = arc.read_warc(arc.convert(arcs, arc.choose_responses(arc.index_arc(arcs, s), s), s), s).collect()
    assert len(rows) == 5 and [r["record_type"] for r in rows].count("revisit") == 3
    assert {r["refers_to"] for r in rows} == {None, 2}
    none = arc.write_arc(df.limit(0), s)
    assert arc.read_warc(arc.convert(none, arc.choose_responses(arc.index_arc(none, s), s), s), s).count() == 0


@pytest.mark.parametrize("step", [1, 7, 1 << 14])
def test_members_are_read_in_steps(step):
    """What follows a member is never copied whole for it, whatever the sizes of members and steps."""
    members = [gzip.compress(x, 1, mtime=0) for x in (b"", b"a" * 50, bytes(range(256)) * 40, b"", b"end")]
    assert arc.gunzip(b"".join(members), step) == gzip.decompress(b"".join(members))
    assert arc.gunzip(b"", step) == b""
    with pytest.raises(EOFError):
        arc.gunzip(b"".join(members)[:-9], step)
