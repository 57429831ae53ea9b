"""Legacy archive converter: ARC files (header versions 1 and 2) to WARC, with duplicate payloads as revisits.

ARC: the first record of a file names its version and its header fields; every other record is one header line and as
many body bytes as the line declares. Bodies are HTTP responses; payloads follow the HTTP header. Archives are gzip
files of one member per record, under the shared folder, of at most ``ARCHIVE_BYTES`` of records (one larger record
has a file of its own), so a task holds one archive.

1. ``write_arc`` turns rows into archives (the legacy input); 2. ``index_arc`` parses them into narrow rows with the
payload digest; 3. ``choose_responses`` finds, per digest, the record that stays a response; 4. ``convert`` reads each
archive again and writes its WARC twin with synthesised ids, timestamps, types and digests; 5. ``read_warc`` parses
those, verifies digests and lengths, and resolves ``WARC-Refers-To``.

Only files named by a written manifest are read, so a task that is tried again leaves no doubt about its files.
Payload bytes are never shuffled. Digest groups are pre-aggregated; joins on a digest or a record id have written
tables on both sides, so skewed ones are split.

Defined cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``; blanks and controls of a url are
percent-encoded; a null page id is carried as ``-``; rows repeating the largest page id of a group are all responses;
very long payloads are one record each, read and written whole; an empty table gives an empty result and no archive;
further columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, shuffle_partitions, table

ARCHIVE_BYTES = 8 << 20
ARCHIVE_RECORDS = 5_000
REVISIT_BYTES = 1000     # smaller payloads are always stored
LEVEL = 1
# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_ID = uuid.UUID("8c1f2d6e-5b3a-5c70-9a44-0f6d2b1e7a01")

ARCHIVE = "path string, version int, records long, bytes long"
INDEX = "path string, record long, page_id long, url string, date string, payload_bytes long, digest string"
WARC_ROW = "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to_id string"


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    system, at = _open(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at, compression=None) as f:
        f.write(data)


def read_file(path: str) -> bytes:
    system, at = _open(path)
    with system.open_input_stream(at, compression=None) as f:
        return f.read()


def gunzip(data: bytes, step: int = 1 << 14) -> bytes:
    """All members of ``data``; what follows a member is looked at in steps, never copied whole once per member."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise EOFError("the last gzip member is cut short")
            piece = view[at:at + step]
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
    return b"".join(out)


def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def http_message(page_id: int | None, payload: bytes) -> bytes:
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
            f"X-Page-Id: {'-' if page_id is None else page_id}\r\n\r\n").encode() + payload


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """HTTP header bytes (with the blank line), its fields, and the payload."""
    end = block.index(b"\r\n\r\n") + 4
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return block[:end], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, block[end:]


def page_of(fields: dict[str, str]) -> int | None:
    at = fields.get("x-page-id", "-")
    return None if at == "-" else int(at)


# ---------------------------------------------------------------- ARC

def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain",
              "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name,
              "Archive-length": str(len(body))}
    return " ".join(values[f] for f in ARC_FIELDS[version].split()).encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, block: bytes) -> bytes:
    values = {"URL": url, "IP-address": "127.0.0.1", "Archive-date": DATE, "Content-type": "text/html",
              "Result-code": "200", "Checksum": f"{zlib.crc32(block):08x}", "Location": "-", "Offset": str(offset),
              "Filename": name, "Archive-length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version].split()).encode("utf-8", "surrogatepass") + b"\n" + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record after the file description."""
    end = data.index(b"\n")
    head_length = int(data[:end].rsplit(b" ", 1)[1])
    lines = data[end + 1:end + 1 + head_length].decode().split("\n")
    version = int(lines[0].split(" ")[0])
    fields = lines[1].split(" ")
    if fields != ARC_FIELDS[version].split():
        raise ValueError(f"ARC version {version} with fields {fields}")
    at = end + 1 + head_length + 1
    while at < len(data):
        if data[at:at + 1] == b"\n":  # blank lines between records
            at += 1
            continue
        end = data.index(b"\n", at)
        # All fields but the url are free of blanks; a url with blanks (seen in old archives) keeps them.
        values = data[at:end].decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"ARC header line of {len(values)} fields at byte {at}")
        header = dict(zip(fields, values))
        n = int(header["Archive-length"])
        body = data[end + 1:end + 1 + n]
        if len(body) != n:
            raise ValueError(f"ARC record at byte {at} declares {n} bytes, {len(body)} are there")
        yield header, body
        at = end + 1 + n


def _write_arc(folder: str):
    schema = pa.schema([("path", pa.string()), ("version", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        members, size = [], 0

        def flush():
            path = f"{folder}/{name}"
            data = b"".join(members)
            write_file(path, data)
            return pa.record_batch([[path], pa.array([version], pa.int32()), [len(members) - 1], [len(data)]], schema=schema)

        for b in blocks(batches, 64):
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if not members:
                    version = 1 + (part + done) % 2
                    name = f"{uuid.uuid4().hex}.arc.gz"
                    members, size = [gzip.compress(arc_head(version, name), LEVEL, mtime=0)], 0
                block = http_message(page, (html or "").encode("utf-8", "surrogatepass"))
                target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'-' if page is None else page}"
                record = arc_record(version, name, size, target, block)
                members.append(gzip.compress(record, LEVEL, mtime=0))
                size += len(record)
                if size >= ARCHIVE_BYTES or len(members) > ARCHIVE_RECORDS:
                    yield flush()
                    members, done = [], done + 1
        if members:
            yield flush()

    return run


def _index_arc(batches):
    for b in batches:
        for path in b.column("path").to_pylist():
            rows = []
            for i, (header, body) in enumerate(parse_arc(gunzip(read_file(path)))):
                _, fields, payload = http_parts(body)
                rows.append((path, i, page_of(fields), header["URL"], header["Archive-date"], len(payload), sha1(payload)))
            yield _batch(rows, INDEX)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in ddl.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


# ---------------------------------------------------------------- WARC

def iso_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page_id: int | None, digest: str) -> str:
    """The same page and payload always get the same identifier."""
    return f"urn:uuid:{uuid.uuid5(_ID, f'{page_id}:{digest}')}"


def warc_digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        n = int(headers["content-length"])
        yield headers, data[end:end + n]
        at = end + n + 4


def convert_record(header: dict[str, str], body: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The WARC record of one ARC record."""
    http, fields, payload = http_parts(body)
    digest, page = sha1(payload), page_of(fields)
    block = http if revisit else body
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{record_id(page, digest)}>",
               "WARC-Date": iso_date(header["Archive-date"]), "WARC-Target-URI": header["URL"],
               "WARC-IP-Address": header["IP-address"], "WARC-Payload-Digest": warc_digest(digest),
               "WARC-Block-Digest": warc_digest(sha1(block))}
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id(refers_to, digest)}>"}
    return warc_record(headers | {"Content-Type": "application/http; msgtype=response"}, block)


def _convert(folder: str):
    def run(batches):
        for b in batches:
            for path, version, found in zip(*(b.column(c).to_pylist() for c in ("path", "version", "revisits"))):
                refers = {r["record"]: r["refers_to"] for r in found or ()}
                name = path.rsplit("/", 1)[1].replace(".arc.gz", f"-{uuid.uuid4().hex[:8]}.warc.gz")
                info = warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_ID, name)}>",
                                    "WARC-Date": iso_date(DATE), "WARC-Filename": name,
                                    "Content-Type": "application/warc-fields"},
                                   f"format: WARC File Format 1.1\r\nconverted-from: ARC version {version}\r\n".encode())
                members = [gzip.compress(info, LEVEL, mtime=0)]
                for i, (header, body) in enumerate(parse_arc(gunzip(read_file(path)))):
                    members.append(gzip.compress(convert_record(header, body, refers.get(i), i in refers), LEVEL, mtime=0))
                data = b"".join(members)
                write_file(f"{folder}/{name}", data)
                yield _batch([(f"{folder}/{name}", version, len(members) - 1, len(data))], ARCHIVE)

    return run


def _read_warc(batches):
    for b in batches:
        for path in b.column("path").to_pylist():
            rows = []
            for h, block in parse_warc(gunzip(read_file(path))):
                if h["warc-type"] == "warcinfo":
                    continue
                _, fields, payload = http_parts(block)
                digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
                n = int(fields["content-length"])
                if h["warc-type"] == "response" and (sha1(payload) != digest or len(payload) != n):
                    raise ValueError(f"{path}: {h['warc-record-id']} does not match its digest or length")
                rows.append((h["warc-record-id"].strip("<>"), page_of(fields), h["warc-type"], n, digest,
                             h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None))
            yield _batch(rows, WARC_ROW)


# ---------------------------------------------------------------- Spark steps

def write_arc(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Manifest of legacy archives with the rows of ``pages(page_id, url, html)``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return scratch.save(rows.mapInArrow(_write_arc(f"{scratch.path}/arc"), ARCHIVE), "arc-manifest")


def _one_by_one(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, shuffle_partitions(manifest.sparkSession)), "path")


def index_arc(manifest: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.save(_one_by_one(manifest.select("path")).mapInArrow(_index_arc, INDEX), "arc-index")


def choose_responses(index: DataFrame, scratch: Scratch) -> DataFrame:
    """``path, record, refers_to`` of the records that revisit the largest page id with their payload."""
    large = index.where(F.col("payload_bytes") >= REVISIT_BYTES)
    groups = scratch.save(large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to"))
                          .where("n > 1").drop("n"), "groups", narrow=True)
    return (large.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select("path", "record", "refers_to"))


def convert(manifest: DataFrame, revisits: DataFrame, scratch: Scratch) -> DataFrame:
    """Manifest of the WARC twins. The revisits of one archive are at most its records."""
    per_file = revisits.groupBy("path").agg(F.collect_list(F.struct("record", "refers_to")).alias("revisits"))
    work = manifest.select("path", "version").join(scratch.save(per_file, "revisits", narrow=True), "path", "left")
    return scratch.save(_one_by_one(work).mapInArrow(_convert(f"{scratch.path}/warc"), ARCHIVE), "warc-manifest")


def read_warc(manifest: DataFrame, scratch: Scratch) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record in the archives."""
    rows = scratch.save(_one_by_one(manifest.select("path")).mapInArrow(_read_warc, WARC_ROW), "warc-rows")
    first = rows.where("record_type = 'response'")
    ids = scratch.save(first.groupBy("record_id").agg(F.max("page_id").alias("refers_to")), "ids", narrow=True)
    again = (rows.where("record_type = 'revisit'")
             .join(ids.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.withColumn("refers_to", F.lit(None).cast("long")).select(cols).unionByName(again.select(cols))


def op6_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "arc")
    arcs = write_arc(table(spark, sf_dir, "pages"), scratch)
    revisits = choose_responses(index_arc(arcs, scratch), scratch)
    return read_warc(convert(arcs, revisits, scratch), scratch)
