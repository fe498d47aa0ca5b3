"""WARC archives of web pages: writing, and reading with segment reassembly and chunked transfer decoding.

The writer makes a record per page, payloads in chunked transfer framing inside an HTTP response. A block longer than SEGMENT bytes is split: the
first record carries segment number 1, continuation records name it in WARC-Segment-Origin-ID, and the last one tells
WARC-Segment-Total-Length. Of records with equal payloads, the one with the largest id is a response; the others are revisits
without a payload. The reader groups continuation records by origin identifier, orders them by segment number, verifies that none is
missing and that they make up the total length, and decodes the chunks. Archives are rows of about ARCHIVE bytes, each a whole .warc.gz stream of one member per record.

Defined results: a null payload is empty; a null url is an empty target; rows with an equal id are records of their own; a null id is a response that no
revisit refers to unless it is alone; payloads of any length are whole; of equal payloads under one id any row may be the response; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import store
from quillgrid.llm.store import table

SEGMENT, CHUNK, ARCHIVE = 32 << 10, 8 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "<urn:x-page:"
ARCHIVES = "archive long, warc binary"
RECORD = {"record_id": pa.string(), "type": pa.string(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "origin": pa.string(), "segment": pa.int64(), "total": pa.int64(), "body": pa.binary()}
RECORDS = "record_id string, type string, page_id long, refers_to long, payload_bytes long, payload_digest string, origin string, segment long, total long, body binary"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def to_chunks(payload: bytes) -> bytes:
    out = []
    for a in range(0, len(payload), CHUNK):
        part = payload[a : a + CHUNK]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def from_chunks(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return from_chunks(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def records_of(name: str, page_id, url: str, payload: bytes, refers_to) -> list[bytes]:
    """All records of a page: one, or as many as its block has segments."""
    common = [("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split()))]
    about = [("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"{PAGE}{refers_to}>"), *about], head)]
    block = head + to_chunks(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, *about]
    if len(block) <= SEGMENT:
        return [record(first, block)]
    cuts = range(0, len(block), SEGMENT)
    out = [record([*first, ("WARC-Segment-Number", "1")], block[:SEGMENT])]
    for number, a in enumerate(cuts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}/{number}>"), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number))]
        if number == len(cuts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(more, block[a : a + SEGMENT]))
    return out


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_revisit: int = 0) -> DataFrame:
    """Archives of all pages, saved in the shared folder. Payloads of at least least_revisit bytes are stored once."""
    work = store.Work(pages.sparkSession, "warc")
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    narrow = rows.where(F.octet_length("payload") >= least_revisit).select("page_id", "digest")
    keepers = work.save(narrow.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = rows.join(keepers, "digest", "left")
    rows = rows.select("page_id", "url", "payload", F.when((F.col("page_id") < F.col("keeper")) & (F.octet_length("payload") >= least_revisit), F.col("keeper")).alias("refers_to"))

    def run(batches):
        task, seq, count, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            for page, target, html, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                page = page.as_py()
                made = records_of(f"{PAGE}{'' if page is None else page}#{task}.{count}>", page, target.as_py(), html.as_buffer().to_pybytes(), refers.as_py())
                count += 1
                held += made
                size += sum(map(len, made))
                if size >= ARCHIVE:
                    yield table({"archive": pa.int64(), "warc": pa.binary()}, [[(task << 24) + seq], [b"".join(held)]])
                    seq, held, size = seq + 1, [], 0
        if held:
            yield table({"archive": pa.int64(), "warc": pa.binary()}, [[(task << 24) + seq], [b"".join(held)]])

    return work.save(rows.mapInArrow(run, ARCHIVES), compression="none")


def members(data: bytes):
    """The uncompressed gzip members of a stream, one after another."""
    view = memoryview(data)
    while len(view):
        z = zlib.decompressobj(31)
        yield z.decompress(view) + z.flush()
        if not z.eof:
            raise ValueError("a gzip member is cut off")
        view = view[len(view) - len(z.unused_data) :]


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    return fields, rest[:size]


def page_of(uri: str) -> int | None:
    number = uri.removeprefix(PAGE).rstrip(">").split("#")[0]
    return int(number) if number else None


def row_of(fields: dict[str, str], block: bytes, whole: bool, keep: bool) -> tuple:
    """A row of RECORDS; the block of a segmented record stays as it is until all are together."""
    kind = fields["warc-type"]
    number = lambda name: int(fields[name]) if name in fields else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    length, body = number("x-payload-length"), block
    if whole and kind == "response":
        body = payload_of(block)
        if digest and sha1(body) != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
        digest, length = digest or sha1(body), len(body)
    if whole and not (keep and kind == "response"):
        body = None
    refers = page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    name = fields["warc-record-id"]
    return name, kind, None if kind == "continuation" else page_of(name), refers, length, digest, fields.get("warc-segment-origin-id", name), number("warc-segment-number"), number("warc-segment-total-length"), body


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """A row per response or revisit record: record_id, type, page_id, refers_to, payload_bytes, payload_digest and, if asked for, body (the decoded payload)."""

    def scan(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for m in members(data.as_buffer().to_pybytes()):
                    fields, block = parse(m)
                    rows.append(row_of(fields, block, "warc-segment-number" not in fields, keep_payload))
                    size += len(block)
                    if size > 4 << 20:
                        yield table(RECORD, list(zip(*rows, strict=True)))
                        rows, size = [], 0
                if rows:
                    yield table(RECORD, list(zip(*rows, strict=True)))

    def join(batches):
        for batch in batches:
            rows = []
            for parts in batch.column(0).to_pylist():
                if [p["segment"] for p in parts] != [*range(1, len(parts) + 1)] or parts[-1]["total"] is None:
                    raise ValueError(f"segments of {parts[0]['origin']} are missing")
                block = b"".join(p["body"] for p in parts)
                if len(block) != parts[-1]["total"]:
                    raise ValueError(f"segments of {parts[0]['origin']} do not make up their total length")
                first = parts[0]
                fields = {"warc-type": first["type"], "warc-record-id": first["record_id"], "warc-payload-digest": first["payload_digest"] or ""}
                rows.append(row_of(fields, block, True, keep_payload))
            if rows:
                yield table(RECORD, list(zip(*rows, strict=True)))

    found = archives.select("warc").mapInArrow(scan, RECORDS)
    whole = found.where("segment IS NULL")
    parts = found.where("segment IS NOT NULL").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "total", "origin", "record_id", "type", "payload_digest", "body"))).alias("parts"))
    out = whole.union(parts.select("parts").mapInArrow(join, RECORDS))
    return out.select("record_id", "type", "page_id", "refers_to", "payload_bytes", "payload_digest", *(["body"] if keep_payload else []))
