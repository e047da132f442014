"""WARC archives: writer with revisit records, and a sequential reader.

The writer stores one gzip member a record. The reader goes through a file in
order: it decompresses incrementally with zlib, frames each record by its
Content-Length, and verifies block and payload digests, holding one record at
a time. Files are in the shared folder; a manifest names those of successful
tasks, so a task that ran twice leaves no trace in it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, workspace
from .hot import join_groups

# Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, verified boolean"
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("verified", pa.bool_())]
)


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC digest fields have it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None, payload_digest: str) -> str:
    """A record's name: of the page and its payload, so that rows which share an id only differ."""
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{payload_digest}>"


def _page(uri: str) -> int | None:
    name = uri.split(":")[2]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, not compressed: a response, or a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    sha = digest(payload)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _uri(page_id, sha)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", url.translate({13: "%0D", 10: "%0A"})))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to, sha))]
    head = b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """A record as the reader found it."""

    fields: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP header fields and payload of the block."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        lines = head.decode("iso-8859-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload

    def verify(self) -> bool:
        """Do the block, and a response's payload, have the digests of the header?"""
        good = self.fields.get("warc-block-digest") in (None, f"sha1:{digest(self.block)}")
        if self.fields.get("warc-type") == "response" and "warc-payload-digest" in self.fields:
            good &= self.fields["warc-payload-digest"] == f"sha1:{digest(self.http[1])}"
        return good


class Framing(ValueError):
    """The bytes are not a sequence of whole WARC records."""


#: Bytes read at a time, and inflated at a time.
CHUNK = 1 << 14
#: Bytes of a header, at most; a longer one is no record.
HEADER = 1 << 20


class _Member:
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, stream, raw: bytes, chunk: int):
        self.stream, self.raw, self.chunk = stream, raw, chunk
        self.unzip, self.out = zlib.decompressobj(wbits=31), bytearray()

    def more(self) -> bool:
        """Inflates a piece more; False at the member's end."""
        if self.unzip.eof:
            return False
        self.raw = self.raw or self.stream.read(self.chunk)
        if not self.raw:
            raise Framing("the archive ends within a gzip member")
        self.out += self.unzip.decompress(self.raw, 4 * CHUNK)
        self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
        return True


def read_records(stream, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive, in order, one gzip member each.

    ``stream`` has ``read(n)``. A member is inflated piece by piece: first to
    the blank line that ends the header, then as many bytes as its
    Content-Length says. A member that is cut off, goes on after its record,
    or ends before it raises :class:`Framing`. Holds one record and one piece.
    """
    raw = b""
    while raw := raw or stream.read(chunk):
        member = _Member(stream, raw, chunk)
        while (gap := member.out.find(b"\r\n\r\n")) < 0:
            if len(member.out) > HEADER or not member.more():
                raise Framing("a record ends its header with a blank line")
        lines = bytes(member.out[:gap]).decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise Framing("a record starts with its version line")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise Framing("a record has a content-length")
        start, end = gap + 4, gap + 4 + int(length)
        while len(member.out) <= end + 4 and member.more():
            pass
        if member.out[end:] != b"\r\n\r\n":
            raise Framing("content-length does not match the record")
        raw = member.raw
        yield Record(fields, bytes(member.out[start:end]))


def revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(page, sha, refers): pages that revisit another of equal payload, the one with the smallest id.

    Works on ids and digests only. A group that holds a third of all rows is
    aggregated before its shuffle, and its rows join without one.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    seen = pages.where(F.col(id_col).isNotNull() & (F.octet_length(payload) >= min_bytes)).select(
        F.col(id_col).cast("long").alias("page"), F.sha1(payload).alias("sha")
    )
    seen = workspace.written(seen, "payload-digests")
    first = seen.groupBy("sha").agg(F.min("page").alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_groups(seen, first, ["sha"], "n").where("page <> refers").select("page", "sha", "refers").distinct()


def write_warc(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    level: int = 6,
    file_bytes: int = 1 << 30,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Writes a record for every row of ``pages``; returns the manifest.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest id is a response and the others revisit it; smaller payloads
    are all responses. A null payload is empty. A row without an id is a
    response; rows that repeat an id and its payload are alike. A file is
    closed at ``file_bytes``. ``date`` is a parameter so that runs agree. An
    empty table has an empty manifest.
    """
    workspace.make_folder(folder)
    workspace.bound_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    )
    again = workspace.written(revisits(pages, min_bytes, id_col, payload_col), "revisits")
    # only rows that may be revisits shuffle with their payloads
    maybe, sure = bloom.split(rows, F.xxhash64("page_id"), again.select(F.xxhash64("page").alias("k")), again.count())
    found = maybe.join(again, (F.col("page_id") == F.col("page")) & (F.sha1("payload") == F.col("sha")), "left").select("page_id", "url", "payload", "refers")
    marked = sure.select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers")).unionByName(found)

    def run(batches):
        done: list[tuple[str, int, int]] = []
        out, path, n, size = None, "", 0, 0
        try:
            for b in batches:
                for page, url, payload, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None:
                        path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = workspace.open_out(path)
                    pack = zlib.compressobj(level, wbits=31)
                    member = pack.compress(record(page, url, payload.encode("utf-8", "surrogatepass"), refers, date)) + pack.flush()
                    out.write(member)
                    n, size = n + 1, size + len(member)
                    if size >= file_bytes:
                        out.close()
                        out = None
                        done.append((path, n, size))
        finally:
            if out is not None:
                out.close()
                done.append((path, n, size))
        yield pa.RecordBatch.from_pydict(
            {"path": [d[0] for d in done], "n_records": [d[1] for d in done], "n_bytes": [d[2] for d in done]},
            schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]),
        )

    return workspace.written(marked.mapInArrow(run, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the manifest's files: ``page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload, verified``.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, a
    revisit's included; ``payload`` is null unless asked for, and for revisits.
    A file is read by one task; a broken file raises :class:`Framing`.
    """

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                with workspace.open_in(path) as stream:
                    held, size = [], 0
                    for r in read_records(stream):
                        held.append(_row(r, payloads))
                        size += len(r.block) if payloads else 0
                        if len(held) >= 2000 or size >= 1 << 25:
                            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, RECORDS)


def _row(r: Record, payloads: bool) -> dict:
    http, payload = r.http
    kind = r.fields["warc-type"]
    refers = r.fields.get("warc-refers-to")
    return {
        "page_id": _page(r.fields["warc-record-id"]),
        "url": r.fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(refers) if refers else None,
        "payload_bytes": len(payload) if kind == "response" else int(http["content-length"]),
        "payload_digest": r.fields["warc-payload-digest"].partition(":")[2],
        "payload": payload if payloads and kind == "response" else None,
        "verified": r.verify(),
    }
