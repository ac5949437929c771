"""WARC archives: a writer with revisits, and a sequential reader.

Records are gzip members of their own. The reader takes a file chunk by chunk, starts a new zlib object after
each member, frames each record by its content length, and verifies block and payload digests as the bytes pass.
Files are reached through Arrow's file systems by URI, so archives may lie in any store that has one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.plans.session import cut

# Format lines.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "1970-01-01T00:00:00Z"
_CHUNK = 1 << 18

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = """path string, offset long, record_type string, record_id string, target_uri string, page_id long,
    refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"""


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def page_of(record: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def _line_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit of ``refers_to`` without."""
    http = HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line_safe(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[2:2] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head = CRLF.join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + CRLF * 2 + block + CRLF * 2) + packer.flush()


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, min_payload: int) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least ``min_payload`` bytes all but the largest id refer to it.

    Payloads are compared by SHA-256 and length; the SHA-1 that records show does not decide. Rows sharing the largest id are all responses; a row without id is a revisit if
    a row with an id has its payload.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("size", F.octet_length("payload"))
    key = F.concat(F.sha2("payload", 256), F.lit("-"), F.col("size").cast("string"))
    large = rows.where(F.col("size") >= min_payload).withColumn("key", key)
    groups = large.groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    # A table of its own, so that the join may split a payload that very many pages share.
    repeated = cut(groups.where("n > 1").select("key", "last"))
    found = large.join(repeated, "key", "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"),
    )
    small = rows.where(F.col("size") < min_payload)
    return found.unionByName(small.select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")))


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_payload: int = 0, max_file_bytes: int = 64 << 20,
) -> DataFrame:
    """Writes one record per row to files below ``folder`` (a URI all executors reach) and returns their manifest.

    Null html is an empty payload, a null url an empty one. The manifest (path, n_records, n_bytes) is fixed before it is
    returned and names the files of the attempts that ended well; what a lost attempt left is in no manifest. An
    empty table gives an empty manifest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        out, done = None, []

        def close():
            out[0].close()
            done.append(out[1:])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, address, payload, refers = (x.as_py() for x in row)
                if out is None:
                    store.create_dir(top, recursive=True)
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    out = [store.open_output_stream(f"{top}/{name}", compression=None), f"{folder}/{name}", 0, 0]
                data = record(page, address, payload, refers)
                out[0].write(data)
                out[2] += 1
                out[3] += len(data)
                if out[3] >= max_file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            paths, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                ["path", "n_records", "n_bytes"],
            )

    rows = with_revisits(pages, page_id, url, html, min_payload)
    return cut(rows.mapInArrow(run, MANIFEST))


class _Member:
    """The decompressed bytes of one gzip member, taken from a stream step by step. A head of any length is held whole."""

    def __init__(self, source, held: bytes):
        self.source, self.raw, self.ready = source, held, bytearray()
        self.engine = zlib.decompressobj(31)
        self.used = 0

    def more(self) -> bool:
        """Adds decompressed bytes; false at the member's end."""
        while not self.engine.eof:
            data = self.raw or self.source.read(_CHUNK)
            self.raw = b""
            if not data:
                raise ValueError("the file ends within a record")
            got = self.engine.decompress(data, _CHUNK)
            rest = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
            self.used += len(data) - len(rest)
            self.raw = rest
            if got:
                self.ready += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.ready.find(mark, seen)) < 0:
            seen = max(len(self.ready) - len(mark) + 1, 0)
            if not self.more():
                raise ValueError("a record has no end of header")
        head = bytes(self.ready[:at])
        del self.ready[:at + len(mark)]
        return head

    def exactly(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.more():
                raise ValueError("a record is shorter than its content length")
            part = bytes(self.ready[:size])
            del self.ready[:size]
            size -= len(part)
            yield part

    def end(self) -> None:
        while self.more():
            pass
        if self.ready != CRLF * 2:
            raise ValueError("a record is longer than its content length")


def _fields(head: bytes) -> dict[str, str]:
    first, *lines = head.split(CRLF)
    if not first.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    pairs = (line.decode("utf-8").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_records(source, with_payload: bool = False) -> Iterator[dict]:
    """The records of one open archive, one after another, holding a chunk at a time (and a payload if asked for)."""
    held, offset = b"", 0
    while True:
        held = held or source.read(_CHUNK)
        if not held:
            return
        member = _Member(source, held)
        fields = _fields(member.until(CRLF * 2))
        size, block, payload = int(fields["content-length"]), hashlib.sha1(), hashlib.sha1()
        is_http = fields.get("content-type", "").startswith("application/http")
        head, n_payload, kept = bytearray() if is_http else None, 0, []
        for part in member.exactly(size):
            block.update(part)
            if head is not None:
                seen = max(len(head) - 3, 0)
                head += part
                at = head.find(CRLF * 2, seen)
                if at < 0:
                    continue
                http, part = bytes(head[:at]), bytes(head[at + 4:])
                head = None
            payload.update(part)
            n_payload += len(part)
            if with_payload:
                kept.append(part)
        member.end()
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        good = fields.get("warc-block-digest", "").removeprefix("sha1:") == base64.b32encode(block.digest()).decode()
        kind = fields["warc-type"]
        if kind == "revisit":  # of the full payload, which the record it refers to holds
            length = re.search(rb"(?im)^content-length:\s*(\d+)", http if is_http and head is None else head or b"")
            n_payload = int(length[1]) if length else None
        else:
            good = good and told == base64.b32encode(payload.digest()).decode()
        yield {
            "offset": offset, "record_type": kind, "record_id": fields.get("warc-record-id"),
            "target_uri": fields.get("warc-target-uri"), "page_id": page_of(fields.get("warc-record-id")),
            "refers_to": page_of(fields.get("warc-refers-to")), "payload_bytes": n_payload, "payload_digest": told,
            "digest_ok": good, "payload": b"".join(kept) if with_payload and kind != "revisit" else None,
        }
        offset += member.used
        held = member.raw


def read_archives(manifest: DataFrame, path: str = "path", with_payload: bool = False) -> DataFrame:
    """One row per record of the files in column ``path``; a file is read by one task from start to end.

    ``digest_ok`` tells whether block and payload digests hold. A file that is cut short or breaks its framing raises.
    """
    schema = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
        ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, inner = pafs.FileSystem.from_uri(name)
                rows, size = [], 0
                with store.open_input_stream(inner, compression=None) as source:
                    for row in read_records(source, with_payload):
                        rows.append(row | {"path": name})
                        size += 500 + len(row["payload"] or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select(path).mapInArrow(run, RECORDS)
