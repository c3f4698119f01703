"""WARC archives: one gzip member per record, written by tasks and read back as a stream.

Writing: the payload's SHA-1 (and length) groups equal payloads; in a group the smallest page id
is written as ``response``, the others as ``revisit`` records that point at it and carry no payload.
The group minimum is pre-aggregated in each task and joined back, so one payload that a third of
the pages share costs one row per task in the aggregate and a join that adaptive execution splits.

Reading is sequential and incremental: compressed bytes come in chunks, one ``zlib`` object per
gzip member, the header block ends at the first empty line, ``Content-Length`` frames the block, and
block and payload digests are recomputed and compared.  A wrong digest, a missing length or a cut-off
member raises ``ValueError``.

Files go to the shared folder under names that hold the task attempt; only names reported by finished
tasks are read, so a lost executor leaves at most an orphan file.

Defined results: NULL html is an empty payload; NULL url has no target header; line breaks in a url are
percent-encoded; NULL page ids are revisits of a page with an id, or responses when the whole group has
none; rows repeating both the smallest page id and its payload are all responses; an empty table gives
no archives and no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidex.llm.common import file_system, one_row_each, record_batches, shared_folder, slices, text_bytes
from incidex.session import cut_lineage

CHUNK = 1 << 16
_PLAIN = "1970-01-01T00:00:00Z"  # pages carry no fetch time


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(page: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page}/{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record_bytes(page: int | None, url: str | None, payload: bytes | None, length: int, digest: str, first: int | None) -> bytes:
    """One uncompressed record; a revisit when ``payload`` is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page, digest)}",
        f"WARC-Date: {_PLAIN}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).digest())}",
    ]
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {clean}")
    if page is not None:
        head.append(f"Page-Id: {page}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_urn(first, digest)}")
        if first is not None:
            head.append(f"Refers-To-Page-Id: {first}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of decompressed chunks."""
    rest = b""

    def member() -> Iterator[bytes]:
        nonlocal rest
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            chunk = inflate.unconsumed_tail or rest or stream.read(CHUNK)
            rest = b""
            if not chunk:
                raise ValueError("archive ends inside a gzip member")
            out = inflate.decompress(chunk, CHUNK)
            if out:
                yield out
        rest = inflate.unused_data

    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        yield member()


def _framed(chunks: Iterator[bytes]) -> tuple[dict[str, str], Iterator[bytes]]:
    """Header fields and the Content-Length-framed block of one record."""
    held = b""
    for chunk in chunks:
        held += chunk
        if b"\r\n\r\n" in held:
            break
    head, found, held = held.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("record without Content-Length")
    left = int(fields["content-length"])

    def block() -> Iterator[bytes]:
        nonlocal left, held
        while True:
            part, tail = held[:left], held[left:]
            left -= len(part)
            if part:
                yield part
            if left == 0:
                break
            held = next(chunks, b"")
            if not held:
                raise ValueError("record shorter than its Content-Length")
        for more in chunks:
            tail += more
        if tail != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")

    return fields, block()


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """``(fields, payload length named by the HTTP head, payload)`` of each record, digests verified."""
    for chunks in _members(stream):
        fields, block = _framed(chunks)
        whole, body, http, payload = hashlib.sha1(), hashlib.sha1(), b"", []
        inside = False
        for part in block:
            whole.update(part)
            if not inside:
                http += part
                head, found, part = http.partition(b"\r\n\r\n")
                if not found:
                    continue
                inside, http = True, head
            body.update(part)
            payload.append(part)
        if fields.get("warc-block-digest", "sha1:" + _b32(whole.digest())) != "sha1:" + _b32(whole.digest()):
            raise ValueError(f"block digest differs in {fields.get('warc-record-id')}")
        if fields.get("warc-type") == "response" and fields.get("warc-payload-digest") != "sha1:" + _b32(body.digest()):
            raise ValueError(f"payload digest differs in {fields.get('warc-record-id')}")
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield fields, length, b"".join(payload)


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes ``(page_id, url, html)`` rows and returns the list of archives ``(path, n_records, n_bytes)``."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"), F.sha1(payload).alias("sha"),
    )
    firsts = rows.groupBy(F.col("sha").alias("fsha"), F.col("n").alias("fn")).agg(F.min("page").alias("first"))
    joined = rows.join(firsts, (F.col("sha") == F.col("fsha")) & (F.col("n") == F.col("fn")))
    again = (F.col("n") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    plan = joined.select(
        "page", "url", F.when(~again, F.col("payload")).alias("payload"), "n", "sha",
        F.when(again, F.col("first")).alias("first"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        system, path = file_system(uri)
        count, size, out = 0, 0, None
        for batch in batches:
            for part in slices(batch, 256):
                cols = [part.column(c).to_pylist() for c in ("page", "url", "payload", "n", "sha", "first")]
                for page, url, body, n, sha, first in zip(*cols):
                    out = out or system.open_output_stream(path, compression=None)
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record_bytes(page, url, body, n, _b32(bytes.fromhex(sha)), first)
                    member = pack.compress(raw) + pack.flush()
                    out.write(member)
                    count, size = count + 1, size + len(member)
        if out:
            out.close()
            yield record_batches([("path", pa.string(), [uri]), ("n_records", pa.int64(), [count]), ("n_bytes", pa.int64(), [size])])

    return cut_lineage(plan.mapInArrow(write, "path string, n_records bigint, n_bytes bigint"))


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the listed archives, one task per archive, read front to back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = file_system(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    rows: list[tuple] = []
                    for f, n, body in read_records(stream):
                        number = lambda k: int(f[k]) if k in f else None
                        rows.append((number("page-id"), f.get("warc-target-uri"), f["warc-type"], n, f["warc-payload-digest"][5:], number("refers-to-page-id"), body if payload else None))
                        if len(rows) == 256:
                            yield pack(rows)
                            rows = []
                    yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows)) or [()] * 7
        kinds = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()))
        return record_batches([(name, kind, list(v)) for (name, kind), v in zip(kinds, c)])

    return one_row_each(archives.select("path"), "path").mapInArrow(
        read,
        "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary",
    )
