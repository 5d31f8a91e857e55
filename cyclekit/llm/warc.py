"""WARC archives: one gzip member per record, written by Spark tasks and read back by a
sequential reader.

Writing: payload digests are grouped, so that of equal payloads the record with the
smallest id is the response and the others are revisits that name it. Each task writes
archives of about ``archive_bytes`` into the shared folder (a file gets its final name
only when it is complete) and returns a manifest row for each; the manifest is a
written table. A task that runs again writes other files, and files that no manifest
row names are never read.

Reading: archives are spread over tasks; a task streams an archive block by block
through zlib (``unused_data`` starts the next member), takes the header up to the empty
line, then exactly Content-Length bytes, and checks length and digests while they pass.
Memory holds a block and one record's payload."""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stage

BLOCK = 1 << 16
READERS = 20_000                        # tasks that read archives, at most
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100
CREATED = "2024-01-01T00:00:00Z"       # the pages carry no capture time


class WarcError(ValueError):
    """An archive that is cut short, wrongly framed, or whose digest does not match."""


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def _sha256(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record_bytes(kind: str, name: str, uri: str | None, payload: bytes, digest: str,
                 refers_to: str | None = None, length: int | None = None) -> bytes:
    """One record as a gzip member. A revisit has an empty block and the full payload's digest."""
    block = b"" if kind == "revisit" else payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", CREATED)]
    if uri:
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)))
    head += [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", _sha256(block))]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    if length is not None:
        head.append(("X-Payload-Length", str(length)))
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(lines.encode("utf-8") + block + b"\r\n\r\n") + z.flush()


def read_records(source, block: int = BLOCK) -> Iterator[Record]:
    """Records of a stream of gzip members (``source.read(n)``), in order. Raises WarcError
    for cut or trailing data, a wrong length or a wrong block digest."""
    z, held, raw = None, bytearray(), b""
    while True:
        if not raw:
            raw = source.read(block)
            if not raw:
                if z is not None:
                    raise WarcError("the archive ends inside a record")
                return
        if z is None:
            z, held, headers, need, sought = zlib.decompressobj(31), bytearray(), None, None, 0
            digest = hashlib.sha256()
            payload: list[bytes] = []
        try:
            held += z.decompress(raw, block)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        raw = z.unused_data if z.eof else z.unconsumed_tail
        if headers is None and (end := held.find(b"\r\n\r\n", sought)) >= 0:
            headers = _headers(bytes(held[:end]))
            need = int(headers["content-length"])
            del held[:end + 4]
        sought = max(0, len(held) - 3)
        if headers is not None and need and held:
            part = bytes(held[:need])
            del held[:len(part)]
            need -= len(part)
            digest.update(part)
            payload.append(part)
        if not z.eof:
            continue
        if headers is None or need or held != b"\r\n\r\n":
            raise WarcError("a record's length is not its Content-Length")
        want = headers.get("warc-block-digest")
        if want and want != "sha256:" + base64.b32encode(digest.digest()).decode().rstrip("="):
            raise WarcError(f"block digest does not match: {headers.get('warc-record-id')}")
        record, z = Record(headers, b"".join(payload)), None
        if record.kind == "response" and headers.get("warc-payload-digest", want) != want:
            raise WarcError(f"payload digest does not match: {headers.get('warc-record-id')}")
        yield record


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("a record without a WARC version line")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header line: {line[:80]}")
        out[name.strip().lower()] = value.strip()
    if not out.get("content-length", "").isdigit():
        raise WarcError("a record without a Content-Length")
    return out


def _files(path: str):
    """(file system, path in it) of a folder's address. An address that pyarrow cannot open
    (``viewfs:``, say) is an error before any work is done."""
    path = re.sub("^s3[an]://", "s3://", path)
    try:
        return _open(path)
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise WarcError(f"archives cannot be kept under {path}: {e}") from e


def _open(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        out, name, size, records, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                fs.move(f"{base}/{name}.part", f"{base}/{name}.warc.gz")
                done.append((f"{name}.warc.gz", records, size))
                out = None

        for batch in batches:
            for i, uri, html, first in zip(*(batch.column(c).to_pylist() for c in ("id", "uri", "html", "first"))):
                payload = (html or "").encode("utf-8")
                if out is None:
                    name, size, records = uuid.uuid4().hex, 0, 0
                    out = fs.open_output_stream(f"{base}/{name}.part", compression=None)
                own = "" if i is None else str(i)
                if first is not None and first != i:
                    data = record_bytes("revisit", own, uri, payload, _sha256(payload), str(first), len(payload))
                else:
                    data = record_bytes("response", own, uri, payload, _sha256(payload))
                out.write(data)
                size += len(data)
                records += 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(
            (pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html",
                   archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a record per row and give the manifest ``(archive, records, bytes)``, a written
    table. Null payloads are empty. Payloads shorter than 100 bytes are never revisits;
    a row with a null id is always a response and is never referred to; rows that repeat
    the smallest id of their payload are responses too."""
    fs, base = _files(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"),
                        F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= MIN_REVISIT, F.sha2(F.col("html").cast("binary"), 256)))
    same = rows.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("first"), F.count("id").alias("n")).where("n > 1").select("digest", "first")
    marked = rows.join(same, "digest", "left").select("id", "uri", "html", F.when(F.col("id").isNotNull(), F.col("first")).alias("first"))
    return stage(marked.mapInArrow(_writer(folder, archive_bytes), "archive string, records long, bytes long"), "manifest")


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        for batch in batches:
            for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                rows, held, count = [], 0, 0
                with fs.open_input_stream(f"{base}/{archive}", compression=None) as source:
                    for r in read_records(source):
                        count += 1
                        name = lambda h: (v := r.headers.get(h, "<urn:page:>"))[10:-1] and int(v[10:-1])
                        digest = base64.b32decode(r.headers["warc-payload-digest"].split(":")[1] + "====").hex()
                        length = len(r.payload) if r.kind == "response" else int(r.headers["x-payload-length"])
                        own, to = name("warc-record-id"), name("warc-refers-to")
                        rows.append((None if own == "" else own, r.headers.get("warc-target-uri"), r.kind, length, digest,
                                     None if to == "" else to, r.payload if with_payload else None))
                        held += len(r.payload) if with_payload else 100
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if count != records:
                    raise WarcError(f"{archive} holds {count} records, not {records}")
                yield _rows(rows)
    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row a record: page_id, uri, record_type, payload_bytes, payload_digest (bare hex),
    refers_to, payload (null without ``with_payload``; empty for revisits). Lengths and
    digests are those of the full payload. Raises on a damaged archive. Archives are dealt
    over as many tasks as there are archives, up to READERS."""
    n = min(READERS, max(1, manifest.count()))
    # a number of partitions that is asked for by number is not merged by adaptive execution
    spread = manifest.select("archive", "records").repartition(n)
    return spread.mapInArrow(_reader(folder, with_payload),
                             "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, "
                             "refers_to long, payload binary")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    return read_archives(manifest, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  s AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
  f AS (SELECT payload_digest, min(page_id) AS first FROM s WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM s LEFT JOIN f USING (payload_digest)"""
