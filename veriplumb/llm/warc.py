"""WARC archives: one gzip member per record, a sequential reader, and revisit records for equal payloads.

Archives are rows of a table: ``archive_id, archive`` with the bytes of one archive file each. The reader inflates member
after member in blocks, frames each record by its content length and tests its digest.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, record, small_batches, small_side, staged

#: Payload bytes after which a writer starts another archive; a larger record is an archive of its own.
ARCHIVE_BYTES = 8 << 20
STEP = 1 << 16
#: The profile of revisits with the same payload (fixed value).
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def write_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """A record as one gzip member. Control characters and blanks in header values are percent-encoded, but for those of
    the content type."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v if k == 'Content-Type' else _safe(v)}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    last = None
    for x in lines:
        if x[:1] in (" ", "\t") and last is not None:
            out[last] += " " + x.strip()
            continue
        name, mark, value = x.partition(":")
        if mark:
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def digest_holds(said: str, data: bytes) -> bool:
    """Whether a labelled digest (SHA-1, SHA-256 or MD5, in base 32 or hex) is that of ``data``; others can't be tested."""
    label, _, value = said.partition(":")
    kind = label.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5"):
        return True
    raw, value = hashlib.new(kind, data).digest(), value.strip().rstrip("=").lower()
    return value in (raw.hex(), base64.b32encode(raw).decode().rstrip("=").lower())


def _unchunked(body: bytes) -> bytes | None:
    """The body that chunks of HTTP carry, or None if they don't add up."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n > len(body):
            return None
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The payload of a record, and the same as transferred. That of an HTTP message is its body, any other the block."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block, block
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return b"", b""
    fields = _fields(head.decode("latin-1").split("\r\n")[1:])
    plain = _unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else None
    return (body if plain is None else plain), body


def read_records(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """``(type, headers, block)`` of each record in turn; ValueError for a broken member, frame or digest."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(wbits=31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("gzip member is cut short")
            step = view[at : at + STEP]
            try:
                parts.append(inflate.decompress(step))
            except zlib.error as e:
                raise ValueError(f"broken gzip member: {e}") from e
            at += len(step) - len(inflate.unused_data)
        whole = b"".join(parts)
        head, mark, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not mark or not lines[0].startswith("WARC/"):
            raise ValueError("no WARC header")
        headers = _fields(lines[1:])
        size = headers.get("content-length", "")
        if not size.isdigit() or "warc-type" not in headers:
            raise ValueError("no content length or no type")
        n = int(size)
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError("content length and record disagree")
        block = rest[:n]
        if (said := headers.get("warc-block-digest")) and not digest_holds(said, block):
            raise ValueError("block digest is wrong")
        whole_payload = headers["warc-type"] != "revisit" and "warc-segment-number" not in headers and "warc-truncated" not in headers
        if whole_payload and (said := headers.get("warc-payload-digest")) and not any(digest_holds(said, p) for p in {*payload_of(headers, block)}):
            raise ValueError("payload digest is wrong")
        yield headers["warc-type"], headers, block


def _record_of(page_id, url, html, refers_to, nth: int, date: str) -> tuple[bytes, int]:
    payload = (html or "").encode()
    digest = f"sha1:{digest32(payload)}"
    own = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest} {nth}')}>"
    headers = {"WARC-Record-ID": own, "WARC-Date": date, "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        headers["WARC-Target-URI"] = url
    if refers_to is not None:  # what is left out is told by its length, of which the standard has no field
        headers |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": f"<urn:page:{refers_to}>", "X-Payload-Length": str(len(payload))}
        block = b""
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers["WARC-Block-Digest"] = f"sha1:{digest32(block)}"
    return write_record("response" if refers_to is None else "revisit", headers, block), len(block)


ARCHIVES = pa.schema([("archive", pa.binary()), ("records", pa.int64())])


def _writer(date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, nth = [], 0, 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                made, n = _record_of(*row, nth, date)
                nth += 1
                if parts and size + n > ARCHIVE_BYTES:
                    yield record(ARCHIVES, [b"".join(parts)], [len(parts)])
                    parts, size = [], 0
                parts.append(made)
                size += n
        if parts:
            yield record(ARCHIVES, [b"".join(parts)], [len(parts)])

    return write


READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
    ("record_id", pa.string()), ("refers_to_id", pa.string()), ("date", pa.string()), ("content_type", pa.string()),
])


def _number(said: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", said or "")
    return int(found[1]) if found else None


def _row(kind: str, h: dict[str, str], block: bytes, payloads: bool) -> tuple:
    payload = payload_of(h, block)[0]
    size, digest = len(payload), digest32(payload)
    if kind == "revisit":  # the payload is elsewhere; the headers tell of it
        said, length = h.get("warc-payload-digest", ""), h.get("x-payload-length", "")
        size, digest = int(length) if length.isdigit() else None, said.removeprefix("sha1:") or None
    own, refers = h.get("warc-record-id"), h.get("warc-refers-to")
    short = (_number(own), size, digest, kind, _number(refers))
    return (*short, h.get("warc-target-uri"), payload, own, refers, h.get("warc-date"), h.get("content-type")) if payloads else short


def _reader(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = READ if payloads else pa.schema(list(READ)[:5])
        for b in blocks(batches, "archive", 1):
            rows: list[tuple] = []
            held = 0
            for data in b.column("archive").to_pylist():
                for kind, h, block in read_records(data):
                    rows.append(_row(kind, h, block, payloads))
                    held += len(block) if payloads else 0
                    if len(rows) >= 2000 or held > ARCHIVE_BYTES:
                        yield record(fields, *(list(c) for c in zip(*rows, strict=True)))
                        rows, held = [], 0
            if rows:
                yield record(fields, *(list(c) for c in zip(*rows, strict=True)))

    return read


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: for pages whose equal payload a smaller page_id has, that id.

    Payloads are equal if their SHA-1 digests are; null html is empty. Only digests that repeat are joined, by broadcast
    when they are few; a digest that many rows share is counted before it is dealt out. Rows that repeat with one
    page_id are all responses if that id is the smallest; a null page_id refers to the smallest id, if any.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("sha", F.unhex(F.sha1(body)))
    again = rows.filter(F.octet_length(body) >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    linked = rows.join(small_side(again), "sha", "left")
    return linked.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def to_archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of about 8 MB of payload: ``archive binary, records long``. Each page is one record; no pages, none.

    Records are HTTP responses with the page as their body, and the standard's mandatory headers; pages carry no date,
    so that all have ``date``. A null id gives a record a random-looking name made of its contents; a null url no target;
    columns besides page_id, url and html are ignored.
    """
    small_batches(pages.sparkSession)
    return with_revisits(pages, min_bytes).mapInArrow(_writer(date), "archive binary, records long")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record, in the archives' order: ids, length and digest of the full payload, type, and the payload.

    Any archive is read that holds one gzip member per record, with records of all types. Length and digest are those of
    the payload itself: of an HTTP message its body, without chunks. Just those of revisits, whose payload is elsewhere,
    are the headers'; without them they are null. Ids of other forms than this writer's are null, and whole in
    ``record_id``. A broken record stops the job. No archives give no rows, and an empty archive none.
    """
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    more = ", url string, payload binary, record_id string, refers_to_id string, date string, content_type string"
    return archives.select("archive").mapInArrow(_reader(payloads), fields + more * payloads)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    return read_archives(staged(to_archives(pages, min_bytes)), payloads=False)


FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("size", pa.int64())])


def _file_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            rows = []
            for data, n in zip(b.column("archive").to_pylist(), b.column("records").to_pylist(), strict=True):
                path = f"{root}/{hashlib.sha1(data).hexdigest()}.warc.gz"  # a task that runs again writes the same file
                with store.open_output_stream(f"{path}.part", compression=None) as f:
                    f.write(data)
                store.move(f"{path}.part", path)
                rows.append((path, n, len(data)))
            if rows:
                yield record(FILES, *(list(c) for c in zip(*rows, strict=True)))

    return write


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a ``.warc.gz`` file of a shared folder, given by URI; ``path, records, size`` of each file.

    The folder must be one that all executors reach. The result is staged, so that files are written once.
    """
    return staged(archives.select("archive", "records").mapInArrow(_file_writer(folder), "path string, records long, size long"))


def read_files(spark, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all ``.warc.gz`` files of a folder, as ``read_archives`` gives them; a file is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return read_archives(files.select(F.col("content").alias("archive")), payloads)
