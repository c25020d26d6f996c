"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame per record.

The reader streams: it holds a record and a read buffer, whatever the size of the archive. It loads the
dictionary (itself compressed or not), decodes a frame at a time and validates each record: version
line, header syntax, mandatory fields, Content-Length against the block, the closing empty lines and,
where there are such, the SHA-1 of the block and of the payload.

Defined results: a faulty record is a row with ``error``; bytes that can't be decoded give one row with
``error`` up to the next frame that decodes to a record, from which the archive goes on; without its dictionary an archive
is one such row; an empty archive has no rows; null archives are skipped, repeated ones read again; columns but (archive, content) play no part; a page of null html is an empty record, of null url one without a target.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
READ, PIECE = 64 << 10, 8 << 10
ARCHIVE_BYTES = 16 << 20
RECORDS = "archive string, offset long, version string, type string, record_id string, date string, target_uri string, fields map<string,string>, length long, block binary, error string"
_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("version", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("target_uri", pa.string()),
                    ("fields", pa.map_(pa.string(), pa.string())), ("length", pa.int64()), ("block", pa.binary()), ("error", pa.string())])
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def parse(raw: bytes) -> dict:
    """One decoded record; ``error`` names the first fault."""
    out: dict = {"fields": {}, "length": None, "block": None, "error": None}
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    out["version"] = lines[0].decode("utf-8", "replace")
    if not gap:
        return out | {"error": "header not ended"}
    if out["version"] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "version line"}
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:  # a folded line goes on
            fields[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        last = name.strip().lower()
        if not colon or not last:
            return out | {"error": "header line"}
        if last in fields and last != "warc-concurrent-to":
            return out | {"error": f"field twice: {last}"}
        fields[last] = value.strip()
    out["fields"] = fields
    for name in MANDATORY:
        if not fields.get(name):
            return out | {"error": f"field missing: {name}"}
    if not fields["content-length"].isdigit():
        return out | {"error": "length not a number"}
    n = out["length"] = int(fields["content-length"])
    if len(rest) < n:
        return out | {"error": "block shorter than its length"}
    out["block"] = rest[:n]
    if rest[n:] != b"\r\n\r\n":
        return out | {"error": "block not closed" if len(rest) < n + 4 else "block longer than its length"}
    for name, of in (("warc-block-digest", lambda: out["block"]), ("warc-payload-digest", lambda: payload(fields, out["block"]))):
        want = fields.get(name, "")
        if want.startswith("sha1:") and fields["warc-type"] != "revisit" and want != digest(of()):
            return out | {"error": "digest" if name == "warc-block-digest" else "payload digest"}
    return out


def payload(fields: dict[str, str], block: bytes) -> bytes:
    """What is in an HTTP message after its head; any other block is its own payload."""
    http = fields.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    return block.partition(b"\r\n\r\n")[2] if http else block


class _Input:
    """A stream with a window: what was read stays until it is passed, so that a reader can go back in it."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.held, self.offset = stream, bytearray(), 0

    def need(self, n: int) -> bool:
        while len(self.held) < n:
            got = self.stream.read(READ)
            if not got:
                return False
            self.held += got
        return True

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.offset += n


def _frame(src: _Input, book) -> tuple[bytes | None, int, str | None]:
    """(content, length, fault) of the frame at the head of the input; nothing is passed."""
    one = zstandard.ZstdDecompressor(max_window_size=1 << 31, **({"dict_data": book} if book else {})).decompressobj()
    parts, at = [], 0
    try:
        while True:
            if not src.need(at + 1):
                return None, at, "frame cut off"
            piece = bytes(src.held[at : at + PIECE])
            parts.append(one.decompress(piece))
            at += len(piece)
            if one.eof:
                return b"".join(parts), at - len(one.unused_data), None
    except zstandard.ZstdError as e:
        return None, at, f"frame: {e}"


def _resync(src: _Input, book) -> None:
    """Pass over bytes up to a frame that decodes to a record, or to the end."""
    while True:
        at = src.held.find(FRAME, 1)
        if at < 0:
            keep = len(FRAME) - 1
            src.skip(max(0, len(src.held) - keep))
            if not src.need(keep + 1):
                src.skip(len(src.held))
                return
            if not src.held.startswith(FRAME):
                continue
        else:
            src.skip(at)
        body, _, fault = _frame(src, book)
        if fault is None and body.startswith(b"WARC/"):
            return


def records(stream: BinaryIO) -> Iterator[dict]:
    """Records of an archive with their offsets."""
    src = _Input(stream)
    book = None
    first = True
    while src.need(1):
        start = src.offset
        magic = struct.unpack("<I", src.held[:4])[0] if src.need(4) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50 and src.need(8) and src.need(8 + (n := struct.unpack("<I", src.held[4:8])[0])):
            body = bytes(src.held[8 : 8 + n])
            if first and magic == DICTIONARY:
                try:
                    if body[:4] == FRAME:
                        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                    book = zstandard.ZstdCompressionDict(body)
                except zstandard.ZstdError as e:
                    yield {"offset": start, "error": f"dictionary: {e}"}
                    return
            src.skip(8 + n)
        elif bytes(src.held[:4]) == FRAME:
            body, n, fault = _frame(src, book)
            if fault is None:
                yield {"offset": start, **parse(body)}
                src.skip(n)
            else:
                yield {"offset": start, "error": fault}
                _resync(src, book)
        else:
            yield {"offset": start, "error": "skippable frame cut off" if magic & 0xFFFFFFF0 == 0x184D2A50 else "not a frame"}
            _resync(src, book)
        first = False


def _batches(name: str, stream: BinaryIO) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in records(stream):
        f = r.get("fields") or {}
        rows.append({"archive": name, "offset": r["offset"], "version": r.get("version"), "type": f.get("warc-type"), "record_id": f.get("warc-record-id"), "date": f.get("warc-date"),
                     "target_uri": f.get("warc-target-uri"), "fields": list(f.items()), "length": r.get("length"), "block": r.get("block"), "error": r["error"]})
        size += len(r.get("block") or b"")
        if size > 4 << 20 or len(rows) >= 4096:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives held in a table (archive string, content binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("archive"), b.column("content")):
                if content.is_valid:
                    yield from _batches(name.as_py(), pa.BufferReader(content.as_buffer()))

    return archives.select("archive", "content").mapInArrow(run, RECORDS)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of archive files, a task for each, streamed from any file system that Arrow can open."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with system.open_input_stream(at, compression=None) as stream:
                    yield from _batches(path, stream)

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, len(paths))).mapInArrow(run, RECORDS)


def record(kind: str, rid: str, date: str, block: bytes, extra: dict[str, str]) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{rid}>", "WARC-Date": date, "Content-Length": str(len(block)), "WARC-Block-Digest": digest(block)} | extra
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(raw: list[bytes], dictionary_bytes: int = 16 << 10) -> bytes:
    """An archive of encoded records, with a dictionary trained on them (or made of the first, if few)."""
    try:
        book = zstandard.train_dictionary(dictionary_bytes, raw)
    except zstandard.ZstdError:
        book = zstandard.ZstdCompressionDict(raw[0][:dictionary_bytes] if raw else b"none", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    body = book.as_bytes()
    z = zstandard.ZstdCompressor(level=3, dict_data=book)
    out = io.BytesIO()
    packed = zstandard.ZstdCompressor().compress(body)
    out.write(struct.pack("<II", DICTIONARY, len(packed)) + packed)
    for r in raw:
        out.write(z.compress(r))
    return out.getvalue()


def pack_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, content) of a table of pages; each partition fills its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            name = hashlib.sha1(b"".join(held[0:1])).hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive(held)], pa.binary())], ["archive", "content"])

        for b in batches:
            for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist()):
                extra = {"Content-Type": "text/html; charset=utf-8"}
                if url is not None:
                    extra["WARC-Target-URI"] = " ".join(url.split("\r\n"))
                if page is not None:
                    extra["X-Page-Id"] = str(page)
                held.append(record("resource", str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {url}")), "2024-01-01T00:00:00Z", (html or "").encode(), extra))
                size += len(held[-1])
                if size > archive_bytes:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return pages.select("page_id", "url", "html").mapInArrow(run, "archive string, content binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table through archives and back: every valid record, with its length."""
    got = read_archives(pack_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return got.select(F.col("fields")["x-page-id"].cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.decode("block", "UTF-8").alias("html"), F.col("length").alias("n_bytes"), "error")


SQL = "select page_id, url, html, cast(strlen(html) as bigint) as n_bytes, cast(null as varchar) as error from pages"
