"""WARC archives: a writer with revisit records, and a reader that salvages what a damaged archive still holds.

Each record is a gzip member of its own, so a reader can start at any member. Of pages with equal payloads the one with
the largest id is written in full and the others as revisits that name it; the revisit keeps the HTTP header, and with
it the length, of the payload it leaves out.

The reader checks each member (gzip checksum, version line, block length, block digest). Where a check fails it looks
for the next valid member, or the next version line in a plain archive, goes on from there, and logs the bytes between
as a gap.

Tasks write archives to the shared folder under names of their own; a manifest, committed by Spark, lists those that
count, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm.common import columns, stored

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url),
        "WARC-Payload-Digest": "sha1:" + base32_sha1(payload),
        "WARC-Block-Digest": "sha1:" + base32_sha1(block),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "X-Page-Id": None if page_id is None else str(page_id),
        "X-Refers-To-Page": None if refers_to is None else str(refers_to),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    offset: int
    head: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def row(self) -> dict:
        """Page id, length and digest of the full payload, record type, and the page a revisit refers to."""
        revisit = self.head["warc-type"] == "revisit"
        length = re.search(rb"(?im)^content-length: *(\d+)", self.block.partition(b"\r\n\r\n")[0])
        page, to = self.head.get("x-page-id"), self.head.get("x-refers-to-page")
        return {
            "page_id": None if page is None else int(page),
            "payload_bytes": int(length[1]) if revisit and length else len(self.payload),
            "payload_digest": self.head["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(self.payload),
            "record_type": self.head["warc-type"],
            "refers_to": None if to is None else int(to),
        }


class Bad(ValueError):
    """A check that failed."""


def parsed(data: bytes, offset: int) -> tuple[Record, int]:
    """The record that begins ``data``, and its length; raises ``Bad`` where a check fails."""
    if not data.startswith(VERSION):
        raise Bad("no version line")
    top, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise Bad("no end of header")
    try:
        lines = top.decode("utf-8").split("\r\n")
    except UnicodeDecodeError:
        raise Bad("header is no text") from None
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Bad("no version line")
    if any(c < " " and c != "\t" for line in lines for c in line):
        raise Bad("header is no text")
    pairs = [line.partition(":") for line in lines[1:]]
    if len({k.lower() for k, _, _ in pairs}) < len(pairs) or not all(colon for _, colon, _ in pairs):
        raise Bad("header cut short")  # it runs into the next record's
    head = {k.strip().lower(): v.strip() for k, _, v in pairs}
    length = head.get("content-length", "")
    if not length.isdecimal() or "warc-type" not in head:
        raise Bad("no length or type")
    block = rest[: int(length)]
    end = len(top) + 4 + len(block) + 4
    if len(block) < int(length) or len(data) < end:
        raise Bad("block cut short")
    if data[end - 4 : end] != b"\r\n\r\n":
        raise Bad("no end of block")
    digest = head.get("warc-block-digest")
    if digest is not None and digest != "sha1:" + base32_sha1(block):
        raise Bad("block digest differs")
    return Record(offset, head, block), end


class Window:
    """A stream with as much of it in memory as the record at hand needs; ``at`` is the offset of ``data``."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.ended = stream, bytearray(), 0, False

    def more(self) -> bool:
        chunk = b"" if self.ended else self.stream.read(CHUNK)
        self.ended = not chunk
        self.data += chunk
        return not self.ended

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _inflated(window: Window, start: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``start``, and the place behind it."""
    unpacker, out, at = zlib.decompressobj(31), [], start
    while True:
        try:
            out.append(unpacker.decompress(bytes(window.data[at:])))
        except zlib.error as error:
            raise Bad(str(error)) from None
        at = len(window.data)
        if unpacker.eof:
            return b"".join(out), at - len(unpacker.unused_data)
        if len(out) == 1 and not out[0][:7].startswith(VERSION[: len(out[0][:7])]):
            raise Bad("no version line")
        if not window.more():
            raise Bad("member cut short")


def _record_at(window: Window, start: int) -> tuple[Record, int]:
    while len(window.data) - start < 8 and window.more():
        pass
    if window.data[start : start + 3] == MAGIC:
        content, end = _inflated(window, start)
        found, length = parsed(content, window.at + start)
        if length != len(content):
            raise Bad("bytes behind the record")
        return found, end
    if window.data[start : start + 7] != VERSION:
        raise Bad("no member and no version line")
    while True:
        try:
            found, length = parsed(bytes(window.data[start:]), window.at + start)
            return found, start + length
        except Bad as error:
            if str(error) not in ("no end of header", "block cut short") or not window.more():
                raise


def salvage(stream) -> Iterator[Record | tuple[int, int, str]]:
    """Records in order, and (offset, length, reason) of every gap of quarantined bytes."""
    window = Window(stream)
    while window.data or window.more():
        try:
            found, end = _record_at(window, 0)
        except Bad as error:
            begin, reason = window.at, str(error)
            at, found = 1, None
            while found is None:
                places = [p for p in (window.data.find(MAGIC, at), window.data.find(VERSION, at)) if p >= 0]
                if not places:
                    window.drop(max(0, len(window.data) - 6))  # a mark may lie across two chunks
                    at = 0
                    if not window.more():
                        window.drop(len(window.data))
                        break
                    continue
                at = min(places)
                try:
                    found, end = _record_at(window, at)
                except Bad:
                    at += 1
            yield begin, (found.offset if found else window.at) - begin, reason
            if found is None:
                return
        yield found
        window.drop(end)


def _opened(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where, name


PAGE = "page_id bigint, url string, payload binary, revisit boolean, refers_to bigint"
ROW = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
GAP = "path string, gap_offset bigint, gap_bytes bigint, reason string"


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """``PAGE`` rows: payloads, and which pages are revisits.

    Of pages with equal payloads of at least ``least`` bytes, that with the largest ``page_id`` is the response. Null
    html is an empty payload. Repeated rows of that largest id are all responses; a null id revisits like any other.
    """
    rows = columns(pages, page_id="bigint", url="string", html="string")
    rows = rows.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    rows = rows.join(groups.where("n > 1").drop("n"), "digest", "left")
    revisit = F.coalesce(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.lit(False))
    return rows.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a record; returns the manifest (path, n_records, n_bytes). An empty table writes no archive."""

    def run(batches):
        import pyarrow as pa

        done, out, path, n, size = [], None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "revisit", "refers_to")), strict=True):
                page_id, url, payload, revisit, refers_to = (x.as_py() for x in row)
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    where, name = _opened(path)
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(name, compression=None)
                packed = member(record(page_id, url, payload, refers_to, revisit))
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        columns_ = list(zip(*done, strict=True)) or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds, strict=True)], ["path", "n_records", "n_bytes"])

    written = planned(pages, least).mapInArrow(run, "path string, n_records bigint, n_bytes bigint")
    return stored(written, "warc-manifest")


def _read(paths: DataFrame, schema: str, wanted) -> DataFrame:
    """``wanted`` turns what ``salvage`` yields into rows of ``schema`` or None; one task per archive where it can."""
    from pyspark.sql.types import _parse_datatype_string

    files, kinds = max(1, paths.count()), _parse_datatype_string(schema)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for path in batch.column("path"):
                where, name = _opened(path.as_py())
                rows = []
                with where.open_input_stream(name, compression=None) as stream:
                    for x in salvage(stream):
                        if (row := wanted(path.as_py(), x)) is not None:
                            rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow.field(n).type) for n in names], schema=arrow)

    return paths.select("path").repartition(files).mapInArrow(run, kinds)


def read(paths: DataFrame) -> DataFrame:
    """``ROW`` for every record that can be read in the archives of ``paths``."""
    return _read(paths, ROW, lambda path, x: x.row() if isinstance(x, Record) else None)


def gaps(paths: DataFrame) -> DataFrame:
    """``GAP`` for every quarantined run of bytes in the archives of ``paths``."""

    def row(path, x):
        return None if isinstance(x, Record) else {"path": path, "gap_offset": x[0], "gap_bytes": x[1], "reason": x[2]}

    return _read(paths, GAP, row)


def archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")
