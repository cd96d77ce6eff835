"""WARC records in ZIP archives: a writer, and a reader that range-reads records without extraction.

An archive holds one gzipped-by-record WARC member and its CDXJ index, both stored (not compressed again). The reader parses the end
record, the ZIP64 records where there are any, and the central directory; it finds the members there, reads the index, and then each
record by offset and length from the stored member.

Archives are written to the shared folder; a table of the paths that ended well is written too, so an archive of a task that was lost
and run again is never read. Memory is bounded by one archive (ROLL_BYTES). Nulls: a null payload counts as empty, a null url as ''; a null
id gives a response of its own. Rows that repeat an id with one payload are responses, each of them. An empty table gives no archives
and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, written

ROLL_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def index_key(url: str) -> str:
    """A url as the first field of an index line: no space, brace or character that ends a line to any reader."""
    return re.sub(r"[\s{}\x1c-\x1f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record: a response, or where `first` is given a revisit of that page's response."""
    revisit = first is not None
    body = HTTP if revisit else HTTP + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:x-page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parsed(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one gzipped record; a response's payload is measured and digested again."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    page = lambda name: int(v) if (v := fields[name].removeprefix("<urn:x-page:").removesuffix(">")) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return page("WARC-Record-ID"), int(fields["X-Payload-Length"]), digest, "revisit", page("WARC-Refers-To")
    payload = body.partition(b"\r\n\r\n")[2]
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload differs from its digest")
    return page("WARC-Record-ID"), len(payload), digest, "response", None


def archive(records: list[bytes], index: list[dict]) -> bytes:
    """A ZIP archive of stored members."""
    out, at = io.BytesIO(), 0
    lines = []
    for data, entry in zip(records, index, strict=True):
        lines.append(f"{index_key(entry['url'])} 20240101000000 " + json.dumps(entry | {"offset": at, "length": len(data), "filename": MEMBER.rpartition("/")[2]}))
        at += len(data)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(MEMBER, b"".join(records))
        z.writestr(INDEX, "\n".join(sorted(lines)).encode())
    return out.getvalue()


class ZipReader:
    """Members of a ZIP archive in a seekable file, by its central directory."""

    def __init__(self, file, size: int):  # noqa: ANN001
        self.file, self.size = file, size
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        end = tail_at + at
        if (locator := self.read(end - 20, 20) if end >= 20 else b"")[:4] == b"PK\x06\x07":
            big = struct.unpack("<Q", locator[8:16])[0]
            record64 = self.read(big, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", record64[32:56])
        self.members = dict(self._directory(self.read(start, length), count))

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    @staticmethod
    def _directory(data: bytes, count: int) -> Iterator[tuple[str, dict]]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            flags, method = struct.unpack("<HH", data[at + 8 : at + 12])
            packed, full = struct.unpack("<II", data[at + 20 : at + 28])
            name_n, extra_n, comment_n = struct.unpack("<HHH", data[at + 28 : at + 34])
            header = struct.unpack("<I", data[at + 42 : at + 46])[0]
            name = data[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = data[at + 46 + name_n : at + 46 + name_n + extra_n], 0
            while k + 4 <= len(extra):  # ZIP64 sizes stand in for those that are all ones, in this order
                tag, n = struct.unpack("<HH", extra[k : k + 4])
                if tag == 1:
                    big = iter(struct.unpack(f"<{n // 8}Q", extra[k + 4 : k + 4 + n // 8 * 8]))
                    full, packed, header = (next(big) if v == 0xFFFFFFFF else v for v in (full, packed, header))
                k += 4 + n
            yield name, {"method": method, "size": packed, "full": full, "header": header}
            at += 46 + name_n + extra_n + comment_n

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if member["method"] != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.read(member["header"], 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        return member["header"] + 30 + sum(struct.unpack("<HH", head[26:30]))

    def records(self) -> Iterator[bytes]:
        """The records that the archive's indexes name, each by a range read."""
        for name in sorted(self.members):
            if name.startswith("indexes/") and name.endswith(".cdxj"):
                lines = self.read(self.start(name), self.members[name]["size"]).decode().split("\n")
                entries = [json.loads(line.split(" ", 2)[2]) for line in lines if line]
                starts = {f: self.start(f"archive/{f}") for f in {e["filename"] for e in entries}}
                for e in sorted(entries, key=lambda e: (e["filename"], e["offset"])):
                    yield self.read(starts[e["filename"]] + e["offset"], e["length"])


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives of a record per page; (path, records) of each. Of equal payloads of `least_bytes` or more the page with the largest id is the response."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n"))
    keeper = rows.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    told = rows.join(keeper, ["sha", "n"], "left").select("page_id", "url", "html", "sha", F.when(F.col("page_id") != F.col("keeper"), F.col("keeper")).alias("first"))
    folder = fresh_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base)
        records, index, size = [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{base}/{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(name) as f:
                f.write(archive(records, index))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([len(records)], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, html, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                clean = url.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
                data = record(page_id, clean, html.encode(), digest, first)
                records.append(data)
                index.append({"url": clean, "digest": f"sha1:{digest}"})
                size += len(data)
                if size >= ROLL_BYTES:
                    yield close()
                    records, index, size = [], [], 0
        if records:
            yield close()

    return written(told.mapInArrow(run, "path string, records long"), "warc-paths")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives at `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = opened(path)
                with system.open_input_file(name) as f:
                    rows = [parsed(x) for x in ZipReader(f, f.size()).records()]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return archives.select("path").mapInArrow(run, RECORDS)
