"""Web archives in ZIP packages: written by tasks, read by ranges without extraction.

A package holds, stored without compression, ``archive/data.warc.gz`` with one gzip member per
record, ``indexes/index.cdxj`` with the range of every record, and ``datapackage.json``. The
reader finds the members through the ZIP directory (ZIP64 where it is used), takes the index, and
then reads records by their ranges. Paths may name any store that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrelbook.session import checkpointed, scratch_path

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Compressed bytes after which a task begins another package.
PACKAGE_BYTES = 16 << 20
#: Records that are read together.
RANGE_RECORDS, RANGE_BYTES = 512, 8 << 20
RECORD_DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside of it."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


# --- ZIP directory ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class ZipDirectory:
    """Members of a ZIP file from its central directory, read through ``read_at(offset, size)``."""

    def __init__(self, size: int, read_at):
        self.read_at = read_at
        tail_size = min(size, 22 + 0xFFFF)
        tail = read_at(size - tail_size, tail_size)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(b"PK\5\6", 0, at)  # the signature may also occur in a comment
        if at < 0:
            raise ValueError("no end of a central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        end = size - tail_size + at
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = read_at(end - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            record = read_at(int.from_bytes(locator[8:16], "little"), 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 directory end")
            count, length, start = struct.unpack("<QQQ", record[32:56])
        self.members = {m.name: m for m in self._entries(read_at(start, length), count)}

    @staticmethod
    def _entries(data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", data[at + 8 : at + 12])
            stored, size, name_size, extra_size, comment_size = struct.unpack("<IIHHH", data[at + 20 : at + 34])
            header = int.from_bytes(data[at + 42 : at + 46], "little")
            name = data[at + 46 : at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
            size, stored, header = _zip64_values(extra, size, stored, header)
            yield Member(name, method, size, stored, header)
            at += 46 + name_size + extra_size + comment_size

    def begin(self, name: str) -> int:
        """Offset of the first byte of a stored member."""
        member = self.members[name]
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored")
        local = self.read_at(member.header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        name_size, extra_size = struct.unpack("<HH", local[26:30])
        return member.header + 30 + name_size + extra_size

    def read(self, name: str) -> bytes:
        return self.read_at(self.begin(name), self.members[name].size)


def _zip64_values(extra: bytes, size: int, stored: int, header: int) -> tuple[int, int, int]:
    """Values that the ZIP64 field replaces: those at their maximum, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            values = iter(struct.unpack(f"<{length // 8}Q", extra[at + 4 : at + 4 + length // 8 * 8]))
            size = next(values) if size == 0xFFFFFFFF else size
            stored = next(values) if stored == 0xFFFFFFFF else stored
            header = next(values) if header == 0xFFFFFFFF else header
        at += 4 + length
    return size, stored, header


# --- records ----------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Ends of lines beyond ASCII; readers that split text at them would break a header or index line.
_BREAKS = "\x7f\x85\u2028\u2029"


def _line(value: str) -> str:
    return "".join(c if c > " " and c not in _BREAKS else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(row: dict) -> bytes:
    """A WARC record of a page; ``first`` differs from the page's id if it revisits another."""
    payload = row["payload"]
    headers = {"WARC-Type": "response" if row["is_response"] else "revisit"}
    if row["page_id"] is not None:
        headers["WARC-Record-ID"] = f"<urn:page:{row['page_id']}>"
    if row["url"] is not None:
        headers["WARC-Target-URI"] = _line(row["url"])
    headers["WARC-Date"] = RECORD_DATE
    headers["WARC-Payload-Digest"] = f"sha1:{base64.b32encode(bytes.fromhex(row['sha1'])).decode()}"
    headers["WARC-Payload-Length"] = str(len(payload))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row["is_response"]:
        body = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        headers["WARC-Profile"] = PROFILE
        if row["first"] is not None:
            headers["WARC-Refers-To"] = f"<urn:page:{row['first']}>"
        body = http + b"\r\n"
    headers["Content-Type"] = "application/http; msgtype=response"
    headers["Content-Length"] = str(len(body))
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def _urn(value: str | None) -> int | None:
    return None if value is None else int(value.removeprefix("<urn:page:").removesuffix(">"))


def page_of(data: bytes) -> dict:
    """What a record says of its page; the payload of a response is checked against its digest."""
    headers, block = parse_record(data)
    response = headers["WARC-Type"] == "response"
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(headers["WARC-Payload-Length"])
    payload = block.partition(b"\r\n\r\n")[2] if response else None
    if response and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": _urn(headers.get("WARC-Record-ID")),
        "url": headers.get("WARC-Target-URI"),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": _urn(headers.get("WARC-Refers-To")),
    }


# --- writing ----------------------------------------------------------------------------------


class _Package:
    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, row: dict) -> None:
        member = gzip.compress(record_bytes(row), compresslevel=1, mtime=0)
        entry = {"offset": self.data.tell(), "length": len(member), "digest": row["sha1"]}
        url = _line(row["url"] or "")
        self.index.append(f"{url or '-'} {RECORD_DATE} {json.dumps(entry)}\n")
        self.data.write(member)

    def write(self, path: str) -> None:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            package.writestr(DATA, self.data.getbuffer())
            package.writestr(INDEX, "".join(self.index))
            resources = [{"name": name.rsplit("/")[-1], "path": name} for name in (DATA, INDEX)]
            package.writestr(PACKAGE, json.dumps({"profile": "data-package", "resources": resources}))
        store, inner = open_store(path)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(inner) as stream:
            stream.write(out.getbuffer())


def _packages(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}"
        written = 0

        def finish(package: _Package) -> pa.RecordBatch:
            path = f"{stem}-{written:04d}.wacz"
            package.write(path)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(package.index)])], names=["path", "records"])

        package = _Package()
        for batch in batches:
            for row in batch.to_pylist():
                package.add(row)
                if package.data.tell() >= limit:
                    yield finish(package)
                    written, package = written + 1, _Package()
        if package.index:
            yield finish(package)

    return run


def write_packages(
    pages: DataFrame,
    folder: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    revisit_bytes: int = 0,
    package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write all pages below ``folder``; gives ``(path, records)`` of the packages.

    Of equal payloads of at least ``revisit_bytes`` the page with the smallest id is a response
    and the others revisit it. Only the digests that occur twice are joined back to the pages,
    from a written table, so Spark knows its size and broadcasts it only if it is small. A task
    names its files after its attempt, and only files of finished tasks are listed.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    own = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    path = scratch_path(spark, "repeated-payloads")
    large = F.octet_length("payload") >= revisit_bytes
    counted = own.filter(large).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    counted.filter("n > 1").select(F.col("sha1").alias("again"), "first").write.parquet(path)
    again = spark.read.schema("again string, first long").parquet(path)
    met = own.join(again, own.sha1 == again.again, "left")
    response = F.col("again").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    rows = met.select("page_id", "url", "payload", "sha1", "first", response.alias("is_response"))
    return checkpointed(rows.mapInArrow(_packages(folder, package_bytes), "path string, records long"))


# --- reading ----------------------------------------------------------------------------------


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From package paths to groups of neighbouring records."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, inner = open_store(path)
            with store.open_input_file(inner) as file:
                directory = ZipDirectory(file.size(), lambda at, size: file.read_at(size, at))
                begin = directory.begin(DATA)
                lines = directory.read(INDEX).decode().split("\n")[:-1]  # every line ends with one
            held: list[tuple[int, int]] = []
            groups = [held]
            for line in lines:
                entry = json.loads(line.split(" ", 2)[2])
                end = entry["offset"] + entry["length"]
                if held and (len(held) >= RANGE_RECORDS or end - held[0][0] > RANGE_BYTES):
                    held = []
                    groups.append(held)
                held.append((entry["offset"], entry["length"]))
            groups = [g for g in groups if g]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * len(groups), pa.string()),
                    pa.array([[begin + at for at, _ in g] for g in groups], pa.list_(pa.int64())),
                    pa.array([[n for _, n in g] for g in groups], pa.list_(pa.int64())),
                ],
                names=["path", "offsets", "lengths"],
            )


RECORD = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)
_RECORD_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _records(with_payload: bool):
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inner = open_store(row["path"])
                out = []
                with store.open_input_file(inner) as file:
                    for at, size in zip(row["offsets"], row["lengths"]):
                        page = page_of(zlib.decompress(file.read_at(size, at), 31))
                        if not with_payload:
                            page["payload"] = None
                        out.append(page)
                columns = [pa.array([p[n] for p in out], k) for n, k in zip(names, _RECORD_KINDS)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_packages(spark: SparkSession, packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the packages listed in ``path``, read by ranges.

    ``payload`` is that of a response, NULL for a revisit; length and digest are those of the full
    payload for both. Without packages there are no rows.
    """
    # Rows are few and small but stand for much reading: a fixed number of tasks is not merged.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = packages.select("path").repartition(tasks, "path").mapInArrow(
        _ranges, "path string, offsets array<long>, lengths array<long>"
    )
    dealt = ranges.repartition(tasks, "path", F.element_at("offsets", 1))
    return dealt.mapInArrow(_records(with_payload), RECORD)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write all pages to packages in the shared folder and read their records back.

    NULL html is an empty payload, a NULL URL has no target header, a NULL id no record id.
    Repeated rows of the smallest id are all responses; a NULL id revisits if the payload occurs
    under an id, and payloads that occur only without ids are all responses. An empty table writes
    no package and gives no rows.
    """
    spark = pages.sparkSession
    return read_packages(spark, write_packages(pages, scratch_path(spark, "packages"), **how), with_payload=False)
