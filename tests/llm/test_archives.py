from __future__ import annotations

import base64
import hashlib
import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barrelbook.llm import archives
from barrelbook.session import scratch_path


def directory(data: bytes) -> archives.ZipDirectory:
    return archives.ZipDirectory(len(data), lambda at, size: data[at : at + size])


@pytest.mark.parametrize("comment", [b"", b"a PK\5\6 comment" + b"x" * 30])
@pytest.mark.parametrize("large", [False, True])
def test_directory_finds_stored_members(comment, large, monkeypatch):
    if large:  # every offset, size and count beyond these limits is written as ZIP64
        for limit in ("ZIP64_LIMIT", "ZIP_FILECOUNT_LIMIT"):
            monkeypatch.setattr(zipfile, limit, 1)
    out, members = io.BytesIO(), {"a.txt": b"one", "ü/b.bin": os.urandom(3_000), "empty": b""}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        package.comment = comment
        for name, data in members.items():
            with package.open(name, "w", force_zip64=large) as file:
                file.write(data)
        package.writestr("packed", b"z" * 1_000, zipfile.ZIP_DEFLATED)
    found = directory(out.getvalue())
    assert set(found.members) == {*members, "packed"}
    assert {n: found.read(n) for n in members} == members
    with pytest.raises(ValueError, match="not stored"):
        found.read("packed")
    if large:
        assert b"PK\6\6" in out.getvalue()


def test_broken_files_are_refused():
    for data in (b"", b"PK", b"x" * 100, b"PK\5\6" + b"\xff" * 18):
        with pytest.raises(ValueError):
            directory(data)


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def brute(rows, least=0):
    payloads = {}
    for i, _, html in rows:
        data = (html or "").encode()
        payloads.setdefault(data, []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in payloads[data] if x is not None]
        first = min(ids, default=None)
        response = len(data) < least or i == first
        out.append(
            (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first)
        )
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=str)


def some_pages():
    rng = random.Random(4)
    rows = [(i, f"http://h.org/{i}\r\nX: y", "<p>" + "ä\r\n\r\n" * rng.randrange(40)) for i in range(120)]
    rows += [(200, None, None), (201, "", ""), (None, "u", "only here"), (None, "v", rows[7][2]), (3, "again", rows[3][2])]
    rows += [(202, "long", "x" * 2_000_000), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    return rows


@pytest.mark.parametrize("least", [0, 50])
def test_round_trip(spark, least):
    rows = some_pages()
    frame = spark.createDataFrame(rows, PAGES).repartition(3)
    frame = frame.withColumns({n: F.lit(1) for n in ("sha1", "first", "payload", "again", "path", "n")})
    found = archives.round_trip(frame, revisit_bytes=least, package_bytes=2_000)
    assert rows_of(found) == brute(rows, least)


def test_payloads_come_back(spark):
    rows = some_pages()
    frame = spark.createDataFrame(rows, PAGES)
    packages = archives.write_packages(frame, scratch_path(spark, "test-packages"))
    found = archives.read_packages(spark, packages)
    payloads = {r.payload_digest: bytes(r.payload) for r in found.collect() if r.payload is not None}
    for _, _, html in rows:
        data = (html or "").encode()
        assert payloads[archives.digest_of(data)] == data
    assert packages.agg(F.sum("records")).first()[0] == len(rows)


def test_urls_with_other_ends_of_lines(spark):
    urls = [f"http://h.org/a{c}b/\u00e4" for c in "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"]
    rows = [(i, url, f"<p>{i}") for i, url in enumerate(urls)]
    frame = spark.createDataFrame(rows, PAGES)
    found = archives.read_packages(spark, archives.write_packages(frame, scratch_path(spark, "test-lines")))
    written = sorted((r.page_id, r.url) for r in found.collect())
    assert [i for i, _ in written] == list(range(len(rows)))
    assert all(len(url.splitlines()) == 1 and url.endswith("b/\u00e4") for _, url in written)
    assert rows_of(archives.round_trip(frame)) == brute(rows)


def test_index_lines_end_only_at_line_feeds(spark, monkeypatch):
    """Packages of other writers may hold such characters as they are."""
    monkeypatch.setattr(archives, "_line", lambda value: value)
    rows = [{"page_id": 1, "url": "http://h.org/a\u2028b", "payload": b"x", "sha1": hashlib.sha1(b"x").hexdigest(), "is_response": True}]
    package, path = archives._Package(), f"{scratch_path(spark, 'test-index')}/a.wacz"
    package.add(rows[0])
    package.write(path)
    (found,) = archives.read_packages(spark, spark.createDataFrame([(path,)], "path string")).collect()
    assert (found.page_id, found.url) == (1, "http://h.org/a\u2028b")


def test_empty_table(spark):
    assert archives.round_trip(spark.createDataFrame([], PAGES)).collect() == []
