"""Archives: round trips, revisits, and ZIP directories written by the standard library."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest

from stayrate.llm import warc as W

FOLDER = "/root/testdata/sf0.001"
NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def expected(rows):
    ids: dict[str, int] = {}
    sized = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        if len(data) >= 100 and page_id is not None:
            ids[digest] = min(page_id, ids.get(digest, page_id))
        sized.append((page_id, len(data), digest))
    out = []
    for page_id, size, digest in sized:
        first = ids.get(digest) if size >= 100 else None
        again = first is not None and page_id != first
        out.append((page_id, size, digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_pages(spark):
    df = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    got = W.archived(df)
    assert tuple(got.columns) == NAMES
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_equal_missing_and_odd_pages(spark):
    long_, other = "é" * 60, "x" * 100
    rows = [
        (5, "http://a b\nc", long_), (3, "http://é", long_), (9, None, long_), (4, "", "short"),
        (6, "", "short"), (7, "", None), (8, "", ""), (2, "u", other), (2, "u", other), (1, "u", other[:99]),
        (None, "u", other), (None, "u", "only here" * 20), (10, "u", "WARC/1.1\r\n\r\nPK\x05\x06" * 9),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = W.archived(df.selectExpr("*", "1 AS digest")).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
    assert W.archived(df.limit(0)).collect() == []


def test_small_archives_and_ranges(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"{i}" * 200) for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = W.write_archives(df, f"file://{tmp_path}/out", max_bytes=500)
    assert manifest.count() > 3
    index = W.read_index(manifest)
    assert index.count() == 50 and index.filter("length <= 0").count() == 0
    archive = manifest.first()["archive"].removeprefix("file://")
    with zipfile.ZipFile(archive) as file:
        assert file.testzip() is None
        assert {i.compress_type for i in file.infolist()} == {zipfile.ZIP_STORED}
    # A file that no manifest names, as a task that died leaves it, is not read.
    (tmp_path / "out" / "left.wacz").write_bytes(b"rubbish")
    assert W.read_records(index).count() == 50


def members(data: bytes):
    return {m.name: m for m in W.directory(pa.PythonFile(io.BytesIO(data), "r"))}


@pytest.mark.parametrize("prefix", [b"", b"junk in front"])
@pytest.mark.parametrize("comment", [b"", b"a PK\x05\x06 comment"])
def test_directory_of_plain_archives(prefix, comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("a/é.txt", b"first")
        with file.open(zipfile.ZipInfo("b"), "w", force_zip64=True) as member:
            member.write(b"second")
        file.writestr("c", b"x" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        file.comment = comment
    data = prefix + out.getvalue()
    found = members(data)
    assert list(found) == ["a/é.txt", "b", "c"]
    assert [found[n].method for n in found] == [0, 0, 8]
    for name, content in (("a/é.txt", b"first"), ("b", b"second")):
        m = found[name]
        assert data[m.offset : m.offset + m.size] == content


def test_zip64_directory():
    """All sizes and offsets moved to ZIP64 fields, as for archives beyond 4 GB."""
    content, name = b"payload", b"member"
    crc = zlib.crc32(content)
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, crc, 7, 7, len(name), 0) + name
    extra = struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    extra = struct.pack("<HH4s", 0x9999, 4, b"skip") + extra
    wide = 0xFFFFFFFF
    central = struct.pack(
        "<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, crc, wide, wide, len(name), len(extra),
        0, 0, 0, 0, wide,
    ) + name + extra
    start = len(local) + len(content)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, wide, wide, 0)
    data = local + content + central + end64 + locator + end
    (m,) = members(data).values()
    assert m == W.Member("member", 0, len(local), 7)
    assert zipfile.ZipFile(io.BytesIO(data)).read("member") == content


def test_damage_is_noticed():
    with pytest.raises(ValueError, match="central directory"):
        members(b"not an archive at all")
    good = W.record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None, "d")
    assert W.parse(good).payload_bytes == 200
    wrong = W.record(1, "u", b"x" * 200, "00", None, "d")
    with pytest.raises(ValueError, match="damaged"):
        W.parse(wrong)


def test_negative_ids_and_urls_with_line_separators(spark):
    page = "<p>" + "same " * 40
    rows = [(-5, "http://a/", page), (-4, "http://b/", page), (None, "http://c/", page)]
    rows += [(i, f"http://d/{c}x y", f"page {i}") for i, c in enumerate("\u0085\u2028\u2029\v\f\x1c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in W.archived(df).collect()}
    want = {(-5, "response", None), (-4, "revisit", -5), (None, "revisit", -5)}
    assert got == want | {(i, "response", None) for i in range(6)}
