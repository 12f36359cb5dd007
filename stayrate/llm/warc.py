"""ZIP-packaged web archives: written by Spark tasks, read back by ranges without extraction.

Each page becomes a WARC record in a gzip member of its own. A task packs its records into archives
of about ``max_bytes``: ZIP files whose members are stored, ``archive/data.warc.gz`` with the
records and ``indexes/index.cdxj`` with the place of each. The reader looks up the end of central
directory (ZIP64 too), walks the central directory, reads the index, and then only the byte ranges
of the records.

Among pages with equal payloads of at least ``min_payload`` bytes the one with the smallest id is a
``response``, all others are ``revisit`` records that refer to it and carry no payload. Shorter
payloads are always responses. Rows that repeat the smallest id are all responses; a page without id
is never referred to, and refers like others where an equal payload has an id. Html null is an empty
payload, url null leaves the target out. Other columns are ignored. Ids are whole numbers.

A task that is run again writes new files; only archives named in the manifest, which Spark commits,
are read. Files are opened by ``pyarrow.fs``, so the folder may be any store it knows by its URI.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.shared import new_path, small_batches, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ID = "urn:stayrate:page:"
NO_ID = "none:"  # begins the record names of pages without id
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_roles(pages: DataFrame, min_payload: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): ``refers_to`` is set for revisits."""
    pages = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn(
        "digest", F.sha2("html", 256)
    )
    first = (
        pages.filter(f"octet_length(html) >= {min_payload}")
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    return pages.join(first, "digest", "left").selectExpr(
        "page_id",
        "url",
        "html",
        "digest",
        "CASE WHEN page_id IS NULL OR page_id <> first THEN first END AS refers_to",
    )


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC record as a gzip member."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    name = f"{NO_ID}{uuid.uuid5(uuid.NAMESPACE_URL, digest)}" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID}{name}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        target = url.replace("\r", "%0D").replace("\n", "%0A")
        fields.append(("WARC-Target-URI", target))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{ID}{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=3, mtime=0)


class Parsed(NamedTuple):
    kind: str
    name: str
    payload_bytes: int
    digest: str
    refers_to: str | None


def parse(member: bytes) -> Parsed:
    """What a record says; the payload of a response is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(
        int(line.split(b":")[1])
        for line in http.split(b"\r\n")
        if line.lower().startswith(b"content-length:")
    )
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    refers_to = fields.get("WARC-Refers-To")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    cut = slice(len(ID) + 1, -1)
    return Parsed(
        fields["WARC-Type"],
        fields["WARC-Record-ID"][cut],
        size,
        digest,
        refers_to[cut] if refers_to else None,
    )


def pack(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP archive of (url, gzip member) records and their index."""
    index, offset = [], 0
    for url, member in records:
        index.append((url, offset, len(member)))
        offset += len(member)
    lines = [
        f"{url} {json.dumps({'offset': at, 'length': size})}\n" for url, at, size in sorted(index)
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
        with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
            for _, member in records:
                data.write(member)
        archive.writestr(zipfile.ZipInfo(INDEX), "".join(lines))
    return out.getvalue()


class Member(NamedTuple):
    """A member of a ZIP archive: its content lies at ``offset``, ``size`` bytes as stored."""

    name: str
    method: int
    offset: int
    size: int


def directory(file: pa.NativeFile) -> list[Member]:
    """The members named in the central directory, whose header may be ZIP64.

    Reads the end of the file, the directory and one local header per member.
    """
    total = file.size()
    tail_at = max(0, total - 65_557)
    tail = file.read_at(total - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = tail_at + at
    if end >= 20:
        locator = file.read_at(20, end - 20)
        if locator[:4] == b"PK\x06\x07":
            end = struct.unpack("<Q", locator[8:16])[0]
            wide = file.read_at(56, end)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 directory")
            entries, size, start = struct.unpack("<QQQ", wide[32:56])
    shift = end - size - start  # bytes put in front of the archive
    content = file.read_at(size, start + shift)
    members, at = [], 0
    for _ in range(entries):
        if content[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        (method,) = struct.unpack("<H", content[at + 10 : at + 12])
        packed, plain, n, extra, comment = struct.unpack("<IIHHH", content[at + 20 : at + 34])
        (local,) = struct.unpack("<I", content[at + 42 : at + 46])
        name = content[at + 46 : at + 46 + n].decode()
        fields = content[at + 46 + n : at + 46 + n + extra]
        at += 46 + n + extra + comment
        while len(fields) >= 4:
            kind, length = struct.unpack("<HH", fields[:4])
            if kind == 1:
                # Only the values that do not fit their usual place are given, in this order.
                wide = iter(struct.unpack(f"<{length // 8}Q", fields[4 : 4 + length // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            fields = fields[4 + length :]
        header = file.read_at(30, local + shift)
        if header[:4] != b"PK\x03\x04":
            raise ValueError(f"damaged header of {name}")
        skip = sum(struct.unpack("<HH", header[26:30]))
        members.append(Member(name, method, local + shift + 30 + skip, packed))
    return members


def write_archives(
    pages: DataFrame,
    folder: str,
    min_payload: int = 100,
    max_bytes: int = 32 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest (archive, records, bytes)."""
    small_batches(pages.sparkSession)
    rows = with_roles(
        pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html"), min_payload
    )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        records: list[tuple[str, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            content = pack(records)
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(content)
            row = [[f"{folder}/{name}"], [len(records)], [len(content)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in row], names=["archive", "records", "bytes"]
            )

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                member = record(page_id, url, html.encode(), digest, refers_to, date)
                key = (url or "-").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
                records.append((key, member))
                size += len(member)
                if size >= max_bytes:
                    yield flush()
                    records, size = [], 0
        if records:
            yield flush()

    return written(
        rows.mapInArrow(save, "archive string, records bigint, bytes bigint"), "warc-manifest"
    )


def read_index(manifest: DataFrame) -> DataFrame:
    """(archive, url, offset, length): where each record lies in its archive file."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = pa.fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as file:
                    members = {m.name: m for m in directory(file)}
                    if any(members[name].method != 0 for name in (DATA, INDEX)):
                        raise ValueError(f"{uri}: members must be stored, not compressed")
                    index = file.read_at(members[INDEX].size, members[INDEX].offset).decode()
                rows = []
                for line in index.split("\n")[:-1]:
                    url, place = line.split(" ", 1)
                    place = json.loads(place)
                    rows.append((uri, url, members[DATA].offset + place["offset"], place["length"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*rows)], names=["archive", "url", "offset", "length"]
                )

    schema = "archive string, url string, offset bigint, length bigint"
    # One archive a task: the manifest is a few rows in few files.
    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("archive").repartition(tasks).mapInArrow(look_up, schema)


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one range at a time."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            found = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != uri:
                    if file is not None:
                        file.close()
                    store, path = pa.fs.FileSystem.from_uri(archive)
                    uri, file = archive, store.open_input_file(path)
                found.append(parse(file.read_at(length, offset)))
            names = [None if p.name.startswith(NO_ID) else int(p.name) for p in found]
            refers = [int(p.refers_to) if p.refers_to else None for p in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.int64()),
                    pa.array([p.payload_bytes for p in found], pa.int64()),
                    pa.array([p.digest for p in found], pa.string()),
                    pa.array([p.kind for p in found], pa.string()),
                    pa.array(refers, pa.int64()),
                ],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )
        if file is not None:
            file.close()

    return index.select("archive", "offset", "length").mapInArrow(
        fetch,
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string,"
        " refers_to bigint",
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back."""
    manifest = write_archives(pages, new_path(pages.sparkSession, "warc"))
    return read_records(read_index(manifest))
