"""Web archives in ZIP packages: writing, and reading records by range without extraction.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``
(one gzip member per WARC record) and ``indexes/index.cdxj`` (a line per record
with its place). The reader finds the end-of-central-directory record, follows
ZIP64 records, lists the members, reads the index, and then fetches each record
with one range read at (start of the stored member + offset in it).

Files are opened through ``pyarrow.fs`` with the folder's own scheme, so any
shared store that it knows can hold packages. A task writes under names of its
own; a package counts once its name is in the stored manifest, so a lost or
repeated task leaves nothing but an unread file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin, scratch_path
from .joins import lookup

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
PLACE = "path string, offset long, length long"
RECORD = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
          "payload binary, intact boolean")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# ---- writing


def _header(value) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def _record(page_id, url, html: bytes, digest: str, refers_to, date: str) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def package(records: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """ZIP bytes of (index key, gzip record) pairs."""
    lines, at = [], 0
    for key, data in records:
        lines.append(f"{key} {json.dumps({'filename': 'data.warc.gz', 'offset': at, 'length': len(data)})}")
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, parts in ((WARC_MEMBER, [d for _, d in records]), (INDEX_MEMBER, ["\n".join(sorted(lines)).encode()])):
            with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as member:
                for p in parts:
                    member.write(p)
    return out.getvalue()


def with_revisits(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of ``least_bytes`` or more the smallest id is kept whole."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    rows = rows.withColumn("d1", part(1)).withColumn("d2", part(16))
    large = F.octet_length("html") >= least_bytes
    firsts = rows.filter(large).groupBy("d1", "d2").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = lookup(rows, firsts, ["d1", "d2"], "left")
    again = large & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, least_bytes: int = 100, package_bytes: int = 32 << 20,
                   date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a WARC record per row and returns the stored manifest (path, bytes, records).

    ``folder`` is shared by all executors (default: a new one below the folder in
    spark.checkpoint.dir). Null html is an empty payload. Rows that share both the
    smallest id and the payload are all whole. No rows, no packages.
    """
    where = (folder or scratch_path(pages.sparkSession, "warc")).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal store, held, size
            data, path = package(held), f"{where}/{uuid.uuid4().hex}.wacz"
            if store is None:
                store = filesystem(where)
                store[0].create_dir(store[1], recursive=True)
            with store[0].open_output_stream(f"{store[1]}/{path.rsplit('/', 1)[1]}") as f:
                f.write(data)
            out = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)]), pa.array([len(held)])], ["path", "bytes", "records"])
            held, size = [], 0
            return out

        for b in batches:
            for r in b.to_pylist():
                data = _record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["digest"], r["refers_to"], date)
                held.append((f"{_header(r['url'] or '-').replace(' ', '%20')} {date.replace('-', '')}", data))
                size += len(data)
                if size >= package_bytes:
                    yield flush()
        if held:
            yield flush()

    return pin(with_revisits(pages, least_bytes, id_col, url_col, html_col).mapInArrow(write, MANIFEST))


# ---- reading


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    offset: int  # of the member's first data byte in the package
    size: int


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) < n:
        raise ValueError(f"package ends at {at + len(data)}, {n} bytes wanted at {at}")
    return data


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """Size, packed size and offset with those that are all ones taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, k = extra[at + 4: at + 4 + n], 0
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    values[i] = struct.unpack_from("<Q", body, k)[0]
                    k += 8
        at += 4 + n
    return values


def members(f, size: int) -> list[Member]:
    """Members of a ZIP package by its central directory; ``f`` is an open seekable file of ``size`` bytes."""
    tail_at = max(0, size - 65557)
    tail = _read(f, tail_at, size - tail_at)
    k = tail.rfind(EOCD)
    while k >= 0 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail):  # the signature may occur in the comment
        k = tail.rfind(EOCD, 0, k)
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    at64 = tail_at + k - 20
    if at64 >= 0 and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
        locator = _read(f, at64, 20)
        if locator[:4] == LOCATOR64:
            record = _read(f, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != EOCD64:
                raise ValueError("damaged ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = _read(f, start, length), 0, []
    for _ in range(count):
        if directory[at: at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        local, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46: at + 46 + n].decode()
        plain, packed, local = _zip64(directory[at + 46 + n: at + 46 + n + extra], [plain, packed, local])
        head = _read(f, local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        a, b = struct.unpack_from("<HH", head, 26)
        found.append(Member(name, method, local + 30 + a + b, packed))
        at += 46 + n + extra + comment
    return found


def located(f, size: int, path: str = "") -> list[tuple[int, int]]:
    """(offset, length) in the package of every record that its indexes list, by offset.

    Indexes are the stored members ``indexes/*.cdxj`` and ``*.cdx``, plain or with
    ``.gz``; each line names its archive member, with or without ``archive/``.
    """
    stored = {m.name: m for m in members(f, size)}
    spots = []
    for name, index in stored.items():
        if not name.startswith("indexes/") or not name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
            continue
        if index.method:
            raise ValueError(f"{path}: {name} has to be stored")
        body = _read(f, index.offset, index.size)
        body = gzip.decompress(body) if name.endswith(".gz") else body
        for line in body.split(b"\n"):
            if not line.strip() or line.startswith(b"!"):  # header lines
                continue
            r = json.loads(line.split(b" ", 2)[2])
            data = stored.get(r["filename"]) or stored.get(f"archive/{r['filename']}")
            if data is None or data.method:
                raise ValueError(f"{path}: {name} names {r['filename']}, which is no stored member")
            spots.append((data.offset + int(r["offset"]), int(r["length"])))
    return sorted(set(spots))


def places(manifest: DataFrame) -> DataFrame:
    """(path, offset, length) of every record in the packages of ``manifest`` (column path), from their indexes. Runs a count."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    spots = located(f, f.size(), path)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(spots), pa.string()), pa.array([o for o, _ in spots], pa.int64()),
                    pa.array([n for _, n in spots], pa.int64())], ["path", "offset", "length"])
    many = max(1, min(manifest.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path").repartition(many, "path").mapInArrow(locate, PLACE)


def parse_record(data: bytes) -> dict:
    """One gzip WARC record; ``intact`` says that a response's payload has the digest its header names."""
    head, _, block = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    told = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    whole = kind == "response"
    number = lambda k: int(fields[k]) if k in fields else None
    digest = hashlib.sha256(payload).hexdigest() if whole else named
    return {"page_id": number("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": len(payload) if whole else told,
            "payload_digest": digest, "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload if whole else None,
            "intact": not whole or (digest == named and len(payload) == told)}


def read_records(spots: DataFrame, with_payload: bool = True, task_bytes: int = 64 << 20) -> DataFrame:
    """A row per place: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits), intact.

    The places are stored first; a task reads about ``task_bytes`` of packages.
    """
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, path, f = [], 0, None, None
            try:
                for r in b.to_pylist():
                    if r["path"] != path:
                        if f is not None:
                            f.close()
                        path = r["path"]
                        fs, name = filesystem(path)
                        f = fs.open_input_file(name)
                    row = parse_record(_read(f, r["offset"], r["length"]))
                    size += row["payload_bytes"]
                    held.append(row if with_payload else row | {"payload": None})
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=shape)
                        held, size = [], 0
            finally:
                if f is not None:
                    f.close()
            yield pa.RecordBatch.from_pylist(held, schema=shape)
    shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])
    # An exchange of its own: no task runs two Python steps. Its size follows the packages' bytes, not those of the places.
    spots = pin(spots)
    total, packages = spots.agg(F.coalesce(F.sum("length"), F.lit(0)), F.approx_count_distinct("path")).first()
    least = min(packages, spots.sparkSession.sparkContext.defaultParallelism)
    near = spots.repartition(max(1, least, -(-total // task_bytes)), "path").sortWithinPartitions("path", "offset")
    return near.mapInArrow(fetch, RECORD)
