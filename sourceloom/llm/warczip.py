"""WARC records in ZIP packages: written per task, read by ranges without extraction.

A package stores a compressed WARC file and its index uncompressed, so that a record is
a range of the package: the central directory (ZIP64 or not) gives the place of the
members, the index that of the records. Packages are opened with pyarrow file systems on
the executors; they lie in a folder that all of them share.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import stored, table
from sourceloom.operators.sizing import broadcast_if_small
from sourceloom.session import cut_lineage, scratch_dir

ARCHIVE_BYTES = 32 << 20  # compressed records per package
RANGE_BYTES = 4 << 20  # records read together
SLICE_BYTES = 1 << 20  # of an archive without an index, read at a time
DATE = "1970-01-01T00:00:00Z"  # of records whose source has none
_MAX32 = 0xFFFFFFFF


def opened(path: str):
    """(file system, path inside it) of an absolute path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- records ---------------------------------------------------------------------


def record(page: str | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """One compressed WARC record; a revisit has the HTTP head of the payload but not the payload.

    Ids are percent-encoded, so that those of any characters come back; a null id is no id.
    """
    named = lambda i: "<urn:page>" if i is None else f"<urn:page:{quote(i, safe='')}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {named(page)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: {named(refers_to)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def parsed(data: bytes) -> dict | None:
    """Fields of an uncompressed record; the payload is None for a revisit.

    None for records of other types, which hold no page.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^Content-Length: *(\d+)", http)

    def bare(name: str) -> str | None:
        value = fields.get(name)
        if value is None or value == "<urn:page>":
            return None
        return unquote(value[len("<urn:page:") : -1]) if value.startswith("<urn:page:") else value.strip("<>")

    revisit = kind == "revisit"
    return {
        "page": bare("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": bare("warc-refers-to"),
        "payload": None if revisit else payload,
        "payload_bytes": (int(told[1]) if told else None) if revisit else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "sha1:").removeprefix("sha1:") or None if revisit else base32_sha1(payload),
    }


def members_of(read, at: int, size: int, lengths: list[int] | None = None) -> Iterator[bytes]:
    """The records of a range, uncompressed; ``read(offset, length)`` reads a part of the file.

    With the lengths of its records the range is read at once and cut. Without, it is read in
    slices: as compressed members one after the other, or, where it does not start like one,
    as plain records.
    """
    if lengths is not None:
        data, begin = memoryview(read(at, size)), 0
        for length in lengths:
            yield zlib.decompress(data[begin : begin + length], 31)
            begin += length
        return
    slices = (read(at + i, min(SLICE_BYTES, size - i)) for i in range(0, size, SLICE_BYTES))
    first = next(slices, b"")
    whole = itertools.chain([first], slices)
    yield from unpacked(whole) if first[:2] == b"\x1f\x8b" else plain_records(whole)


def unpacked(slices: Iterator[bytes]) -> Iterator[bytes]:
    """Compressed members of any size, in slices that are cut anywhere."""
    unpacker, parts = zlib.decompressobj(31), []
    for data in slices:
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []


def plain_records(slices: Iterator[bytes]) -> Iterator[bytes]:
    """Records that are not compressed: a head with the length of the block, and the block."""
    held = bytearray()
    wanted = 0
    for data in slices:
        held += data
        while len(held) >= wanted:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                wanted = len(held) + 1
                break
            length = re.search(rb"(?im)^Content-Length: *(\d+)", bytes(held[:end]))
            if not length:
                raise ValueError("a WARC record has no length")
            wanted = end + 4 + int(length[1]) + 4
            if len(held) < wanted:
                break
            yield bytes(held[:wanted])
            del held[:wanted]
            wanted = 0


# -- packages ---------------------------------------------------------------------


def package(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP file that stores the members as they are, with ZIP64 directories on demand."""
    out, entries = bytearray(), []
    for name, data in members:
        place, crc, coded = len(out), zlib.crc32(data), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if zip64 else b""
        size = _MAX32 if zip64 else len(data)
        out += struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x800, 0, 0, 33, crc, size, size, len(coded), len(extra)) + coded + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), place) if zip64 else b""
        at = _MAX32 if zip64 else place
        entries.append(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x800, 0, 0, 33, crc, size, size, len(coded), len(extra), 0, 0, 0, 0, at) + coded + extra)
    start, directory = len(out), b"".join(entries)
    out += directory
    if zip64:
        end = len(out)
        out += struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, len(entries), len(entries), len(directory), start)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        out += struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, _MAX32, _MAX32, 0)
    else:
        out += struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(entries), len(entries), len(directory), start, 0)
    return bytes(out)


def directory_of(read, size: int) -> list[dict]:
    """Entries of the central directory; ``read(offset, length)`` reads a range of the file."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("not a ZIP file")
    n, length, start = struct.unpack_from("<H2I", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        end = read(struct.unpack_from("<Q", tail, at - 12)[0], 56)
        n, length, start = struct.unpack_from("<3Q", end, 32)
    data, entries, at = read(start, length), [], 0
    for _ in range(n):
        method, = struct.unpack_from("<H", data, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<2I3H", data, at + 20)
        place, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n_name].decode()
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, size_ = struct.unpack_from("<2H", extra)
            if kind == 1:  # holds, in this order, the fields that do not fit
                wide = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, 4))
                plain = next(wide) if plain == _MAX32 else plain
                packed = next(wide) if packed == _MAX32 else packed
                place = next(wide) if place == _MAX32 else place
            extra = extra[4 + size_ :]
        entries.append({"name": name, "method": method, "size": packed, "header": place})
        at += 46 + n_name + n_extra + n_comment
    return entries


def data_start(read, entry: dict) -> int:
    """Where a member's bytes start: after its local header, whose extra field is its own."""
    n_name, n_extra = struct.unpack_from("<2H", read(entry["header"], 30), 26)
    return entry["header"] + 30 + n_name + n_extra


def record_ranges(read, size: int) -> Iterator[tuple[int, int, list[int] | None]]:
    """(offset, length, record lengths) of the stored archives of a package, in ranges of some
    megabytes; an archive without an index is one range, with lengths None. A member that is
    compressed inside the package raises ValueError: it has no ranges to read."""
    entries = directory_of(read, size)
    indexes = {e["name"].rpartition("/")[2].removesuffix(".cdx"): e for e in entries if e["name"].startswith("indexes/")}
    for entry in entries:
        if not entry["name"].startswith("archive/"):
            continue
        if entry["method"]:
            raise ValueError(f"{entry['name']} is compressed inside the package")
        start, index = data_start(read, entry), indexes.get(entry["name"].rpartition("/")[2])
        if index is None or index["method"]:
            yield start, entry["size"], None
            continue
        lines = read(data_start(read, index), index["size"]).decode().split("\n")
        at, lengths = None, []
        for line in filter(None, lines):
            offset, length = map(int, line.rsplit(" ", 2)[1:])
            if lengths and (offset != at + sum(lengths) or sum(lengths) >= RANGE_BYTES):
                yield start + at, sum(lengths), lengths
                at, lengths = offset, []
            at = offset if at is None else at
            lengths.append(length)
        if lengths:
            yield start + at, sum(lengths), lengths


# -- jobs ---------------------------------------------------------------------------


def deduplicated(pages: DataFrame, page_id: str, html: str, url: str | None, min_bytes: int) -> DataFrame:
    """(page, url, payload, payload_bytes, refers_to): the payload is null where the record
    revisits another, the one with the largest id among equal payloads."""
    none = F.lit("")
    rows = pages.select(
        F.col(page_id).alias("id"),
        (F.coalesce(F.col(url).cast("string"), none) if url else none).alias("url"),
        F.coalesce(F.col(html).cast("string"), none).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # Payloads with equal SHA-1 are known; equal SHA-256 and lengths make them the same.
    same = F.sha2("payload", 256)
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(same.alias("same"), "payload_bytes").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    repeated = cut_lineage(groups.where((F.col("n") > 1) & F.col("first").isNotNull()).select("same", "first"))
    # Only the few keys of repeated payloads move, as long as they are few.
    judged = rows.withColumn("same", same).join(broadcast_if_small(repeated), "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.col("payload_bytes") >= min_bytes)
    return judged.select(
        F.col("id").cast("string").alias("page"),
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "digest",
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
    )


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", html: str = "html", url: str | None = "url", min_bytes: int = 0, zip64: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to packages in ``folder``; returns their manifest (path, bytes, records).

    A task writes one or more packages under names of its own. Only those of tasks that
    ended well are in the manifest, so a repeated task leaves nothing that is read.
    Null pages are empty. Of rows with equal payloads and the largest id, repeated rows
    included, all are responses. Other columns are not looked at; no rows, no packages.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)

        def flush():
            name = f"part-{uuid.uuid4().hex}.wacz"
            index = "\n".join(f"{page} {at} {size}" for page, at, size in lines)
            with system.open_output_stream(f"{root}/{name}") as out:
                data = package([("archive/data.warc.gz", bytes(body)), ("indexes/data.warc.gz.cdx", index.encode())], zip64)
                out.write(data)
            return pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [len(data)], "records": [len(lines)]})

        body, lines = bytearray(), []
        for frame in frames:
            for row in frame.itertuples(index=False):
                digest = base64.b32encode(bytes.fromhex(row.digest)).decode()
                coded = record(row.page, row.url, row.payload, row.payload_bytes, digest, row.refers_to)
                lines.append((quote(row.page or "", safe="") or "-", len(body), len(coded)))
                body += coded
                if len(body) >= archive_bytes:
                    yield flush()
                    body, lines = bytearray(), []
        if lines:
            yield flush()

    rows = deduplicated(pages, page_id, html, url, min_bytes)
    return stored(rows.mapInPandas(run, "path string, bytes long, records long"), "manifest")


def read_packages(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the packages of a manifest (path, bytes): page, url, record_type, refers_to,
    payload_bytes, payload_digest, and on demand the payload, null for revisits.

    Packages of others are read as well, if their archives are stored: with an index in
    ranges, without one from end to end in slices, compressed record by record or plain. Ids
    of other forms come without their angle brackets; records that are no responses or
    revisits are passed over."""

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                system, inner = opened(path)
                with system.open_input_file(inner) as file:
                    read = lambda at, n, file=file: file.read_at(n, at)
                    found = list(record_ranges(read, file.size()))
                yield pd.DataFrame({"path": path, "at": [f[0] for f in found], "bytes": [f[1] for f in found], "lengths": [f[2] for f in found]})

    columns = ["page", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payload
    schema = "page string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payload

    def read_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                system, inner = opened(row.path)
                with system.open_input_file(inner) as file:
                    read = lambda at, n, file=file: file.read_at(n, at)
                    lengths = None if row.lengths is None else [int(n) for n in row.lengths]
                    held, size = [], 0
                    for told in filter(None, map(parsed, members_of(read, row.at, row.bytes, lengths))):
                        held.append(told)
                        size += len(told["payload"] or b"")
                        if size > RANGE_BYTES:
                            yield pd.DataFrame(held, columns=columns)
                            held, size = [], 0
                    yield pd.DataFrame(held, columns=columns)

    ranges = manifest.select("path").mapInPandas(locate, "path string, at long, bytes long, lengths array<long>")
    # As many tasks as the bytes call for; the rows alone would look too small to spread.
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    return ranges.repartition(max(1, total // RANGE_BYTES), "path", "at").mapInPandas(read_ranges, schema)


def op3_zip_packages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    manifest = write_packages(pages, scratch_dir(spark, "packages"))
    told = read_packages(manifest, payload=False)
    return told.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


# Five hex digits make four letters of base 32.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, CAST(5 * g + 1 AS INTEGER), 5))::INTEGER >> b) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
