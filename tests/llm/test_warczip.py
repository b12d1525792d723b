"""Packages of others, ids of any characters, archives of many records."""

import gzip
import io
import time
import zipfile
import zlib

import pytest

from sourceloom.llm import warczip


def plain_record(kind, ident, payload):
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: {ident}\r\nWARC-Target-URI: http://a/\r\ncontent-length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


RECORDS = [plain_record("warcinfo", "<urn:uuid:0>", b"software")] + [plain_record("response", f"<urn:uuid:{i}>", b"p\r\n\r\n" * i) for i in range(1, 6)]


def manifest(spark, path):
    return spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")


@pytest.mark.parametrize("name", ["archive/a.warc.gz", "archive/a.warc"])
@pytest.mark.parametrize("slice_bytes", [7, 1 << 20])
def test_package_by_another_writer(spark, tmp_path, monkeypatch, name, slice_bytes):
    monkeypatch.setattr(warczip, "SLICE_BYTES", slice_bytes)
    data = b"".join(map(gzip.compress, RECORDS)) if name.endswith("gz") else b"".join(RECORDS)
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as package:
        package.writestr("datapackage.json", "{}")
        package.writestr(name, data)
    told = warczip.read_packages(manifest(spark, tmp_path / "x.wacz")).collect()
    assert sorted((r["page"], bytes(r["payload"])) for r in told) == [(f"urn:uuid:{i}", b"p\r\n\r\n" * i) for i in range(1, 6)]


def test_compressed_member_is_refused():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("archive/a.warc.gz", b"x" * 100)
    data = buffer.getvalue()
    with pytest.raises(ValueError, match="compressed inside"):
        list(warczip.record_ranges(lambda at, n: data[at : at + n], len(data)))


def test_ids_and_repeated_rows(spark, tmp_path):
    ids = ["a\r\nb", "null", "", "100%", "<x> y", "é ", "null", None, None]
    rows = [(i, "u", f"page {n}", 7, "clash") for n, i in enumerate(ids)] + [("t", "u", "same", 7, "c")] * 2 + [("s", "u", "same", 7, "c")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, digest int, same string")
    for minimum in (0, 10_000):
        told = warczip.read_packages(warczip.write_packages(pages, str(tmp_path / str(minimum)), min_bytes=minimum)).collect()
        assert sorted(str((r["page"], r["payload_bytes"])) for r in told) == sorted(str((r[0], len(r[2]))) for r in rows)
        types = sorted((r["page"], r["record_type"], r["refers_to"]) for r in told if r["page"] in ("s", "t"))
        first = [("s", "revisit", "t")] if minimum == 0 else [("s", "response", None)]
        assert types == first + [("t", "response", None)] * 2


def test_query_on_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warczip.read_packages(warczip.write_packages(none, str(tmp_path))).count() == 0


def test_many_records_take_linear_time():
    one = warczip.record("1", "u", b"x" * 40, 40, "D", None)
    times = []
    for n in (4000, 16_000):
        data = one * n
        read = lambda at, size, data=data: data[at : at + size]
        for lengths in ([len(one)] * n, None):
            begin = time.perf_counter()
            assert sum(1 for _ in warczip.members_of(read, 0, len(data), lengths)) == n
            times.append(time.perf_counter() - begin)
    assert times[2] < 12 * times[0] + 0.2 and times[3] < 12 * times[1] + 0.2
    assert zlib.decompress(one, 31).startswith(b"WARC/1.1")
