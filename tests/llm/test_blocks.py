"""Archives read by byte ranges, whatever their borders cut."""

import hashlib
import random

import pytest

from sheaf.llm import warc

COLUMNS = "page_id long, url string, html string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def read(spark, path, size):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    try:
        for k, v in zip(old, (size, "1", "1"), strict=True):
            spark.conf.set(k, v)
        return sorted((r.record_id, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def want(pages):
    return sorted((f"<urn:page:{i}>", len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in pages)


def test_plain_archives_need_no_second_reading(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    pages = [(i, "http://h/", f"{i} " + "é" * rng.randint(0, 700)) for i in range(300)]
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(pages, COLUMNS).coalesce(2), path)
    monkeypatch.setattr(warc, "emit_edges", None)
    assert read(spark, path, "9000") == want(pages) == read(spark, path, "128m")


@pytest.mark.parametrize("size", ["128m", "4000", "700"])
def test_magic_across_borders(spark, tmp_path, size):
    rng = random.Random(5)
    pages = []
    for i in range(150):
        body = rng.choice(["x" * rng.randint(0, 300), FAKE * rng.randint(1, 5) + "WARC/1.1\r\nzz", "WWARC/1.1\r\nContent-Length: 99999999\r\n\r\n" + "é" * 50, "WARC/1." + "a" * 100 + "WARC/1.", "y\r\n\r\n"])
        pages.append((i, "http://h/WARC/1.1 " + "b" * rng.randint(0, 40), str(i) + body))
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(pages, COLUMNS).coalesce(3), path)
    assert read(spark, path, size) == want(pages)


def test_headers_that_hold_magic(spark, tmp_path):
    (tmp_path / "warc").mkdir()
    record = lambda head, body: f"WARC/1.0\r\n{head}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    parts = [record("WARC-Record-ID: a\r\nX-Note: WARC/1.1\r\nWARC-Type: resource\r\n", "one"), record("WARC-Record-ID: b\r\nX: WARC/1.zWARC/1.0\r\n", "two WARC/1.0\r\n\r\n"), record("WARC-Record-ID: c\r\n", "")]
    (tmp_path / "warc" / "a").write_bytes(b"".join(parts))
    for size in ("128m", "50"):
        assert [x[:2] for x in read(spark, str(tmp_path / "warc"), size)] == [("a", 3), ("b", 16), ("c", 0)]
