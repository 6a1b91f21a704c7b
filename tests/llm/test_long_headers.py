"""Archives whose headers are long, and chains that break."""

import hashlib
import time

import pytest

from sheaf.llm import warc

COLUMNS = "page_id long, url string, html string"


def test_long_urls_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "warc")
    pages = [(i, "http://x/" + "a b" * (40_000 if i % 3 == 1 else 1), f"page {i} " + "WARC/1.1\r\n" * i) for i in range(9)]
    warc.write_archives(spark.createDataFrame(pages, COLUMNS).coalesce(1), path)
    out = {r.record_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect()}
    assert out == {f"<urn:page:{i}>": (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, _, t in pages}


@pytest.mark.parametrize("cut", [1, 40, 10_000])
def test_a_broken_chain_raises(spark, tmp_path, cut):
    path = tmp_path / "warc"
    warc.write_archives(spark.createDataFrame([(i, "u", f"page {i}") for i in range(3)], COLUMNS).coalesce(1), str(path))
    data = next(path.glob("part-*")).read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a").write_bytes(data[:-cut] or data[5:])
    with pytest.raises(Exception, match="chain of records|no record"):
        warc.read_archives(spark, str(tmp_path / "cut")).collect()


def test_crowded_magic_is_read_once():
    start = time.time()
    assert warc.candidates(b"WARC/1.1\r\n" * 30_000 + b"Content-Length: 3\r\n\r\nabc\r\n\r\n")[0][:2] == (0, 300_028)
    assert time.time() - start < 30
