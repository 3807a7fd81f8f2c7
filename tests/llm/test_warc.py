import gzip
import hashlib
import random

from pyarrow import fs
from pyspark.sql import functions as F

from ledgerlens.llm import warc

from .helpers import CLASHES


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASHES})


def _rows():
    rng = random.Random(3)
    large = "".join(rng.choice("abcdefghij\r\n<>é") for _ in range(700_000))
    same = "same " * 400
    return [(1, "http://a/x?y=%20z", same), (2, "http://a/\r\nInjected: 1", same), (9, None, same), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (7, "u", large), (8, "u", large), (10, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (None, "u", same), (11, "u", "x" * 1000), (12, "u", "x" * 1000), (13, "u", "y" * 999), (14, "u", "y" * 999),
            (15, "u", "é" * 500), (16, "u", "é" * 500), (9, None, same)]


def test_round_trip(spark):
    rows = _rows()
    manifest, folder = warc.write(_pages(spark, rows))
    chunks = warc.read(manifest, folder)
    got = sorted(map(tuple, warc.records(chunks).collect()), key=str)
    best = {}
    for p, _, h in rows:
        if p is not None and h is not None and len(h.encode()) >= 1000:
            best[h] = max(best.get(h, 0), p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        to = best.get(h) if p is not None and best.get(h, p) > p else None
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)
    assert sorted(str((r["page_id"], r["url"])) for r in chunks.where("last").collect()) == sorted(str(r[:2]) for r in rows)


def test_chunks_carry_running_digests(spark):
    rows = _rows()
    manifest, folder = warc.write(_pages(spark, rows))
    html = {p: (h or "").encode() for p, _, h in rows}
    got = {}
    for r in warc.read(manifest, folder).where("page_id in (8, 10, 4) and record_type = 'response'").orderBy("page_id", "chunk_no").collect():
        assert len(r["chunk"]) <= warc.CHUNK
        got[r["page_id"]] = got.get(r["page_id"], b"") + bytes(r["chunk"])
        assert r["bytes_so_far"] == len(got[r["page_id"]]) and r["sha1_so_far"] == hashlib.sha1(got[r["page_id"]]).hexdigest()
        assert r["last"] == (got[r["page_id"]] == html[r["page_id"]])
    assert got == {p: html[p] for p in (4, 8, 10)}


def test_archives_are_gzip_members_and_spoilt_ones_are_refused(spark):
    manifest, folder = warc.write(_pages(spark, [(1, "u", "abc" * 1000), (2, "u", "d")]).coalesce(1))
    rows = manifest.collect()
    store, _ = fs.FileSystem.from_uri(folder)
    assert sum(r["records"] for r in rows) == 2
    for r in rows:
        with store.open_input_stream(r["path"], compression=None) as f:
            plain = gzip.decompress(f.read())
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
        import io

        import pytest
        with pytest.raises(ValueError):
            list(warc.chunks_of(io.BufferedReader(io.BytesIO(plain.replace(b"abcabc", b"abcabd") if b"abcabc" in plain else plain[:-3]))))


def test_no_pages(spark):
    manifest, folder = warc.write(_pages(spark, []))
    assert warc.records(warc.read(manifest, folder)).count() == 0
