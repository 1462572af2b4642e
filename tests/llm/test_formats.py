import gzip
import hashlib
import io
import zlib

import pytest

from trialspark.llm import matroska as mkv
from trialspark.llm import warc
from trialspark.llm._session import fresh_path

SF = "/root/testdata/sf0.001"


def test_records_round_trip():
    raw = warc.record("response", "urn:page:1", "http://a/\r\nb", b"\r\n\r\npayload\0", "d") + warc.record("revisit", "urn:page:2", None, b"12345", "e", "urn:page:1")
    one, two = warc.records(io.BytesIO(raw))
    assert one.error is None and one.http[1] == b"\r\n\r\npayload\0" and one.headers["warc-target-uri"] == "http://a/ b"
    assert two.http == ({"content-type": "text/html; charset=utf-8", "content-length": "5"}, b"") and two.headers["warc-refers-to"] == "<urn:page:1>"
    assert two.offset == one.length and one.offset == 0 and one.length + two.length == len(raw)
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_damaged_archives():
    raw = warc.record("response", "urn:page:1", None, b"x" * 999, "d")
    assert [r.error for r in warc.records(io.BytesIO(raw[:-9]))] == ["ends inside a member"]
    assert "not gzip" in [r.error for r in warc.records(io.BytesIO(raw + b"junk"))][1]
    wrong = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = wrong.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n") + wrong.flush()
    assert [r.error for r in warc.records(io.BytesIO(data))] == ["Content-Length and record differ"]
    assert list(warc.records(io.BytesIO(b""))) == []


def test_archive_and_read(spark):
    long, other = "é" * 60, "y" * 100
    rows = [(5, "u", long), (3, None, long), (9, "v", long), (3, "w", long), (None, "n", long), (4, "u", None), (6, "u", ""), (7, "s", "short"), (8, "s", "short"), (10, "o", other)]
    pages = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, digest string")
    made = warc.archive(pages, fresh_path(spark, "warc"))
    got = warc.read(made).collect()
    assert len(got) == len(rows) == made.agg({"records": "sum"}).first()[0] and all(r.error is None for r in got)
    kinds = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id is not None)
    assert kinds == [(3, "response", None, 120), (3, "response", None, 120), (4, "response", None, 0), (5, "revisit", 3, 120), (6, "response", None, 0), (7, "response", None, 5), (8, "response", None, 5), (9, "revisit", 3, 120), (10, "response", None, 100)]
    assert {r.payload_digest for r in got if r.payload_bytes == 120} == {hashlib.sha256(long.encode()).hexdigest()}
    assert warc.read(warc.archive(pages.limit(0), fresh_path(spark, "warc"))).count() == 0


@pytest.mark.parametrize("size", [0, 1, 64, 512, 513, 4096, 4100, 131072, 300001])
def test_mux_and_parse(size):
    payload = mkv.padded(bytes(i * 7 % 251 for i in range(size)))
    assert len(payload) % 64 == 0 and payload
    data = mkv.mux(payload)
    assert data == mkv.mux(payload)
    got = mkv.parse(data)
    assert b"".join(data[a : a + n] for _, _, a, n, _, _ in got.packets) == payload
    assert [p[1] for p in got.packets] == [k * 64_000_000 for k in range(len(got.packets))]
    assert got.tracks[1]["codec"] == "A_PCM/INT/LIT" and got.duration == len(payload) / 8
    # each cue leads to a cluster
    assert len(got.cues) == len({p[5] for p in got.packets})
    assert all(int.from_bytes(data[c : c + 4], "big") == mkv.CLUSTER for _, _, c in got.cues)


def test_lacing_and_unknown_sizes():
    frames = [b"a" * 300, b"bb", b"c" * 5]
    xiph = bytes([2, 255, 45, 2]) + b"".join(frames)
    flag, ebml = mkv._lace(frames)
    assert flag == 0x06
    for kind, data in ((0x02, xiph), (0x06, ebml)):
        assert [data[a : a + n] for a, n in mkv.laced(data, 0, len(data), kind)] == frames
    group = mkv._element(mkv.BLOCK_GROUP, mkv._element(mkv.BLOCK, b"\x82\x00\x05\x02" + xiph) + mkv._uint(mkv.REFERENCE_BLOCK, 1))
    cluster = mkv._id(mkv.CLUSTER) + b"\x01" + b"\xff" * 7 + mkv._uint(mkv.TIMESTAMP, 10) + group
    data = mkv._HEAD + mkv._id(mkv.SEGMENT) + b"\xff" + cluster + cluster
    got = mkv.parse(data)
    assert [(p[0], p[1], p[3], p[4]) for p in got.packets] == [(2, 15_000_000, n, False) for n in (300, 2, 5)] * 2


def test_media_rows(spark):
    docs = spark.createDataFrame([(1, "héllo", "m"), (2, None, "m"), (3, "", "m"), (4, "x" * 5000, "m")], "doc_id long, text string, media string")
    media = mkv.to_media(docs)
    got = {r.doc_id: r for r in mkv.features(media).collect()}
    assert got[2].payload_sha256 == got[3].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and got[2].feature == got[3].feature
    assert got[1].n_bytes == 6 and got[1].payload_bytes == 64 and got[1].tail_crc32 == zlib.crc32(mkv.padded("héllo".encode()))
    rows = mkv.packets(media).where("doc_id = 4").collect()
    assert [r.length for r in rows] == [512] * 9 + [5056 - 9 * 512] and rows[0].error is None
    broken = media.selectExpr("doc_id", "substring(media, 1, 60) as media", "1 as track")
    assert {(r.track, r.error is None) for r in mkv.packets(broken).collect()} == {(None, False)}
    assert mkv.to_media(docs.limit(0)).count() == 0 and mkv.packets(media.limit(0)).count() == 0


def test_matroska_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in mkv.query(spark, SF).collect():
        p = mkv.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        data = mkv.mux(p)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
