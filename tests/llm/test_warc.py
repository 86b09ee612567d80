import hashlib
import io
import re
import zlib

import pytest

from touchline.llm.common import new_path
from touchline.llm import warc

BODY = "x" * 150
PAGES = [(1, "http://a b", BODY), (2, None, BODY), (2, None, BODY), (3, "u", None), (4, "u", ""), (5, "u", "s" * 99), (6, "u", "s" * 99), (None, "u", BODY), (2**60 + 1, "u", "é" * 60), (7, "u", "WARC/1.1\r\n" * 30)]
SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.round_trip(df).collect())
    want = []
    for p, _, html in PAGES:
        raw = (html or "").encode()
        revisit = html == BODY and p not in (1, None)
        want.append((str(p), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", "1" if revisit else "None"))
    assert got == sorted(want)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("compress", (True, False))
def test_archives_hold_the_payloads(spark, compress):
    df = spark.createDataFrame(PAGES, SCHEMA)
    path = new_path(spark, "warc-test")
    manifest = warc.write_archives(df, path, compress=compress, max_file_bytes=2000)
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    rows = warc.read_archives(spark, manifest, path).collect()
    assert all(r.reason is None for r in rows)
    assert sorted(bytes(r.payload) for r in rows if r.record_type == "response") == sorted((h or "").encode() for p, _, h in PAGES if h != BODY or p in (1, None))


def _records(n=30):
    out = []
    for i in range(n):
        body = b"payload %d " % i * 40
        out.append(warc.record(i, f"u{i}", body, hashlib.sha256(body).hexdigest(), None))
    return out


def _gzip(x):
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(x) + c.flush()


@pytest.mark.parametrize("pack", (_gzip, lambda x: x), ids=("gzip", "plain"))
def test_salvage(pack):
    parts = [pack(r) for r in _records()]
    at = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    data = bytearray(b"".join(parts))
    for i in (0, 7, 8):
        data[at[i + 1] - 20] ^= 0x55
    data = bytes(data[: at[20]]) + b"junk WARC/1.x \x1f\x8b\x08 junk" + bytes(data[at[20] : at[-1] - 9])
    out = list(warc.salvage(io.BytesIO(data)))
    good = [f["page_id"] for _, _, reason, f in out if reason is None]
    assert good == [i for i in range(29) if i not in (0, 7, 8)]
    gaps = [(a, b) for a, b, reason, _ in out if reason]
    assert gaps[0] == (0, at[1]) and gaps[1] == (at[7], at[9]) and gaps[2][0] == at[20] and gaps[-1][1] == len(data)
    spans = sorted((a, b) for a, b, *_ in out)
    assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_salvage_of_rubbish():
    assert list(warc.salvage(io.BytesIO(b""))) == []
    assert [(a, b) for a, b, *_ in warc.salvage(io.BytesIO(b"\x00" * (3 << 20)))] == [(0, 3 << 20)]


def test_version_line_at_the_end_of_a_chunk():
    good = _records(1)[0]
    for pad in range(warc.CHUNK - 12, warc.CHUNK + 3):
        rows = list(warc.salvage(io.BytesIO(b"\x00" * pad + good)))
        assert [(a, b, bool(r)) for a, b, r, _ in rows] == [(0, pad, True), (pad, pad + len(good), False)]


def test_long_header_and_wrong_length(monkeypatch):
    body = b"p" * 10
    long = warc.record(1, "u" * (2 << 20), body, hashlib.sha256(body).hexdigest(), None)
    assert [r for *_, r, f in warc.salvage(io.BytesIO(long))] == [None]
    monkeypatch.setattr(warc, "RECORD_MAX", 4 << 20)
    bad = re.sub(rb"\r\nContent-Length: ", b"\r\nContent-Length: 99999", _records(1)[0], count=1) + _gzip(b"0" * (64 << 20)) + _records(2)[1]
    assert [f["page_id"] for *_, r, f in warc.salvage(io.BytesIO(bad)) if r is None] == [1]


def test_a_lost_record_is_an_error(spark, monkeypatch):
    keep = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **k: keep(*a, **k).where("page_id <> 3 or page_id is null"))
    with pytest.raises(ValueError, match="not read back whole"):
        warc.round_trip(spark.createDataFrame(PAGES, SCHEMA))


@pytest.mark.parametrize("pack", (_gzip, lambda x: x), ids=("gzip", "plain"))
@pytest.mark.parametrize("chunk", (1, 2, 3, 7, 64, 997))
def test_records_may_begin_anywhere_in_a_chunk(monkeypatch, pack, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    rows = list(warc.salvage(io.BytesIO(b"".join(pack(r) for r in _records(12)))))
    assert [f["page_id"] for *_, r, f in rows if r is None] == list(range(12)) and len(rows) == 12
