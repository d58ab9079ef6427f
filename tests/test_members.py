"""Archives: round trips, odd terminators, damage, split packing."""

import io
import random
import zlib

import pytest

from arcspark.sources import members as m


def archive(n=50, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = "http://foo/ " + "".join(rng.choice("abcxyz09é") for _ in range(rng.randint(5, 99)))
        head = [(None, "HTTP/1.1 200 OK"), ("test", "test-value"), ("x-cc-test-header-1", "v" * rng.randint(1, 99))]
        rows.append((url, "1.2.3.4", f"202401010000{i % 60:02d}", "text/html", head, rng.randbytes(rng.randint(0, 3000))))
    return rows, m.file_header("0.arc.gz", "20240101000000") + b"".join(m.record_member(*r) for r in rows)


class OneByte(io.BytesIO):
    def read(self, n=-1):
        return super().read(1)


@pytest.mark.parametrize("stream", [io.BytesIO, OneByte])
def test_round_trip(stream):
    rows, data = archive()
    found = list(m.records(stream(data)))
    assert len(found) == len(rows)
    for row, r in zip(rows, found, strict=True):
        assert (r.url, r.host_ip, r.ts14, r.mime_type, r.headers, r.content) == row
        assert m.gzip_member and zlib.decompress(data[r.pos : r.pos + r.size], 31).startswith(row[0].encode())
        assert r.flags == 0


def test_value_begins_with_own_headers():
    _, data = archive(1)
    value = next(m.records(io.BytesIO(data))).value()
    assert value.startswith(f"{m.PREFIX}{m.HOST_IP}:1.2.3.4\r\n{m.PREFIX}{m.TIMESTAMP}:20240101000000\r\n{m.PREFIX}{m.MIME_TYPE}:text/html\r\nHTTP/1.1 200 OK\r\n".encode())


@pytest.mark.parametrize("end", [b"\n\n", b"\n\r\n", b"\r\n\r\n"])
def test_terminators(end):
    body = b"A:b" + end + b"payload"
    data = f"http://x/ 1.1.1.1 20240101000000 text/plain {len(body)}\n".encode() + body + b"\n"
    assert m.parse_record(data).content == b"payload"


def test_short_and_long_payloads():
    head = b"A:b\r\n\r\n"
    short = m.parse_record(b"http://x/ 1.1.1.1 20240101000000 text/plain 100\n" + head + b"abc")
    assert (short.content, short.flags) == (b"abc", 1)
    long = m.parse_record(b"http://x/ 1.1.1.1 20240101000000 text/plain %d\n" % (len(head) + 2) + head + b"abc")
    assert (long.content, long.flags) == (b"ab", 0)


def test_metadata_line_with_spaces_and_fallback():
    assert m.parse_metadata("http://a b/ c 1.2.3.4 20240101000000 text/html 5")[0] == "http://a b/ c"
    assert m.parse_metadata("http://x/ not-an-ip 2024 text/html 5") == ("http://x/", "not-an-ip", "2024", "text/html", 5)
    with pytest.raises(m.ArcError):
        m.parse_metadata("http://a b/ 1.2.3.4 20240101000000 text/html 5", legacy=True)
    with pytest.raises(m.ArcError):
        m.parse_metadata("nothing")


def test_damage():
    _, data = archive(3)
    assert len(list(m.records(io.BytesIO(data + b"\x1f\x8b\x08")))) == 3
    with pytest.raises(m.TruncatedHeader):
        list(m.records(io.BytesIO(data + b"\x1f\x8b\x08"), mode="FAILFAST"))
    with pytest.raises(m.ArcError, match="GZIP"):
        list(m.records(io.BytesIO(data + b"plain text here")))
    bad = bytearray(data)
    bad[-6] ^= 1
    with pytest.raises(m.ArcError, match="trailer"):
        list(m.records(io.BytesIO(bytes(bad))))
    assert len(list(m.records(io.BytesIO(bytes(bad)), mode="DROPMALFORMED"))) == 2
    with pytest.raises(m.ArcError, match="File Header"):
        list(m.records(io.BytesIO(m.gzip_member(b"x" * 5000))))


def test_split_packing():
    assert m.pack_splits([1, 1, 1]) == [[0], [1], [2]]
    assert m.pack_splits([1, 1, 1], 2) == [[0, 1], [2]]
    assert m.pack_splits([5, 6, 1, 9], 100, 10) == [[0, 1], [2, 3]]
    assert m.pack_splits([]) == []


def test_members_past_a_bound_are_cut():
    _, data = archive(3)
    whole = list(m.records(io.BytesIO(data)))
    cut = list(m.records(io.BytesIO(data), most=600))
    assert [r.url for r in cut] == [r.url for r in whole] and all(r.content == w.content[: len(r.content)] for r, w in zip(cut, whole, strict=True))
    assert [bool(r.flags & m.CUT_BY_BOUND) for r in cut] == [len(r.content) < len(w.content) or bool(r.flags & 2) for r, w in zip(cut, whole, strict=True)]
    assert any(r.flags & m.CUT_BY_BOUND for r in cut)


def test_truncation_header():
    head = b"X-Any-ContentTruncated:true\r\n\r\n"
    assert m.parse_record(b"http://x/ 1.1.1.1 20240101000000 text/plain %d\n" % (len(head) + 3) + head + b"abc").flags == m.CUT_SHORT
