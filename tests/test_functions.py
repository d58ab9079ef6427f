"""Scalar functions against known values and identities."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from arcspark.functions import charsets, codec, dom, domain, hashing, http, net, text, url
from arcspark.functions.session_ids import strip_session_id
from arcspark.operators import aggregates


def test_rabin_identities():
    assert hashing.rabin_bytes(b"") & (1 << 64) - 1 == hashing.POLYNOMIALS[64]
    rng = random.Random(1)
    for _ in range(50):
        v = rng.getrandbits(64)
        assert int(hashing.rabin_longs(np.asarray([v], np.uint64)).view(np.int64)[0]) == hashing.rabin_bytes(v.to_bytes(8, "little"))
    for degree in (24, 32, 40):
        assert hashing.rabin_bytes(b"some text", degree) & ((1 << (64 - degree)) - 1) == 0
    # linear: fp(a) ^ fp(b) ^ fp(a xor b) = fp(zeros) for equal lengths
    a, b = rng.randbytes(20), rng.randbytes(20)
    both = bytes(x ^ y for x, y in zip(a, b, strict=True))
    assert hashing.rabin_bytes(a) ^ hashing.rabin_bytes(b) ^ hashing.rabin_bytes(both) == hashing.rabin_bytes(bytes(20))


def test_checksums():
    assert hashing.crc16(b"123456789") == 0xBB3D
    assert hashing.string_hash("hello") == 99162322
    assert hashing.bytes_hash(b"hello") == 99162322
    assert hashing.bytes_hash(b"\xff") == -1
    assert hashing.murmur2(b"") == 0
    # lengths with 0, 1, 2 and 3 bytes left over
    assert [hashing.murmur2(b"abcdefg"[:n]) for n in (6, 7)] == [-1641135381, -14544559]
    rng = random.Random(2)
    data = [rng.randbytes(rng.randrange(40)) for _ in range(200)]
    assert hashing.murmur2_many(data).view(np.int32).tolist() == [hashing.murmur2(x) for x in data]
    assert hashing.murmur2_many(data, 77).view(np.int32).tolist() == [hashing.murmur2(x, 77) for x in data]
    assert hashing.rabin_many(data).tolist() == [hashing.rabin_bytes(x) for x in data] and hashing.rabin_many([]).tolist() == []
    for x in data:
        h = g = 0
        for b in x:
            h, g = (31 * h + (b - 256 if b > 127 else b)) & 0xFFFFFFFF, (31 * g + b) & 0xFFFFFFFF
        assert (hashing.bytes_hash(x) & 0xFFFFFFFF, hashing.string_hash(x.decode("latin-1")) & 0xFFFFFFFF) == (h, g)
    assert hashing.crc16_many(data).tolist() == [hashing.crc16(x) for x in data]


CANONICAL = [
    ("HTTP://www.Foo.com:80/a/../b;x?q=1#f", "http://foo.com/b?q=1"),
    ("http://foo.com/%7Euser/%41", "http://foo.com/~user/A"),
    ("https://[::1]/", "https://[::1]/"),
    ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://Goo goo.com/", None),
    ("http://foo.com\\a\\b", "http://foo.com/a/b"),
    ("http://foo.com.", "http://foo.com/"),
    ("http://a.b.com/c/./d/..", "http://a.b.com/c/"),
    ("http://u:p@h.com:8080/", "http://u:p@h.com:8080/"),
    ("https://x.com:443/", "https://x.com/"),
    ("http://foo.com/a;jsessionid=1?b", "http://foo.com/a?b"),
    (" \thttp://fo\no.com/ ", "http://foo.com/"),
    ("zoo://x", None),
    ("no url", None),
    (None, None),
]


@pytest.mark.parametrize("given,wanted", CANONICAL)
def test_canonical_url(given, wanted):
    assert url.canonicalize(given, True) == wanted


def test_fingerprint():
    assert url.fingerprint("http://www.example.com/") == url.fingerprint("http://example.com/#x")
    assert url.fingerprint("http://nowhere/") is None


SESSIONS = [
    ("http://a.com/x?PHPSESSID=" + "0a" * 16 + "&b=1", "http://a.com/x&b=1"),
    ("http://a.com/sessions/" + "0a" * 16 + "/x", "http://a.com/x"),
    ("http://a.com/x;$sessionid$ABC", "http://a.com/x"),
    ("http://a.com/x;jsessionid=QQ?y=1", "http://a.com/x?y=1"),
    ("http://a.com/x--session_id.123--.html", "http://a.com/x--.html"),
    ("http://a.com/p-oscsid-" + "0a" * 16 + ".html", "http://a.com/p.html"),
    ("http://a.com/x?sid=" + "z9" * 13, "http://a.com/x"),
    ("http://a.com/x?sid=abc", "http://a.com/x?sid=abc"),
]


@pytest.mark.parametrize("given,wanted", SESSIONS)
def test_session_ids(given, wanted):
    assert strip_session_id(given) == wanted


@pytest.mark.parametrize(
    "host,root,tld",
    [("www.example.com", "example.com", "com"), ("a.b.co.uk", "b.co.uk", "co.uk"), ("com", None, None), ("www.ck", "www.ck", "ck"), ("x.y.ck", "x.y.ck", "y.ck"),
     ("a.city.kobe.jp", "city.kobe.jp", "kobe.jp"), ("1.2.3.4", "1.2.3.4", "inaddr-arpa.arpa"), ("Foo.com", None, None), ("x.unknown", None, None)],
)
def test_domains(host, root, tld):
    assert (domain.root_domain(host), domain.tld(host)) == (root, tld)


@pytest.mark.parametrize(
    "shown,millis",
    [("Sat, 15-Apr-17 21:01:22 GMT", 1492290082000), ("Thu, 19-Apr-2007 16:00:00 GMT", 1176998400000), ("Wed, 25 Apr 2007 21:02:13 GMT", 1177534933000), ("Thu, 19/Apr\\2007 16:00:00 GMT", 1176998400000),
     ("Fri, 1 Jan 2010 01:01:50 GMT", 1262307710000), ("", -1), ("tomorrow", -1), ("1 Jan 2007 25:00:00", -1)],
)
def test_http_dates(shown, millis):
    assert http.parse_http_date(shown) == millis


def test_content_type():
    assert http.parse_content_type("text/html; charset='x'") == ("text/html", "x")
    assert http.parse_content_type("*/*") == (None, None)


@pytest.mark.parametrize(
    "shown,codec_name,wanted",
    [("日本語のテキストです。これはテスト", "shift_jis", "Shift_JIS"), ("日本語のテキストです。これはテスト", "euc_jp", "EUC-JP"), ("日本語", "iso2022_jp", "ISO-2022-JP"), ("한국어 텍스트입니다 안녕하세요", "euc_kr", "EUC-KR"),
     ("这是一个中文文本的例子我们", "gb2312", "GB2312"), ("這是一個中文文本的例子我們", "big5", "Big5"), ("déjà vu à la carte", "cp1252", "windows-1252"), ("héllo", "utf-8", "UTF-8"), ("plain", "ascii", "ASCII")],
)
def test_detected_charsets(shown, codec_name, wanted):
    assert http.detect_charset(shown.encode(codec_name)) == wanted


def test_charsets_that_are_not_known():
    assert http.charset_codec("x-euc-tw") is None and http.charset_codec("ISO-2022-CN") is None and http.charset_codec("Shift-JIS") == "cp932"
    for name, codec_name in {"CP-1251": "cp1251", "x-windows-1250": "cp1250", "IBM-850": "cp850", "ISO-8859-15": "iso8859-15", "csISOLatin2": "iso8859-2", "l5": "iso8859-9", "x-mac-cyrillic": "mac-cyrillic", "KOI8-R": "koi8-r", "euc-cn": "gb2312", "'utf-8'": "utf-8", "ISO-2022-JP-2": "iso2022_jp_2", "no such": None}.items():
        assert http.charset_codec(name) == codec_name, name
    late = b"a" * 20_000 + "é".encode()
    assert http.detect_charset(late) == "UTF-8" and http.detect_charset(late, 16_000) == "ASCII"


def test_decode():
    page = "<META http-equiv='Content-Type' content='text/html; charset=windows-1251'>привет".encode("cp1251")
    assert http.decode_best_effort(page, "utf-8")[1] == "cp1251"
    assert http.sniff_meta(b'<meta charset="utf-8">') is None


def test_codecs():
    extremes = [0, 1, -1, (1 << 63) - 1, (1 << 63) - 2, -(1 << 63) + 1, -(1 << 63)]
    data, _, n = codec.rice_encode(extremes, 62)
    assert codec.rice_decode(data, n, 62) == extremes
    rng = random.Random(3)
    for m in (0, 1, 5, 20):
        values = [rng.randrange(-(8 << m), 8 << m) for _ in range(50)]
        packed, n_bits, n = codec.rice_encode(values, m)
        bits = codec.Bits(packed, n_bits)
        assert codec.rice_decode(packed, n, m) == values and [bits.get(0), n] == [int(values[0] < 0), 50]
        assert codec.rice_decode(codec.rice_encode([abs(v) for v in values], m, False)[0], n, m, False) == [abs(v) for v in values]
    for v in (0, 127, -112, 128, -113, (1 << 63) - 1, -(1 << 63)):
        assert codec.vlong_decode(codec.vlong_encode(v)) == (v, len(codec.vlong_encode(v)))
    assert codec.split_escaped(codec.join_escaped(["a,b", "", "c\\d"])) == ["a,b", "", "c\\d"]
    for bad in ("a,b", "a\\", "a\\x"):
        with pytest.raises(ValueError):
            codec.unescape(bad)
    for kind in ({}, {"url_safe": True}, {"compress": True}, {"lines": True}):
        assert codec.base64_decode(codec.base64_encode(bytes(range(256)), **kind)) == bytes(range(256))
    assert codec.base64_decode(codec.base64_encode(b"\xfb\xff\0", ordered=True), ordered=True) == b"\xfb\xff\0"
    import gzip

    packed = gzip.compress(b"x" * 5000)
    assert codec.gunzip_best_effort(packed, 100) == (b"x" * 100, True)
    assert codec.gunzip_best_effort(packed) == (b"x" * 5000, False)
    assert codec.parse_long(b"-7f", 16) == -127
    with pytest.raises(ValueError):
        codec.parse_long(b"9" * 30)
    assert "48 69" in codec.hex_dump(b"Hi")


def test_simhash_and_bloom_parts():
    assert text.simhash_text("abc") == 0
    near = bin((text.simhash_text("the quick brown fox jumps over the lazy dog") ^ text.simhash_text("the quick brown fox jumps over the lazy cat")) & (1 << 64) - 1).count("1")
    far = bin((text.simhash_text("the quick brown fox jumps over the lazy dog") ^ text.simhash_text("0123456789 completely different words here")) & (1 << 64) - 1).count("1")
    assert near < far
    assert aggregates.bloom_bits(10, 10) == 128
    assert len(aggregates.bloom_cells(b"x", 5, 128)) == 5
    assert aggregates.buckets_and_k(0.5) == (2, 1)


def test_net_and_dom():
    assert net.ipv4_bytes("1.2.3.4") == bytes([1, 2, 3, 4]) and net.ipv4_bytes("1.256") == bytes([1, 0, 1, 0]) and net.ipv4_bytes("1.2.3.256") is None
    assert net.path_for_id(123456789) == "23/45/67/123456789" and net.path_for_id(7) == "0/0/0/7"
    assert [r[3] for r in dom.walk("<p>a<br>b</p>")] == ["p", None, "br", None]
    assert [r[3] for r in dom.walk("<script>x<b></script><i>", "script")] == ["script", "i"]


def stepped(automaton, data: bytes):
    """The automaton byte by byte: mean weight, or -1."""
    if automaton.before is not None:
        data = data.replace(bytes([automaton.before]), b"")
    i, halves, weights = 0, 0, []
    while i < len(data):
        a = data[i]
        if automaton.first[a]:
            if i + 1 == len(data):
                break
            if not automaton.valid[a, data[i + 1]]:
                return -1.0
            halves += automaton.half is not None and bool(automaton.half[data[i + 1]])
            weights.append(automaton.weights[a, data[i + 1]])
            i += 2
            continue
        if a >= 0x80:
            if not automaton.alone[a]:
                return -1.0
            weights.append(automaton.alone_weight)
        i += 1
    return sum(weights) / len(weights) if weights and halves % 2 == 0 else -1.0


def test_automata_against_stepping(monkeypatch):
    rng = random.Random(9)
    texts = [bytes(rng.choice([0x20, 0x41, 0x7A, rng.randrange(0x81, 0xFF), rng.randrange(0xA1, 0xFF)]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts += ["日本語テキスト".encode(c) * 3 + b"a" for c in ("cp932", "euc_jp", "gb18030")] + ["丂".encode("gb18030"), "€ 㐂".encode("gb18030"), "丂丄".encode("euc_jp", "ignore"), b""]
    for automaton, got in zip(charsets.AUTOMATA, charsets.scores_of(texts), strict=True):
        want = [stepped(automaton, t) for t in texts]
        assert np.allclose(got, want) and (got > 0).any(), automaton.name
    whole = charsets.double_byte(texts)
    monkeypatch.setattr(charsets, "BYTES_AT_ONCE", 50)
    assert charsets.double_byte(texts) == whole and charsets.double_byte([]) == []


def test_charsets_of_many_contents():
    contents = [None, b"", b"plain", "日本語のテキスト".encode("cp932"), "ä".encode(), "à la carte".encode("cp1252"), "日本語のテキスト".encode("euc_jp"), "한국어".encode("euc_kr")]
    assert http.detect_charsets(contents) == [None, None, "ASCII", "Shift_JIS", "UTF-8", "windows-1252", "EUC-JP", "EUC-KR"]
    assert [http.decode_best_effort(c, None)[0] for c in contents[2:]] == ["plain", "日本語のテキスト", "ä", "à la carte", "日本語のテキスト", "한국어"]
    assert http.decode_all([None, b"x"], ["utf-8", "no such"]) == [(None, None), ("x", "ascii")]


def test_charset_detection_takes_little_memory():
    """What the automata take besides the texts does not grow with a batch."""
    texts = ["日本語のテキスト".encode("shift_jis") * 60] * 4000
    charsets.double_byte(texts[:10])
    tracemalloc.start()
    try:
        found = charsets.double_byte(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(found) == {"Shift_JIS"} and peak < 64 << 20


def test_decoding_holds_few_contents():
    """Of a batch of 40 MB only some contents are Python objects at a time."""
    contents = pa.array(["é".encode("utf-8") + b"x" * 10_000] * 4000, pa.binary())
    said = pa.array(["utf-8", None] * 2000, pa.string())
    tracemalloc.start()
    try:
        found = http.decode_arrays(contents, said)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 4000 and set(found.field("charset").to_pylist()) == {"utf-8"} and peak < 10 << 20
    assert found[3].as_py()["text"] == "é" + "x" * 10_000 and len(http.decode_arrays(contents[:0], said[:0])) == 0
