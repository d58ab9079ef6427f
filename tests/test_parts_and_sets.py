"""Components of URLs, sets of longs as tables, stored sketches."""

import random

import pytest
from pyspark.sql import functions as F

from arcspark.functions import url_parts
from arcspark.operators import long_sets


def one(spark, url, **columns):
    return spark.createDataFrame([(url,)], "u string").select(*(c.alias(n) for n, c in columns.items())).first()


def test_parts_and_spans(spark):
    u = F.col("u")
    url = "http://me:pw@Host.org:8080/a/b;x/c.html?k=v#top"
    r = one(spark, url, s=url_parts.spans(u), **{n: url_parts.part(u, n) for n in url_parts.NAMES})
    assert [r[n] for n in url_parts.NAMES] == ["http", "me:pw", "Host.org", "8080", "/a/b;x/c.html", "k=v", "top"]
    assert all(url[r.s[n].begin : r.s[n].begin + r.s[n].len] == r[n] for n in url_parts.NAMES)
    bare = one(spark, "http://h", s=url_parts.spans(u), p=url_parts.part(u, "path"), h=url_parts.part(u, "host"))
    assert bare.p is None and bare.h == "h" and bare.s.path is None and bare.s.host.begin == 7
    empty = one(spark, "http://h/?#", q=url_parts.part(u, "query"), r=url_parts.part(u, "ref"), s=url_parts.spans(u))
    assert (empty.q, empty.r, empty.s.query.len) == ("", "", 0)
    for bad in (None, "", "mailto:x@y", "no url"):
        r = one(spark, bad, s=url_parts.spans(u), h=url_parts.part(u, "host"), x=url_parts.replaced(u, host="a"), d=url_parts.domain_is(u, "a"), i=url_parts.host_is_ip(u))
        assert (r.s, r.h, r.x, r.d, r.i) == (None, None, None, False, False)


def test_replaced(spark):
    u = F.col("u")
    r = one(spark, "http://me@h:1/p?q#r", a=url_parts.replaced(u, user=None, port=None, query=None, ref=None, path=None), b=url_parts.replaced(u, path="x y", ref="", user="you"), c=url_parts.replaced(u))
    assert (r.a, r.b, r.c) == ("http://h/", "http://you@h:1/x y?q#", "http://me@h:1/p?q#r")
    for bad in ({"host": None}, {"scheme": None}, {"tail": "x"}):
        with pytest.raises(ValueError):
            url_parts.replaced(u, **bad)


def test_domains_and_addresses(spark):
    u = F.col("u")
    for url, domain, yes in (
        ("http://www.google.com/", "google.com", True), ("http://google.com/", "google.com", True), ("http://notgoogle.com/", "google.com", False), ("http://www.google.com/", ".google.com", True),
        ("http://google.com/", ".google.com", False), ("http://www.google.com./", "google.com", True), ("http://www.google.com/", "google.com.", False), ("http://www.google.com./", "google.com.", True), ("http://x/", "", False),
    ):
        assert one(spark, url, d=url_parts.domain_is(u, domain)).d is yes, (url, domain)
    for host, yes in (("1.2.3.4", True), ("255.255.255.255", True), ("256.1.1.1", False), ("1.2.3", False), ("[::1]", True), ("a.b", False), ("01.2.3.4", True)):
        assert one(spark, f"http://{host}/", i=url_parts.host_is_ip(u)).i is yes, host


def test_file_names_and_pairs(spark):
    u = F.col("u")
    for path, name in (("/", ""), ("/a", "a"), ("/a/b.txt", "b.txt"), ("/a/b;p=1", "b"), ("/a;x/b", "a"), ("/a/", ""), ("/a/b;c;d", "b;c"), ("/;x", "")):
        assert one(spark, f"http://h{path}", n=url_parts.file_name(u)).n == name, path
    for query, pairs in (("", []), ("a", [("a", "")]), ("a=1&b=2", [("a", "1"), ("b", "2")]), ("a&&b=", [("a", ""), ("", ""), ("b", "")]), ("a=1&", [("a", "1")]), ("=x=y", [("", "x=y")])):
        assert [tuple(p) for p in one(spark, f"http://h/?{query}", p=url_parts.query_pairs(u)).p] == pairs, query
    assert one(spark, "http://h/", p=url_parts.query_pairs(u)).p is None


def test_long_sets(spark):
    rng = random.Random(2)
    spread = [0, 1, -1, 32767, 32768, -32768, 2**62, -(2**63), 2**63 - 1]
    a = [(k, rng.choice(spread) if i % 3 else rng.randrange(100_000)) for i in range(400) for k in "xy"]
    b = [(k, rng.choice(spread) if i % 3 else rng.randrange(100_000)) for i in range(400) for k in "yz"]
    kind, keys = "k string, v long", ("k",)
    sa, sb = (long_sets.long_set(spark.createDataFrame([*r, *r[:50], ("x", None)], kind).repartition(3), "v", keys) for r in (a, b))
    got = lambda s: sorted((r.k, r.value) for r in long_sets.members(s, keys).collect())
    assert got(sa) == sorted(set(a)) and got(long_sets.union(sa, sb, keys=keys)) == sorted(set(a) | set(b)) and got(long_sets.intersection(sa, sb, keys)) == sorted(set(a) & set(b))
    assert {r.k: r.n for r in long_sets.cardinality(sa, keys).collect()} == {k: len({v for c, v in a if c == k}) for k in "xy"}
    asked = [(k, v, 1) for k in "xyz" for v in [*spread, 5, 99_999, None]]
    for blocks in (4096, 0):
        long_sets.BROADCAST_BLOCKS, keep = blocks, long_sets.BROADCAST_BLOCKS
        try:
            found = long_sets.contains(spark.createDataFrame(asked, "k string, v long, bits int"), "v", sa, keys).collect()
        finally:
            long_sets.BROADCAST_BLOCKS = keep
        assert len(found) == len(asked) and all(r.there is (None if r.v is None else (r.k, r.v) in set(a)) for r in found)
    none = long_sets.long_set(spark.createDataFrame([], "v long"), "v")
    assert long_sets.members(none).count() == 0 and long_sets.contains(spark.createDataFrame([(1,)], "v long"), "v", none).first().there is False


def test_sparse_long_sets_are_small(spark):
    """Numbers far apart take a few bytes each, not a whole bitmap."""
    rows = spark.range(2000).select((F.col("id") * 1000003 - 50000000).alias("v"))
    s = long_sets.long_set(rows, "v")
    size = F.octet_length("bits") if dict(s.dtypes)["bits"] == "binary" else F.lit(8)
    assert s.count() <= 2000 and s.agg(F.sum(size)).first()[0] <= 64 * 2000
    assert long_sets.members(s).agg(F.sum("value")).first()[0] == sum(i * 1000003 - 50000000 for i in range(2000))
