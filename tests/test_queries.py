"""Every registered archive query against its SQL, and pieces that SQL can't say."""

import gzip
import os
import random
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arcspark import queries as q
from arcspark.functions import domain, hashing, text, url
from arcspark.operators import aggregates, near_duplicates, ordering
from arcspark.plans.job import Job
from arcspark.plans.archive_query import ArchiveQuery, Controller, SortOrder, create, missing_parts, progress
from arcspark.sources.arc import is_archive, read_arc, write_arc

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cur = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall())


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def slow_rabin(data: bytes) -> int:
    """Bit by bit."""
    poly = f = hashing.start_of(64)
    for b in data:
        f ^= b
        for _ in range(8):
            f = f >> 1 ^ (poly if f & 1 else 0)
    return f


def slow_simhash(content: str) -> int:
    grams = {content[i : i + 4] for i in range(len(content) - 3)}
    prints = [slow_rabin(g.encode("utf-16-be")) for g in grams]
    value = sum(1 << i for i in range(64) if 2 * sum(p >> i & 1 for p in prints) > len(prints))
    return value - (1 << 64) if value >> 63 else value


def test_simhash_against_bits(spark):
    texts = [(1, "the quick brown fox"), (2, "abc"), (3, "äöü ßxyz äöü"), (4, "aaaaaaaa"), (5, None)]
    got = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", text.simhash("text").alias("h"))
    # the first step of a fingerprint of eight bytes folds the start in: the bulk form must agree
    assert rows_of(got.where("h IS NOT NULL"), "doc_id", "h") == [(i, slow_simhash(t) if len(t) >= 4 else 0) for i, t in texts if t]


def test_near_dup_pairs_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for b in base for _ in range(6)] + base[:5]
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    least = {}
    for i, v in rows:
        least.setdefault(v, i)
    want = sorted((a, b, bin((v ^ w) & (1 << 64) - 1).count("1")) for v, a in least.items() for w, b in least.items() if a < b and bin((v ^ w) & (1 << 64) - 1).count("1") <= 3)
    for tile, blocks in ((2048, None), (2, 6)):
        monkeypatch.setattr(near_duplicates, "A_TILE", tile)
        if blocks:
            monkeypatch.setattr(near_duplicates, "blocks_for", lambda n, distance: blocks)
        found = near_duplicates.simhash_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", 3)
        assert rows_of(found, "a", "b", "distance") == want and want
    classes = near_duplicates.simhash_classes(spark.createDataFrame(rows, "id long, h long"), "id", "h")
    assert all(r.class_id == least[r.h] for r in classes.collect())


def test_fingerprints_of_urls(spark):
    """Each name's hash alone, where the query hashes a batch's names together."""
    pages = {p.page_id: p.url for p in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in q.url_fingerprint(spark, DATA).collect():
        domain_name, known, root = url._names(pages[r.page_id])
        assert r.fp64 == hashing.rabin_text(pages[r.page_id]) and known == url.canonicalize(pages[r.page_id], True)
        assert (r.domain_hash, r.url_hash, r.root_domain_hash) == tuple(map(hashing.rabin_text, (domain_name, known, root)))
    odd = ["http://nowhere/", None, "", "http://ü.example.com/ä", "http://example.com"]
    assert [x and x[0] for x in url.fingerprints(odd)] == [x and hashing.rabin_text(x[0]) for x in map(url._names, odd)] and url.fingerprints([]) == []


def test_hash_queries_against_bytes(spark):
    pages = {p.page_id: p.html for p in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in q.rabin_fp(spark, DATA).collect():
        f = slow_rabin(pages[r.page_id][:40].encode("utf-16-le"))
        short = hashing.rabin_text(pages[r.page_id][:40])
        assert short & (1 << 64) - 1 == f and r.fp == hashing.rabin_text(pages[r.page_id])
    for r in q.murmur2(spark, DATA).collect():
        assert r.hash == hashing.murmur2(pages[r.page_id].encode())


def test_dom_walk_counts_tags(spark):
    pages = {p.page_id: p.html for p in spark.read.parquet(f"{DATA}/pages.parquet").collect()}

    class Tags(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = Counter()

        def handle_starttag(self, tag, attrs):
            self.found[tag] += 1

    got = {}
    for r in q.dom_walk(spark, DATA).where("name IN ('p', 'a', 'div', 'li', 'h1')").collect():
        got[r.page_id, r.name] = got.get((r.page_id, r.name), 0) + r.n
    for page, html in pages.items():
        tags = Tags()
        tags.feed(html)
        assert {k: got.get((page, k), 0) for k in ("p", "a", "div", "li", "h1")} == {k: tags.found[k] for k in ("p", "a", "div", "li", "h1")}


def test_arc_stream_offsets(tmp_path):
    from arcspark.sources.arc import ArcStream
    from arcspark.sources.members import file_header, record_member

    def add(name, when):
        p = tmp_path / name
        p.write_bytes(file_header(name, "20240101000000") + record_member("http://x/", "1.1.1.1", "20240101000000", "text/html", [], b"x"))
        os.utime(p, ns=(when, when))

    stream = ArcStream({"PATH": str(tmp_path), "pathglobfilter": "a*"})
    start = stream.initialOffset()
    assert stream.latestOffset() == start
    add("a1.arc.gz", 10)
    add("b1.arc.gz", 11)  # another name than the filter's
    one = stream.latestOffset()
    add("a0.arc.gz", 10)  # comes later with the same time
    add("a2.arc.gz", 20)
    two = stream.latestOffset()
    names = lambda a, b: [os.path.basename(p) for f in stream.partitions(a, b) for p in f.paths]
    assert names(start, one) == ["a1.arc.gz"] and names(one, two) == ["a0.arc.gz", "a2.arc.gz"]


def test_arc_reader_partitions_and_bounds(spark, tmp_path):
    path = q.archive_of_pages(spark, DATA)
    pages = read_arc(spark, path, records="item").select(F.col("uri").alias("url"), "host_ip", F.lit("20240101000000").alias("ts14"), "mime_type", F.col("header_items").alias("headers"), "content")
    write_arc(pages.repartition(6), f"{tmp_path}/six", origin="someone")
    n = lambda **o: read_arc(spark, f"{tmp_path}/six", **o).rdd.getNumPartitions()
    assert (n(), n(filesPerPartition=3), n(mbPerPartition=100), n(filesPerPartition=4, mbPerPartition=100)) == (6, 2, 1, 2)
    assert not [p for p in os.listdir(tmp_path / "six") if p.endswith(".tmp")]
    first = next(p for p in (tmp_path / "six").iterdir() if p.suffix == ".gz")
    assert b"1 0 someone" in gzip.open(first).read(300)
    big = pages.limit(1).withColumn("content", F.encode(F.repeat(F.lit("x"), 3 << 20), "UTF-8"))
    write_arc(big, f"{tmp_path}/big")
    cut = read_arc(spark, f"{tmp_path}/big", records="item", maxRecordMB=1).first()
    assert cut.flags & 2 and (1 << 20) - 5000 < len(cut.content) <= 1 << 20


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = spark.range(3).select(F.lit("http://x/").alias("url"), F.lit("1.1.1.1").alias("host_ip"), F.lit("20240101000000").alias("ts14"), F.lit("text/html").alias("mime_type"), F.expr("CAST(NULL AS array<struct<item_key:string,item_value:string>>)").alias("headers"), F.encode(F.when(F.col("id") < 2, "x").otherwise(F.raise_error(F.lit("stop"))), "UTF-8").alias("content"))
    with pytest.raises(Exception, match="stop"):
        write_arc(rows.coalesce(1), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not os.listdir(tmp_path / "out")


def test_dump(spark):
    from arcspark.__main__ import dump

    path = q.archive_of_pages(spark, DATA)
    assert len(dump(spark, path, rows=3)) == 3 and '"value":' in dump(spark, path, rows=1)[0]
    assert all("https://" in x for x in dump(spark, path, item=True, rows=5, where="uri LIKE 'https://%'"))


def test_job(spark, tmp_path):
    def pairs(frames):
        for f in frames:
            yield f.assign(k=f.id % 3, v=f.id)[["k", "v"]]

    def first_and_count(frames):
        key, first, n = None, None, 0
        for f in frames:
            for k, v in zip(f.k, f.v, strict=True):
                if k != key:
                    if key is not None:
                        yield pd.DataFrame({"k": [key], "first": [first], "n": [n]})
                    key, first, n = k, v, 0
                n += 1
        if key is not None:
            yield pd.DataFrame({"k": [key], "first": [first], "n": [n]})

    spark.range(100).write.parquet(f"{tmp_path}/a")
    spark.range(100, 130).write.parquet(f"{tmp_path}/b")
    mapped = Job(spark).read("parquet", f"{tmp_path}/a", f"{tmp_path}/b").map(pairs, "k long, v long").group_by("k", partitions=2)
    mapped.sort_by(F.desc("v")).reduce(first_and_count, "k long, first long, n long").write("parquet", f"{tmp_path}/out")
    assert rows_of(spark.read.parquet(f"{tmp_path}/out"), "k", "first", "n") == [(0, 129, 44), (1, 127, 43), (2, 128, 43)]
    assert rows_of(mapped.combine(n=F.count("*")).rows(), "k", "n") == [(0, 44), (1, 43), (2, 43)]
    ranged = mapped.group_by("k", by_range=True).sort_by("v").rows()
    assert ranged.count() == 130


def test_queue(spark, tmp_path):
    c = Controller(spark, f"file://{tmp_path}")
    futures = [c.submit(q.OrdersByPrice(DATA, s)) for s in ("O", "F", "O")]
    sizes = [f.result().count() for f in futures]
    assert sizes[0] == sizes[2] and c.statuses and all(s.state.name == "FINISHED" for s in c.statuses.values())


def test_progress():
    assert [progress("shards", 1, 2), progress("local", 0.5), progress("cached"), progress("shards", 0, 0)] == [pytest.approx(0.165), pytest.approx(0.825), 0.99, 0.33]


def test_deep_pages(spark, monkeypatch):
    rows = spark.range(500).selectExpr("id", "id % 7 AS k")
    near = rows_of(ordering.page(rows, [F.desc("k"), F.col("id")], 4, 50), "k", "id")
    monkeypatch.setattr(ordering, "NEAR_ROWS", 10)
    assert rows_of(ordering.page(rows, [F.desc("k"), F.col("id")], 4, 50), "k", "id") == near and len(near) == 50


def test_suffix_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("// comment\n\ncom\nco.uk // no comment in the format's sense\n*.ck\n!www.ck\n")
    rules = domain.read_rules(spark, str(tmp_path / "rules.txt"))
    assert rows_of(rules, "rule") == [("!www.ck",), ("*.ck",), ("co.uk",), ("com",)]
    hosts = spark.createDataFrame([("a.b.com",), ("com",), ("x.co.uk",), ("uk",), ("a.b.c.ck",), ("www.ck",), (None,), ("A.Com.",)], "host string")
    found = {r.host: (r.suffix, r.registrable) for r in domain.with_suffix(hosts, "host", rules).collect()}
    assert found == {"a.b.com": ("com", "b.com"), "com": ("com", None), "x.co.uk": ("co.uk", "x.co.uk"), "uk": (None, None), "a.b.c.ck": ("c.ck", "b.c.ck"), "www.ck": ("ck", "www.ck"), None: (None, None), "A.Com.": ("com", "a.com")}


def test_smoothed_average_across_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(k, i, float((i * 7 + k) % 5)) for k in range(3) for i in range(10)], "k long, i long, x double")
        got = aggregates.smoothed_average(rows, "x", ["i"], 0.3, ["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        s = None
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.i):
            s = r.x if s is None else 0.3 * r.x + 0.7 * s
            assert r.ema == pytest.approx(s)
    with pytest.raises(ValueError):
        aggregates.smoothed_average(rows, "x", ["i"], 0.3, [])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_arc_options(spark):
    path = q.archive_of_pages(spark, DATA)
    rows = read_arc(spark, path, urlPrefix="http://")
    assert rows.where("url NOT LIKE 'http://%'").isEmpty()
    assert read_arc(spark, path, withContent="false").where("value IS NOT NULL").isEmpty()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = rows.first()["url"]
        assert {r["url"] for r in read_arc(spark, path).where(f"url = '{one}'").collect()} == {one}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert is_archive("a.arc.gz") and not is_archive("a.warc.gz") and is_archive("a.warc.gz", strict=False)


def test_arc_stream(spark):
    path = q.archive_of_pages(spark, DATA)
    from arcspark.streaming.windows import arc_stream

    out = arc_stream(spark, path).writeStream.format("memory").queryName("arcs").start()
    out.processAllAvailable()
    out.stop()
    assert spark.table("arcs").count() == read_arc(spark, path).count()


def test_simhash_pairs(spark):
    rows = spark.createDataFrame([(1, 0b1111), (2, 0b1110), (3, 1 << 62), (4, 0b1111), (5, None)], "id long, h long")
    assert [tuple(r) for r in near_duplicates.simhash_pairs(rows, "id", "h").collect()] == [(1, 2, 1), (1, 3, 5)][:1]


def test_pages_and_cache(spark, tmp_path):
    class Numbers(ArchiveQuery):
        built = 0

        def __init__(self, n):
            self.n = n

        def domain_id(self):
            return "numbers"

        def params(self):
            return str(self.n)

        def sort_keys(self):
            return ["id"]

        def build(self, s):
            Numbers.built += 1
            return s.range(self.n)

    c = Controller(spark, f"file://{tmp_path}")
    assert [r.id for r in c.page(Numbers(10), 1, 4).rows.collect()] == [4, 5, 6, 7]
    assert [r.id for r in c.page(Numbers(10), 0, 3, SortOrder.DESC).rows.collect()] == [9, 8, 7]
    assert Numbers.built == 1
    empty = c.page(Numbers(0))
    assert (empty.total, empty.rows.count()) == (0, 0)
    assert c.page(Numbers(10), 9, 4).rows.count() == 0
    assert c.status_table().count() == 2 and len(c.status_json()) == 2
    assert missing_parts(3, ["part-00001"]) == [0, 2]
    assert create("OrdersByPrice", DATA, "O").params() == "O"


def test_row_index_and_bloom(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS k")
    found = ordering.with_row_index(rows, ["k", "id"]).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in found] == list(range(1000)) and [(r["k"], r["id"]) for r in found] == sorted((r["k"], r["id"]) for r in found)
    bits = aggregates.build_bloom(rows, "id", 1000, 10)
    probe = spark.range(2000).withColumn("x", aggregates.bloom_contains(q.F.col("id"), bits))
    assert probe.where("id < 1000 AND NOT x").isEmpty()
    assert probe.where("id >= 1000 AND x").count() < 60
