"""Ranges of archives, member indexes, late files, shards, blocks, filters and patterns as tables."""

import io
import os
import random
import shutil
from functools import partial

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from arcspark import queries
from arcspark.functions import domain
from arcspark.operators import aggregates, blocks, bloom_table, patterns
from arcspark.plans import archive_query
from arcspark.plans.shards import ShardedResult, ShardsFailed
from arcspark.sources import arc, members, positions
from arcspark.sources.members import file_header, record_member
from arcspark.streaming.windows import arc_stream


def records_of(n, seed=1):
    rng = random.Random(seed)
    return [(f"http://h{i % 7}.com/p{i}", "1.1.1.1", "20240101000000", "text/html", [(None, "HTTP/1.1 200 OK")], rng.randbytes(rng.randint(0, 4000))) for i in range(n)]


def write_archive(path, rows, when=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(file_header(path.name, "20240101000000") + b"".join(record_member(*r) for r in rows))
    if when:
        os.utime(path, ns=(when, when))


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_next_member():
    rows = records_of(30)
    # content that looks like the beginning of a member, and a whole member that is no record
    rows[5] = (*rows[5][:5], b"\x1f\x8b\x08" * 50 + random.Random(2).randbytes(500) + members.gzip_member(random.Random(3).randbytes(3000)))
    data = file_header("a", "20240101000000") + b"".join(record_member(*r) for r in rows)
    starts = [p for p, _, _ in members.members(io.BytesIO(data))][1:]
    for at in [*range(1, len(data), 997), *starts, *(s + 1 for s in starts)]:
        assert members.next_member(io.BytesIO(data), at, len(data)) == next((s for s in starts if s >= at), None)
    assert members.next_member(io.BytesIO(data), starts[3] + 1, starts[4]) is None


def test_damage_is_stepped_over(spark, tmp_path):
    rows = records_of(20)
    parts = [file_header("a.arc.gz", "20240101000000"), *(record_member(*r) for r in rows)]
    parts[8] = parts[8][:20] + bytes([parts[8][20] ^ 255]) + parts[8][21:]
    (tmp_path / "a.arc.gz").write_bytes(b"".join(parts))
    urls = sorted(r[0] for i, r in enumerate(rows, 1) if i != 8)
    for options in ({}, {"splitMB": 0.005}):
        found = arc.read_arc(spark, str(tmp_path), mode="DROPMALFORMED", **options)
        assert [u for (u,) in rows_of(found, "url")] == urls
    with pytest.raises(Exception, match="GZIP"):
        arc.read_arc(spark, str(tmp_path)).collect()


def test_ranges_read_every_record_once(spark, tmp_path):
    write_archive(tmp_path / "in/x/a.arc.gz", records_of(120))
    write_archive(tmp_path / "in/y/a.arc.gz", records_of(40, 2))
    write_archive(tmp_path / "in/empty.arc.gz", [])
    root, columns = str(tmp_path / "in"), ("url", "arc_file_name", "arc_file_pos", "arc_file_size", "value")
    whole = rows_of(arc.read_arc(spark, root), *columns)
    assert len(whole) == 160
    for mb in (0.002, 0.05, 1):
        found = arc.read_arc(spark, root, splitMB=mb)
        assert rows_of(found, *columns) == whole and (mb > 0.05 or found.rdd.getNumPartitions() > 4)
    index = str(tmp_path / "index")
    positions.write_member_index(spark, root, index, split_mb=0.03)
    found = arc.read_arc(spark, root, memberIndex=index)
    assert rows_of(found, *columns) == whole and found.rdd.getNumPartitions() > 5
    # a file that came after the index was made is read whole
    write_archive(tmp_path / "in/z.arc.gz", records_of(5, 3))
    assert arc.read_arc(spark, root, memberIndex=index).count() == 165


def test_lookups_read_their_bytes_alone(spark, tmp_path):
    rows = records_of(300)
    rows[200] = (rows[10][0], *rows[200][1:])  # a second capture of one url
    write_archive(tmp_path / "in/a.arc.gz", rows)
    index, size = str(tmp_path / "index"), os.path.getsize(tmp_path / "in/a.arc.gz")
    positions.write_member_index(spark, str(tmp_path / "in"), index)
    wanted = spark.createDataFrame([(rows[10][0],), (rows[10][0],), (rows[77][0],), ("http://unknown/",), (None,)], "url string")
    read = spark.sparkContext.accumulator(0)
    found = positions.lookup(spark, wanted, str(tmp_path / "in"), index, item=True, bytes_read=read)
    assert rows_of(found, "uri", "content") == sorted((r[0], r[5]) for r in (rows[10], rows[200], rows[77]))
    own = spark.read.parquet(f"{index}/members").where(F.col("url").isin(rows[10][0], rows[77][0])).agg(F.sum("size")).first()[0]
    assert own <= read.value < own + 3 * positions.GAP < size
    bad = spark.createDataFrame([("a.arc.gz", 7, 100), (None, 1, 1)], "path string, pos long, size long")
    assert positions.read_members(bad, str(tmp_path / "in"), drop_malformed=True).count() == 0
    with pytest.raises(Exception, match="no record at a.arc.gz:7"):
        positions.read_members(bad, str(tmp_path / "in")).collect()


def test_runs_of_reads():
    assert [(a, b, len(x)) for a, b, x in positions.runs([(0, 10), (10, 5), (100, 1), (10**6, 5), (10**6, 5)])] == [(0, 101, 3), (10**6, 10**6 + 5, 2)]
    assert len(list(positions.runs([(i << 20, 1 << 20) for i in range(20)]))) == 3


def test_reads_resume(tmp_path, monkeypatch):
    data = random.Random(1).randbytes(300_000)
    (tmp_path / "f").write_bytes(data)
    monkeypatch.setattr(arc, "WAIT_S", 0)
    opened = []

    class Failing:
        """Every third read of a file fails."""

        def open_input_file(self, path):
            opened.append(path)
            return Broken(fs.LocalFileSystem().open_input_file(path))

    class Broken:
        def __init__(self, file):
            self.file, self.reads = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            self.reads += 1
            if self.reads == 3:
                raise OSError("gone")
            return self.file.read(min(n, 20_000))

        def close(self):
            self.file.close()

    assert io.BufferedReader(arc.Resuming(Failing(), str(tmp_path / "f"), 20), 50_000).read() == data and len(opened) > 3
    with pytest.raises(OSError, match="gone"):
        io.BufferedReader(arc.Resuming(Failing(), str(tmp_path / "f"), 1), 50_000).read()


def test_stream_offsets_take_late_files(tmp_path):
    hour = int(3600e9)
    stream = arc.ArcStream({"path": str(tmp_path), "lookbackHours": "2"})
    offsets, seen = [stream.initialOffset()], []

    def step():
        offsets.append(stream.latestOffset())
        seen.append([os.path.basename(p) for f in stream.partitions(offsets[-2], offsets[-1]) for p in f.paths])

    write_archive(tmp_path / "a.arc.gz", records_of(1), 100 * hour)
    step()
    write_archive(tmp_path / "late.arc.gz", records_of(1), 100 * hour - hour // 2)
    write_archive(tmp_path / "same.arc.gz", records_of(1), 100 * hour)
    step()
    write_archive(tmp_path / "b.arc.gz", records_of(1), 105 * hour)
    write_archive(tmp_path / "between.arc.gz", records_of(1), 101 * hour)
    step()
    step()
    write_archive(tmp_path / "moved.arc.gz", records_of(1), 104 * hour)
    write_archive(tmp_path / "old.arc.gz", records_of(1), 50 * hour)  # beyond what the stream looks back
    step()
    assert [sorted(x) for x in seen] == [["a.arc.gz"], ["late.arc.gz", "same.arc.gz"], ["b.arc.gz", "between.arc.gz"], [], ["moved.arc.gz"]]


def test_stream_reads_each_file_once_over_restarts(spark, tmp_path):
    out, root = str(tmp_path / "out"), tmp_path / "in"

    def run():
        rows = arc_stream(spark, str(root)).select("url", "arc_file_name")
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(out).groupBy("arc_file_name", "url").count().where("count = 1").select("arc_file_name").distinct().collect())

    now = 1_700_000_000 * 10**9
    write_archive(root / "a.arc.gz", records_of(3), now)
    (root / "a.warc.gz").write_bytes(b"not one of ours")
    os.utime(root / "a.warc.gz", ns=(now, now))
    assert run() == ["a.arc.gz"]
    write_archive(root / "late.arc.gz", records_of(3, 5), now - 10**12)
    write_archive(root / "sub dir/b.arc.gz", records_of(3, 6), now + 10**9)
    assert run() == ["a.arc.gz", "b.arc.gz", "late.arc.gz"]
    shutil.move(root / "sub dir/b.arc.gz", root / "moved.arc.gz")
    assert run() == ["a.arc.gz", "b.arc.gz", "late.arc.gz", "moved.arc.gz"]
    assert spark.read.parquet(out).count() == 12


def test_shards(spark, tmp_path):
    broken: set[int] = {3}
    asked = []

    def build(s, shards):
        asked.append(list(shards))
        rows = s.range(100).select((F.col("id") % 5).cast("int").alias("shard"), "id")
        return rows.where(F.when(F.col("shard").isin(list(broken & set(shards))), F.raise_error(F.lit("broken"))).otherwise(F.col("shard") < 4))

    result = ShardedResult(spark, f"file://{tmp_path}/r", 6, attempts=2, wait_s=0)
    with pytest.raises(ShardsFailed, match="broken") as e:
        result.refresh(build)
    assert set(e.value.errors) == {3} and result.missing() == [3] and result.ran == [[0, 1, 2, 3, 4, 5], [0, 1, 2], [3, 4, 5], [3], [3], [4, 5]]
    with pytest.raises(FileNotFoundError):
        result.rows()
    assert result.rows(partial=True).count() == 60
    broken.clear()
    asked.clear()
    again = ShardedResult(spark, f"file://{tmp_path}/r", 6).refresh(build)
    assert asked == [[3]] and again.missing() == []
    assert rows_of(again.rows(), "shard", "id") == sorted((i % 5, i) for i in range(100) if i % 5 < 4)  # shards 4 and 5 have no rows
    assert not [p for p in os.listdir(tmp_path / "r") if p.startswith("_aside")]
    again.refresh(build)
    assert asked == [[3]]
    empty = ShardedResult(spark, f"file://{tmp_path}/none", 2).refresh(lambda s, shards: s.range(0).selectExpr("CAST(id AS INT) shard", "id x"))
    assert empty.rows().columns == ["x", "shard"] and empty.rows().count() == 0


def test_failed_queries_go_on_where_they_were(spark, tmp_path, monkeypatch):
    class Parts(archive_query.ArchiveQuery):
        shards, broken, asked = 3, True, []

        def domain_id(self):
            return "parts"

        def params(self):
            return ""

        def sort_keys(self):
            return ["id"]

        def build(self, s):
            raise AssertionError("it has shards")

        def build_shards(self, s, shards):
            Parts.asked.append(list(shards))
            rows = s.range(9).select((F.col("id") % 3).cast("int").alias("shard"), "id")
            return rows.where(F.when(F.lit(Parts.broken) & F.col("shard").isin([x for x in shards if x == 1]), F.raise_error(F.lit("broken"))).otherwise(True))

    monkeypatch.setattr(archive_query, "ShardedResult", partial(ShardedResult, attempts=1, wait_s=0))
    c = archive_query.Controller(spark, f"file://{tmp_path}")
    with pytest.raises(ShardsFailed):
        c.result(Parts())
    Parts.broken = False
    Parts.asked.clear()
    assert [r.id for r in c.page(Parts(), 1, 4).rows.collect()] == [4, 5, 6, 7] and Parts.asked == [[1]]
    assert c.result(Parts()).count() == 9 and Parts.asked == [[1]] and "shards" not in os.listdir(tmp_path / Parts().canonical_id())


def scanned(df):
    """Rows that the scans of a collected frame gave on."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().get("numOutputRows").get().value()
        if "QueryStage" in node.nodeName():
            plan.append(node.plan())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return found


def test_pages_read_their_blocks_alone(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(50)]), f"k{rng.randrange(1000):04d}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(3)
    path = str(tmp_path / "b")
    blocks.write_blocks(df, ["a", "b", "c"], path, 100)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert blocks.total(spark, path) == 5000 and spark.read.parquet(f"{path}/blocks").count() >= 50
    for number, size in ((0, 30), (3, 30), (40, 100), (16, 300), (166, 30), (500, 30)):
        found = blocks.page(spark, path, number, size)
        assert [(r.row_idx, r.a, r.b, r.c) for r in found.collect()] == [(i, *r) for i, r in enumerate(want)][number * size : (number + 1) * size]
    assert [tuple(r)[:3] for r in blocks.page(spark, path, 1, 40, descending=True).collect()] == want[::-1][40:80]
    # 30 rows lie in one block or two, and bounds by column may let the neighbours in
    assert 0 < scanned(blocks.page(spark, path, 90, 30)) <= 400
    for key in ((None, "", 0), (7, "k0500", 0), (49, "k9999", 9999), (50, "", 0), (-1, "", 0)):
        asked = (key[0] is not None, key[0] or 0, *key[1:])
        assert blocks.position_of(spark, path, *key) == sum((r[0] is not None, r[0] or 0, r[1], r[2]) < asked for r in rows)
    blocks.write_blocks(df.where("false"), ["a"], path)
    assert blocks.total(spark, path) == 0 and blocks.page(spark, path, 0, 10).count() == 0 and blocks.position_of(spark, path, 3) == 0


def test_bloom_table(spark):
    n, bits = 20_000, 12.0
    own = spark.range(n).select((F.col("id") * 7).alias("x"))
    table = bloom_table.bloom_table(own.unionByName(own).unionByName(spark.createDataFrame([(None,)], "x long")), "x", n, bits)
    asked = spark.range(7 * n).select(F.col("id").alias("x"), F.lit(1).alias("block"), F.lit(2).alias("w0")).unionByName(spark.createDataFrame([(None, 1, 2)], "x long, block int, w0 int"))
    for limit in (0, 1 << 30):
        found = bloom_table.with_membership(asked, "x", table, n, bits, broadcast_bytes=limit)
        got = found.selectExpr("count_if(x % 7 = 0 AND maybe)", "count_if(x % 7 <> 0 AND maybe)", "count_if(maybe IS NULL)").first()
        assert found.columns == ["x", "block", "w0", "maybe"] and got[0] == n and got[1] < 0.01 * 6 * n and got[2] == 1
    texts = spark.createDataFrame([("a",), ("ü",), ("",)], "t string")
    assert bloom_table.with_membership(texts, "t", bloom_table.bloom_table(texts, "t", 3), 3).where("maybe").count() == 3
    none = bloom_table.bloom_table(texts.where("false"), "t", 0)
    assert bloom_table.with_membership(texts, "t", none, 0).where("maybe").count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_patterns_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(patterns, "BROADCAST_PATTERNS", limit)
    rng = random.Random(8)
    word = lambda most: "".join(rng.choice("abü") for _ in range(rng.randint(0, most)))
    known = list({word(5) for _ in range(60)} - {""})
    values = [word(9) for _ in range(300)] + [None, "", "a"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "p long, _value string")
    table = spark.createDataFrame([(k,) for k in [*known, known[0], None]], "pattern string")
    for suffix in (False, True):
        fits = {v: sorted((k for k in known if (v.endswith(k) if suffix else v.startswith(k))), key=len) for v in values if v is not None}
        for which, pick in (("longest", lambda x: x[-1]), ("shortest", lambda x: x[0]), ("all", lambda x: x)):
            got = patterns.match_patterns(rows, "_value", table, suffix=suffix, which=which).collect()
            assert len(got) == len(values)
            assert {r.p: r.match for r in got} == {i: pick(fits[v]) if fits.get(v) else None for i, v in enumerate(values)}
    assert patterns.match_patterns(rows, "_value", table.where("false")).where("match IS NOT NULL").count() == 0
    assert patterns.match_patterns(rows, "_value", spark.createDataFrame([("",)], "pattern string")).where("match = ''").count() == len(values) - 1
    with pytest.raises(ValueError):
        patterns.match_patterns(rows, "_value", table, which="any")


def test_bandwidth_buckets(spark):
    rows = [("a", t, n) for t, n in ((0, 10), (100, 10), (150, 10), (160, 0), (300, 5), (301, 5), (None, 3), (5301, 0), (5400, 0), (5500, 7), (5600, 7), (5650, 7))] + [(None, 5, None), (None, 500, 4)]
    out = aggregates.bandwidth_buckets(spark.createDataFrame(rows, "k string, t long, n long").repartition(3), "t", "n", ["k"]).collect()
    got = {(r.k, r.t): (r.stalled, r.buckets, r.bytes_per_second and round(r.bytes_per_second, 3)) for r in out}
    assert got["a", 100] == (False, 0, 200.0) and got["a", 150] == (False, 1, 200.0) and got["a", 160] == (False, 1, 187.5)
    assert got["a", 300] == (False, 2, 116.667) and got["a", None] == (None, None, None)
    assert got["a", 5301] == (True, 0, 0.0) and got["a", 5400] == (True, 0, 0.0) and got["a", 5500] == (False, 1, 7000.0)
    assert got["a", 5650] == (False, 2, round(21000 / 151, 3)) and got[None, 5] == (False, 0, 0.0) and got[None, 500] == (False, 1, round(4000 / 495, 3))
    many = spark.range(60).selectExpr("1 AS k", "id * 200 AS t", "id AS n")
    assert aggregates.bandwidth_buckets(many, "t", "n", ["k"]).agg(F.max("buckets")).first()[0] == 20
    with pytest.raises(ValueError):
        aggregates.bandwidth_buckets(many, "t", "n", [])


def test_long_suffix_rules(spark):
    rules = spark.createDataFrame([("a.b.c.d.e.f.g",), ("g",)], "rule string")
    hosts = spark.createDataFrame([("x.y.a.b.c.d.e.f.g",), ("x.g",)], "host string")
    assert rows_of(domain.with_suffix(hosts, "host", rules), "host", "suffix") == [("x.g", "g"), ("x.y.a.b.c.d.e.f.g", "a.b.c.d.e.f.g")]


@pytest.mark.parametrize("name", ["arc_split_scan", "arc_index_scan"])
def test_no_task_writes_all_pages(spark, tmp_path, monkeypatch, name):
    """The query's archives are a file a task, and read by more tasks than there are files."""
    monkeypatch.setattr(queries, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    spark.range(0, 400, 1, 4).selectExpr("id AS page_id", "'http://h/' || id AS url", "repeat(sha2(string(id), 256), 40) AS html").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path))
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet").select("url", F.md5("html").alias("content_md5"))
    assert rows_of(found.where("many_tasks"), "url", "content_md5") == rows_of(pages, "url", "content_md5")
    files = [len(arc.list_archives(str(d))) for d in tmp_path.glob("*-arc")]
    assert files and min(files) > 1 and found.rdd.getNumPartitions() > max(files)
