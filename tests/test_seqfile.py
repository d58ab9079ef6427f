"""Sequence files: the source against Spark's own reader and writer of the format."""

import os
import random

import pytest

from arcspark import queries
from arcspark.sources import seqfile
from arcspark.sources.sequence import read_sequence, write_sequence


def made(spark, n=3000):
    rng = random.Random(4)
    rows = [(f"k{i % 97}", rng.choice(["", "ü", "x" * rng.randrange(500), "line\nline\ttab", "日本" * 70])) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None)], "key string, value string"), sorted([*rows, ("", "")])


def got(df):
    return sorted((r.key, r.value) for r in df.collect())


def test_numbers():
    for n in (*range(-300, 300), 2**15, -(2**15), 2**31 - 1, -(2**31), 2**62, -(2**62), 127, 128, -112, -113, -120):
        data = b"xx" + seqfile.vint(n)
        assert seqfile.read_vint(data, 2) == (n, len(data))


@pytest.mark.parametrize("codec", [None, "default", "gzip", "bzip2"])
def test_files_of_the_other_writer(spark, tmp_path, codec):
    rows, want = made(spark)
    write_sequence(rows.coalesce(2), f"{tmp_path}/in", codec=codec and seqfile.CODECS[codec])
    for mb in (64, 0.02):
        found = seqfile.read_sequence_files(spark, f"{tmp_path}/in", splitMB=mb)
        assert got(found) == want and (mb > 1 or codec or found.rdd.getNumPartitions() > 2)


@pytest.mark.parametrize("codec", ["none", "default", "gzip"])
def test_files_for_the_other_reader(spark, tmp_path, monkeypatch, codec):
    rows, want = made(spark)
    seqfile.write_sequence_files(rows.coalesce(2), f"{tmp_path}/out", codec=codec)
    assert got(read_sequence(spark, f"{tmp_path}/out")) == want
    assert got(seqfile.read_sequence_files(spark, f"{tmp_path}/out", splitMB=0.05)) == want
    assert not [n for n in os.listdir(tmp_path / "out") if n.endswith(".tmp")]


def test_ranges_share_the_marks(spark, tmp_path):
    """Every record belongs to one range, wherever the ranges are cut."""
    rows, want = made(spark, 800)
    seqfile.write_sequence_files(rows.coalesce(1), f"{tmp_path}/out", codec="none")
    path = next(str(p) for p in (tmp_path / "out").iterdir() if p.suffix == ".seq")
    size = os.path.getsize(path)
    for each in (size // 7, size // 3, 70_001, size + 1):
        found = []
        for a in range(0, size, each):
            with open(path, "rb") as file:
                for keys, values in seqfile.pairs(file, a, a + each if a + each < size else None, size):
                    found += zip(keys, values, strict=True)
        assert sorted(found) == want


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a").write_bytes(b"SEQ\x05 and more of it")
    with pytest.raises(Exception, match="version 6"):
        seqfile.read_sequence_files(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "none").mkdir()
    assert seqfile.read_sequence_files(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="codec lzo"):
        seqfile.write_sequence_files(spark.createDataFrame([("a", "b")], "key string, value string"), f"{tmp_path}/x", codec="lzo")


def test_ranges_do_not_grow_in_number(spark, tmp_path, monkeypatch):
    """The query writes a file a task, and larger files are read in larger ranges, not in ever more of them."""
    monkeypatch.setattr(queries, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    rows = spark.range(0, 60000, 1, 3).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "timestamp_ntz'2024-01-01 00:00:00' AS l_shipdate", "repeat('N', 50) AS l_returnflag")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = queries.sequence_ranges(spark, str(tmp_path))
    assert found.count() == 60000 and found.where("many_tasks").count() == 60000
    assert len([n for n in os.listdir(tmp_path / "sequence") if n.endswith(".seq")]) > 1 and found.rdd.getNumPartitions() <= 60
