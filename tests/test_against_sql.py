"""Queries against their SQL on small tables of odd values, where the given tables have none."""

from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from arcspark import queries as q
from arcspark.operators import aggregates


def differences(spark, folder: Path, name: str, **tables: str) -> tuple[Counter, Counter]:
    """(rows of the query alone, rows of its SQL alone) over tables that are given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = q.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = Counter(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cur = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = Counter(repr(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall())
    return got - want, want - got


#: Events around half a millisecond and ten seconds, some of them before 1970.
HALVES = "SELECT i AS event_id, make_timestamp((i - 40) * 4999875 + i % 3) AS ts, i % 2 AS user_id FROM range(300) t(i)"


def test_bandwidth_buckets_at_half_milliseconds(spark, tmp_path):
    assert differences(spark, tmp_path, "bandwidth_buckets", events=HALVES) == (Counter(), Counter())


def test_bandwidth_history_at_half_milliseconds(spark, tmp_path):
    assert differences(spark, tmp_path, "bandwidth_history", events=HALVES) == (Counter(), Counter())


def test_medians_hold_no_key_whole(spark, tmp_path):
    """Even and odd counts, one value, equal values, a key of nulls and a null key; no aggregate keeps all numbers of a key."""
    rows = [(k, float(i * 7919 % n)) for k, n in (("a", 1000), ("b", 1001), ("c", 1), ("d", 2)) for i in range(n)] + [("e", 5.5)] * 9 + [("f", None)] + [(None, x) for x in (1.0, 2.0, 4.0, None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: (r.n, r.median) for r in aggregates.medians(df, "k", F.col("v")).collect()}
    assert got == {"a": (1000, 499.5), "b": (1001, 500.0), "c": (1, 0.0), "d": (2, 0.5), "e": (9, 5.5), "f": (0, None), None: (3, 2.0)}
    lines = "SELECT chr(CAST(65 + i % 3 AS INTEGER)) AS l_returnflag, i % 50 AS l_partkey, CAST(1000 + i * 7919 % 100003 AS DOUBLE) / 100 AS l_extendedprice FROM range(3001) t(i)"
    assert differences(spark, tmp_path, "percentiles", lineitem=lines) == (Counter(), Counter())
    plan = q.percentiles(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_lateral_join_ranks_in_the_window(spark, tmp_path):
    """Equal prices and orders without a number; the order is the window's own, since a sort below it is lost in a shuffle."""
    orders = "SELECT CASE WHEN i % 7 = 0 THEN NULL ELSE 3000 - i END AS o_orderkey, i % 301 AS o_custkey, CAST(i % 4 AS DOUBLE) AS o_totalprice FROM range(3000) t(i)"
    assert differences(spark, tmp_path, "lateral_join", customer="SELECT i AS c_custkey FROM range(400) t(i)", orders=orders) == (Counter(), Counter())
    plan = q.lateral_join(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line]
    assert windows and all("o_totalprice" in line for line in windows) and "Sort [" not in plan


def test_shingles_of_odd_texts(spark, tmp_path):
    """Texts of few characters, beyond the first plane, equal ones, none; ids that are missing, null or there twice."""
    texts = ["", "ab", "abc", "abcabc", "😀😁", "a😀b😀c", "é\u0301a b\n", "aaaa" * 50, "abcabc", "語" * 3 + "abc", "\U0010ffff\U0010fffe\U0010ffff"]
    rows = [f"({i + i // 6}, '{t}')" for i, t in enumerate(texts)] + ["(1, 'abd')", "(NULL, 'abc')", "(20, NULL)", "(21, 'abc')"]
    documents = f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(doc_id, text)"
    for name in ("shingle_jaccard", "char_shingles"):
        assert differences(spark, tmp_path, name, documents=documents) == (Counter(), Counter())


def test_shingle_jaccard_shuffles_texts_alone(spark, tmp_path):
    """No array of shingles is made before the join: they took several times the room of their texts."""
    spark.range(5).selectExpr("id AS doc_id", "'text ' || id AS text").write.parquet(f"{tmp_path}/documents.parquet")
    plan = q.shingle_jaccard(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "arrays_zip" not in plan
