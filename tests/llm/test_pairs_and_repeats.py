"""n-gram Jaccard join, suffix dedup and line dedup against brute force."""

import collections
import hashlib
import random

import pytest

from arcspark.llm import common, jaccard, lines, suffix
from arcspark.llm.components import stars


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def chains():
    """Each text is within the threshold of the next, and of few others."""
    now, rows = [f"u{i}" for i in range(120)], []
    for d in range(40):
        now[(d * 37) % 120] = f"x{d}"
        rows.append((d, " ".join(now)))
    return rows


def near_copies():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, docs, width, percent):
    for rows in (near_copies(), chains(), [(r.doc_id, r.text) for r in docs.collect()]):
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
        assert sorted(tuple(r)[:3] for r in got.collect()) == brute_components(rows, width, percent)


def test_jaccard_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 10)
    rows = [(7, i, 100, 0, bytearray(64), 1 if i % 3 else 500 + i, 60, 40, 1) for i in range(60)] + [(8, i, 100, 0, bytearray(64), i, 9, 1, 0) for i in range(9)]
    dealt = jaccard.in_tiles(spark.createDataFrame(rows, "h long, cid long, n long, pos int, bits binary, part long, rows long, k long, most long")).collect()
    by_tile = collections.defaultdict(list)
    for r in dealt:
        by_tile[r.tile].append(r)
    assert max(map(len, by_tile.values())) < 40
    met = collections.Counter((a.cid, b.cid) for g in by_tile.values() for a in g for b in g if a.cid < b.cid and a.part != b.part and (a.side < 0 or a.side != b.side))
    part = {i: 1 if i % 3 else 500 + i for i in range(60)}
    want = collections.Counter((a, b) for a in range(60) for b in range(a + 1, 60) if part[a] != part[b]) + collections.Counter((a, b) for a in range(9) for b in range(a + 1, 9))
    assert met == want


@pytest.mark.parametrize("held,remembered", [(2, 3), (5, 100)])
def test_jaccard_large_groups(spark, monkeypatch, held, remembered):
    monkeypatch.setattr(jaccard, "HELD", held)
    monkeypatch.setattr(jaccard, "REMEMBERED", remembered)
    monkeypatch.setattr(jaccard, "BROADCAST_SHARED", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    for rows in (near_copies(), chains()):
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
        assert sorted(tuple(r)[:3] for r in got.collect()) == brute_components(rows, 3, 90)


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a"), (2, text, "b"), (2, "something else altogether here now", "c"), (2, "something else altogether here now", "c"), (3, None, None), (None, text, "d")]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, rid string"), spark.createDataFrame([(None if i is None else f"k{i}", t, x) for i, t, x in rows], "doc_id string, text string, rid string")):
        kept = sorted((str(r.doc_id)[-1], r.rid or "") for r in jaccard.one_of_each(docs).collect())
        assert kept == [("1", "a"), ("2", "c"), ("3", ""), ("e", "d")]


@pytest.mark.parametrize("parts", [1, 5])
def test_jaccard_rows_without_an_id(spark, parts):
    """Null ids before, between and after equal and near texts; each case has words and ids of its own."""
    rows = []
    for k, case in enumerate(([(None, "a"), (5, "a"), (7, "b")], [(5, "a"), (None, "a"), (7, "b"), (None, "b")], [(7, "b"), (5, "a"), (None, "a")], [(None, "b"), (None, "a"), (7, "b"), (None, "a"), (5, "a")], [(None, "a"), (7, "b")])):
        a = " ".join(f"c{k}w{i}" for i in range(60))
        rows += [(i and 10 * k + i, {"a": a, "b": a.replace("w30 ", "other ")}[t]) for i, t in case]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.repartition(parts) if parts > 1 else docs.coalesce(1)
    got = sorted(tuple(r)[:3] for r in jaccard.jaccard_components(docs).where("doc_id IS NOT NULL").collect())
    assert got == brute_components([r for r in rows if r[0] is not None], 5, 80)
    kept = sorted(r.doc_id for r in jaccard.one_of_each(docs).collect() if r.doc_id is not None)
    assert kept == sorted({c for _, _, c in got})


def test_jaccard_odd(odd, empty):
    found = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(odd).collect()}
    assert found[2, 0] == 2 and found[3, 0] == 3 and found[1, next(n for d, n in found if d == 1)] == 1
    assert all(v is None for (d, _), v in found.items() if d is None)
    assert jaccard.jaccard_components(odd).count() == odd.count()
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.one_of_each(odd).columns == odd.columns


def test_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    found = {r.node: r.root for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def brute_suffix(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[p : p + 200] for _, b in data for p in range(len(b) - 199))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def few_ranges(monkeypatch):
    monkeypatch.setattr(suffix, "RANGES", 6)


@pytest.mark.parametrize("seed", range(3))
def test_suffix(spark, few_ranges, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé \n") for _ in range(1500))
    rows = [(0, None), (1, ""), (2, "ab" * 300), (3, "ab" * 100), (4, "x" * 199), (None, base[100:600]), (5, base), (5, base)]
    for i in range(6, 24):
        a = rng.randrange(1300)
        rows.append((i, "".join(rng.choice("pqrs") for _ in range(rng.randrange(80))) + base[a : a + rng.randrange(150, 320)] + str(i) * rng.randrange(60)))
    got = suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_suffix(rows)


@pytest.mark.parametrize("seed", range(2))
def test_suffix_in_pieces(spark, few_ranges, monkeypatch, seed):
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(9000))
    other = "".join(rng.choice("abcdefgh \n") for _ in range(6000))
    rows = [(1, base), (2, other + base[3000:3700] + other[:2500]), (3, base[:8999] + "!"), (3, other), (4, "z" * 5000), (5, "q" + base[2500:2702]), (1, base), (6, other[100:5900])]
    got = suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_suffix(rows)


def test_prefix_doubling(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("ab \n") for _ in range(400))
    rows = [(0, base), (1, base[50:300]), (2, "x" + base[100:340]), (3, "y" * 30), (4, ""), (5, "é" * 25)]
    for span in (20, 64, 200):
        found = {tuple(r) for r in suffix.repeated_positions(spark.createDataFrame(rows, "rid long, text string"), span).collect()}
        data = {i: t.encode() for i, t in rows}
        seen = collections.Counter(b[p : p + span] for b in data.values() for p in range(len(b) - span + 1))
        assert found == {(i, p) for i, b in data.items() for p in range(len(b) - span + 1) if seen[b[p : p + span]] > 1}


def test_suffix_documents(docs, few_ranges):
    got = suffix.suffix_dedup(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_suffix([(r.doc_id, r.text) for r in docs.collect()])


def test_suffix_odd(odd, empty, few_ranges):
    assert suffix.suffix_dedup(odd).count() == odd.count()
    assert suffix.suffix_dedup(empty).count() == 0


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows):
    found, known = collections.Counter(), []
    every = sorted({(i, k, tuple(lines.units_of(x))) for i, t in rows if i is not None for k, x in enumerate((t or "").encode().lower().split(b"\n"))})
    for i, _, w in every:
        size = sum(map(len, w))
        if size < 14:
            continue
        edits = len(w) >= 8 and size >= 28
        found[i] += any(w == v or edits and other and within_one(w, v) for v, other in known)
        known.append((w, edits))
    return found


def edited_lines(seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.randint(2, 14))] for _ in range(8)]
    rows = []
    for d in range(25):
        now = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                kind, at = rng.randrange(3), rng.randrange(len(x))
                if kind == 0:
                    x[at] = rng.choice(words)
                elif kind == 1:
                    x.insert(at, rng.choice(words))
                elif len(x) > 1:
                    del x[at]
            now.append(" ".join(x))
        rows.append((d, "\n".join(now)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_lines(spark, docs, seed):
    rows = edited_lines(seed) + ([(1000 + r.doc_id, r.text) for r in docs.collect()] if seed == 0 else [])
    got = {r.doc_id: r.n_removed for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert got == {i: want[i] for i, _ in rows}


def test_lines_far_side(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = edited_lines(7)
    got = {r.doc_id: r.n_removed for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert got == {i: want[i] for i, _ in rows}


def test_lines_without_blanks(spark):
    a = "這是一個沒有空格的長句子用來測試去重"
    rows = [(1, a), (2, a.replace("長", "短")), (3, "這" + a), (4, a[::-1]), (5, a.replace("長", "短").replace("測", "考"))]
    got = {r.doc_id: r.n_removed for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}  # 5 is one edit from 2


def test_lines_repeated_ids_and_types(spark):
    x, y = "one line that two documents hold in full", "nothing that any other document has in it"
    rows = [("a", x, 1, 1), ("b", x, 2, 2), ("b", y, 3, 3), (None, x, 4, 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, rid int, _d int")
    got = sorted(((r.doc_id or "", r.text, r.rid) for r in lines.without_repeats(docs).collect()))
    assert got == [("", x, 4), ("a", x, 1), ("b", y, 3)]


def test_within_one():
    for a, b in [(b"a b c", b"a b c"), (b"a b c", b"a x c"), (b"a b", b"a b c"), (b"b c", b"a b c")]:
        assert lines.within_one(a.split(), b.split()) and lines.within_one(b.split(), a.split())
    assert not lines.within_one(b"a b c".split(), b"b c d".split()) and not lines.within_one(b"a".split(), b"a b c".split())
    assert lines.within_one(b"a a".split(), b"a a a".split())


def test_lines_odd(odd, empty):
    rows = lines.line_report(odd).collect()
    assert len(rows) == odd.count() and {r.n_removed for r in rows if r.doc_id == 1} == {2}
    assert lines.line_report(empty).count() == 0
    assert lines.without_repeats(odd).columns == odd.columns
