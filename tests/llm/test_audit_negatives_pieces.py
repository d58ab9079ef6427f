"""Filter audit, hard negatives and SentencePiece against brute force and the library."""

import hashlib
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from arcspark.llm import audit, negatives, pieces, queries

DATA = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_audit(rows, labels):
    """Every order, every step, every row."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    parts = {}
    for d, t, lang in rows:
        t = t or ""
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        parts.setdefault(lang or "", []).append((d, {f for f in fails if fails[f]}))
    out = []
    for part, docs in parts.items():
        removed, rows_ = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                failing = [x for x in docs if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed[f] += len(gone)
                rows_.append((part, "".join(order), k, len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in docs), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
        out += [(*r[:-1], removed[r[-1]]) for r in rows_]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "SHORT", "a b c", " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i % 70}" for i in range(120)), "LOUD " * 150, " ".join(f"W{i}X" for i in range(110)), " ".join(f"w{i}" for i in range(99)) + " 5%", " ".join(f"w{i}" for i in range(100)) + " |", "\x0bx\x1cy z " * 80]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(200)]
    rows += rows[:20]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(0, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, failed int")
    got = audit.filter_audit(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)


def test_audit_odd(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(empty, labels, part_col="cid").count() == 0
    parts = {r.part for r in audit.filter_audit(odd, labels, part_col="cid").collect()}
    assert parts == {"", "x", "y", "z"}


def test_orders_by_swaps():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for k in audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) == sum(1 for _ in audit.swaps(n)) + 1
    with pytest.raises(ValueError):
        audit.audit(None, "ABCDEFGHI")


def brute_negatives(rows):
    whole = [(v, lab, [math.floor(256 * x) for x in e]) for v, e, lab in rows if v is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for v, lab, a in whole:
        if v % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), w, other == lab) for w, other, b in whole if w != v))
        for ps, p, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out |= {(v, p, k, w, -ps, -s) for k, (s, w, _) in enumerate(fit, 1)}
    return sorted(out)


def mined(vectors, **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(vectors, **more).collect())


@pytest.mark.parametrize("block,anchors,rows_at_once,dense", [(16_384, 512, 2048, 0.05), (7, 2, 7, 1.1)])
def test_negatives_against_brute_force(spark, monkeypatch, block, anchors, rows_at_once, dense):
    for k, v in (("BLOCK", block), ("ANCHORS", anchors), ("ROWS", rows_at_once), ("DENSE", dense)):
        monkeypatch.setattr(negatives, k, v)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12))
    rows = [(int(i), [float(x) for x in (centres[i % 4] + 0.7 * rng.normal(size=12)) / 4], int(rng.integers(0, 3))) for i in range(0, 2000, 5)]
    rows += [(i, list(rows[3][1]), i % 3) for i in range(2001, 2040)]  # ties
    rows += [(2100, None, 1), (2200, [0.1] * 11 + [None], 1), (2300, [float("nan")] * 12, 1), (2400, [float("inf")] * 12, 1), (2500, list(rows[0][1]), None), (None, list(rows[0][1]), 1), (2600, [0.5], 1), (2700, [], 2), (2800, [0.0] * 12, 0)]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, akey string, slot int").repartition(6)
    single = [(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for v, e, lab in rows]
    want = brute_negatives(single)
    assert len({r[0] for r in want}) > 10 and mined(vectors) == want


def test_negatives_odd(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert mined(spark.createDataFrame([], kind)) == []
    assert mined(spark.createDataFrame([(100, [1.0, 2.0], 1)], kind)) == []
    # large components are exact, longer ones than a score could hold take no part
    rows = [(100, [3e5, 1.0], 1), (1, [3e5, 2.0], 1), (2, [2.9e5, 3.0], 2), (3, [3e5, 1.5], 3), (4, [1e30, 1.0], 2), (5, [1e308, 1e308], 1)]
    assert mined(spark.createDataFrame(rows, kind)) == brute_negatives(rows[:4])
    # an anchor that repeats counts once, rows of its id are none of its own
    rows = [(100, [1.0], 1), (100, [1.0], 1), (100, [0.9], 2), (7, [1.0], 1), (8, [1.0], 2), (8, [1.0], 2)]
    found = mined(spark.createDataFrame(rows, kind))
    assert found == [(100, 7, 1, 8, 65536, 65536), (100, 7, 2, 8, 65536, 65536), *[(100, 8, 1, 7, 58880, 58880)] * 2]


def test_bounds_hold():
    """No pair whose score is asked for is dropped, however the product goes on."""
    rng = np.random.default_rng(1)
    whole = np.floor(256 * rng.normal(size=(300, 16)) * np.linspace(2, 0.01, 16))
    by = negatives.Rotation.of(whole.T @ whole)
    v = negatives.Vectors.of(np.arange(300), np.zeros(300, np.int64), whole, by)
    exact = (whole @ whole.T).astype(np.int64)
    low, high = np.quantile(exact, 0.9, axis=1).astype(np.int64), exact.max(1)
    i, j, score = negatives.alive(v, v, by, low, high, np.ones((300, 300), bool))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero((exact >= low[:, None]) & (exact <= high[:, None]))))) and (score == exact[i, j]).all()
    assert negatives.share(np.asarray([-7, 0, 5, 2**62]), 80, True).tolist() == [-5, 0, 4, -((-80 * 2**62) // 100)]


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TRICKY = ["", " ", "  a  b ", "a\nb\tc", "\n", "\n\n x", " \n", "a \n  b", "▁x ▁▁ y▁", "<s>hi</s> <0x0A> <unk>", "　x", "ﬁ Å é é", "😀𝔘 👩‍👩‍👧", "a\x00b", "x" * 5000, "ab" * 3000 + "!", "word " * 3000, "...!!! ,,, a.b.c. (d)", "don't  stop"]


@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n▁.,abeht'é日😀")), st.characters(exclude_categories=["Cs"])), max_size=80))
@settings(max_examples=300, deadline=None)
def test_pieces_as_the_library(text):
    own = pieces.encoder(MODEL)
    (ids, agreed), = pieces.encoded([text], own)
    assert ids == LIBRARY.encode(text) and agreed
    assert own.model.decode(ids) == LIBRARY.decode(ids)


@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 300)), max_size=20))
@settings(max_examples=300, deadline=None)
def test_pieces_decode_any_ids(ids):
    assert pieces.model(MODEL).decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("cache,few", [(400_000, 40), (5, 3)])
def test_pieces_small_caches(spark, docs, monkeypatch, cache, few):
    texts = TRICKY + [r.text for r in docs.limit(40).collect()]
    monkeypatch.setattr(pieces, "WORKER_CACHE", cache)
    monkeypatch.setattr(pieces, "FEW", few)
    own = pieces.Encoder(MODEL)
    for k in range(0, len(texts), 7):
        got = list(pieces.encoded(texts[k : k + 7], own))
        assert [ids for ids, _ in got] == LIBRARY.encode(texts[k : k + 7]) and all(ok for _, ok in got)


def test_pieces_that_differ(monkeypatch):
    """Where ours were wrong, the library's ids stand and the text says so."""
    own = pieces.Encoder(MODEL)
    right = own.model.encode
    monkeypatch.setattr(own.model, "encode", lambda x: [5, 6] if x == "▁cat" else right(x))
    got = list(pieces.encoded(["a cat, and", "a dog", "cats cat."], own))
    assert [ids for ids, _ in got] == LIBRARY.encode(["a cat, and", "a dog", "cats cat."]) and [ok for _, ok in got] == [False, True, False]


def test_pieces_query(spark, docs):
    got = {r.doc_id: r for r in queries.op13_sentencepiece(spark, DATA).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(), True)
        assert tuple(got[r.doc_id])[1:] == want


def test_pieces_odd(spark, odd, empty):
    rows = pieces.encode(odd, MODEL)
    assert rows.count() == odd.count() and pieces.encode(empty, MODEL).count() == 0
    assert {r.ids[-1] for r in rows.collect()} == {2} and pieces.piece_report(odd, MODEL).where("agreed").count() == odd.count()
    back = pieces.decode(rows, MODEL)
    assert sorted(map(repr, back.select("doc_id", "text").collect())) == sorted(map(repr, odd.selectExpr("doc_id", "coalesce(text, '') text").collect())) and back.where("NOT agreed").count() == 0
    without = pieces.encode(odd, MODEL, end=None).where("doc_id = 3").first()
    assert without.ids == []
    assert pieces.decode(rows.selectExpr("doc_id", "CAST(NULL AS array<int>) ids"), MODEL).where("text = ''").count() == odd.count()


def test_other_vocabularies_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(b"\x12\x02\x18\x01")  # a trainer's message alone: model type 1
    with pytest.raises(ValueError):
        pieces.Model(str(path))
