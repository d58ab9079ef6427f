"""Decontamination, language, tokens, media, toxicity, packing, chat."""

import collections
import hashlib
import math
import random
import tarfile
import unicodedata
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arcspark.llm import chat, decontamination, language, media, packing, pretoken, queries, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_decontamination_cases(spark):
    bench = [("b1", "One two three four five six seven eight nine"), ("b2", "short item"), ("b3", None), (None, "one two three"), ("b4", "..."), ("b5", "one two three four five six seven eight")]
    docs = [
        (1, "zero ONE, two three four five six seven eight! nine ten"), (2, "a short-item here"), (3, None), (4, ""), (5, "one two three four five six seven"),
        (1, "zero ONE, two three four five six seven eight! nine ten"), (None, "short item"), (6, "ÉCOLE short item"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    got = sorted((tuple(r)[:4] + (r.contaminated,) for r in decontamination.decontamination_report(d, b).collect()), key=repr)
    want = [(1, 11, 9, 2, True), (1, 11, 9, 2, True), (2, 4, 2, 1, False), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 7, 0, 0, False), (6, 3, 2, 1, False), (None, 2, 2, 1, False)]
    assert got == sorted(want, key=repr)
    ids = {r.doc_id: r.items_sha256 for r in decontamination.decontamination_report(d, b).collect()}
    assert ids[1] == hashlib.sha256(b"b1,b5").hexdigest() and ids[4] == hashlib.sha256(b"").hexdigest()
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(d, b).collect()}
    assert 1 not in cut and cut[2] == "a here" and cut[6] == "ÉCOLE " and cut[3] is None
    none = spark.createDataFrame([], "item_id string, text string")
    assert {r.n_hit for r in decontamination.decontamination_report(d, none).collect()} == {0}


def test_decontamination_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "word " * 9)], "item_id long, text string")
    found = {r.doc_id: r.n_hit for r in decontamination.decontamination_report(odd, bench).collect()}
    assert found[4] == 30_000 and found[1] == 0
    assert decontamination.decontamination_report(empty, bench).count() == 0


def test_language(spark, docs, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98 and all(0 <= r.score <= 1 for r in found)
    rows = language.identify(odd.withColumn("lang", odd["cid"])).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (2, 3, 6)} == {"und"}
    assert language.identify(empty.withColumn("lang", empty["cid"])).count() == 0


def brute_language(rows):
    """Rank-order profiles by counters: (doc_id, prediction, score)."""

    def grams(text):
        kept = [c.lower()[0] if c.isalpha() else c if unicodedata.category(c) in ("Mn", "Mc") else None for c in text]
        words, now = [], []
        for c in [*kept, None]:
            if c is None:
                if now:
                    words.append(now)
                now = []
            else:
                now.append(c)
        found = collections.Counter()
        for w in words:
            s = ["", *w, ""]
            found.update((c,) for c in w)
            found.update(zip(s, s[1:]))
            found.update((a, b, c) for a, b, c in zip(s, s[1:], s[2:]))
        return found

    def number(g):
        x = 0
        for c in g:
            x = x << 20 | (ord(c) if c else 0)
        return x * 4 + len(g)

    def ranked(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:300]]

    by_lang = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 and lang is not None:
            by_lang[lang].update(grams(text or ""))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in by_lang.items() if c}
    out = []
    for i, text, _ in rows:
        own = ranked(grams(text or ""))
        if not any(unicodedata.category(c)[0] == "L" for c in text or "") or not profiles:
            out.append((i, "und", 0.0))
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(own)) / (300 * len(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        out.append((i, best, 1 - away[best]))
    return sorted(out, key=repr)


def test_language_against_counters(spark, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.limit(60).collect()]
    rows += [(9000, "Съешь ещё этих мягких французских булок", "ru"), (9001, "Пример русского текста для проверки", "ru"), (9002, "これは日本語の文章です", "ja"), (9003, "日本語のテキスト", "ja"), (9004, "これは本です", None), (9005, "мягкий текст", None), (9006, "हिन्दी में एक वाक्य", "hi"), (9007, "123 !?", "en"), (9008, None, "en"), (None, "und text", "und"), (9009, "\u0301", "en"), (9010, "\u0301 12", "fr"), (9011, "e\u0301", "fr")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = brute_language(rows)
    found = sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=repr)
    assert [x[:2] for x in found] == [x[:2] for x in want] and np.allclose([x[2] for x in found], [x[2] for x in want])


TRICKY = ["a <|endoftext|> b 's ’ “x” Straße ǅ 漢字 \x1c y  \n\n z", "don't  \t\n foo's ½²³ 12345 ___ --'s", "  lead", "trail  ", "a \nb \t c   d", "İI ŉ", "x" * 9000, ""]


def tricky_texts():
    rng = random.Random(3)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", " '", "1", "é", "ß", ".", "\r", " \n", "don't", "¡", "\xa0", "ﬁ", "é"]
    wide = ["Привет", "МИР", "漢字", "かな", "カナ", "한글", "“", "”", "’s", "—", "…", "€", "Σ", "Ω", "العربية", "עברית", "ไทย", "हिन्दी", "e\u0301", "Ⅷ", "٣", "①", "😀", "\u2003", "İ", "ǅ", "a", " ", "\n", "1", "-"]
    return TRICKY + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["".join(rng.choice(wide) for _ in range(rng.randrange(12))) for _ in range(3000)]


def test_common_scripts_take_the_fast_path():
    for text in ("Привет, мир! Это — “цитата”…", "這是一個句子。かなカナ", "한국어 문장입니다", "مرحبا بالعالم", "हिन्दी में", "ελληνικά", "naïve café – 5 €"):
        assert pretoken.split(text, "word_end"), text
    for text in ("e\u0301", "a <|endoftext|>", "\u2003x", "ΣΑΣ"):
        assert pretoken.split(text, "word_end") is None, text


def test_token_counts(spark, odd, empty):
    texts, tok = tricky_texts(), Tokenizer.from_file(WORD)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(rows, WORD, limit=20).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 20), t
    assert token_counts.token_counts(odd, WORD).count() == odd.count() and token_counts.token_counts(empty, WORD).count() == 0


def check_packing(rows, texts, capacity):
    tok = Tokenizer.from_file(BYTE)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for i, all_ids in ids.items():
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(all_ids)
        assert all(r.length == capacity for r in own[1:])
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin), -(-sum(map(len, ids.values())) // capacity)


def test_packing(spark, docs, odd, empty):
    bins, least = check_packing(packing.pack(docs, BYTE).collect(), {r.doc_id: r.text for r in docs.collect()}, 1024)
    assert bins <= 1.02 * least + 1
    texts = dict(enumerate(tricky_texts()))
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), BYTE, capacity=64).collect()
    bins, least = check_packing(rows, texts, 64)
    assert bins <= 1.02 * least + 1
    assert packing.pack(odd, BYTE).select("doc_id").where("piece = 0").count() == odd.count() and packing.pack(empty, BYTE).count() == 0


def test_fullest():
    rng = random.Random(2)
    for _ in range(200):
        counts = [0] + [rng.choice([0, 0, 1, 2]) for _ in range(20)]
        room = rng.randrange(21)
        sums = {0}
        for length, n in enumerate(counts):
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= room}
        used = packing.fullest(counts, room)
        assert sum(k * v for k, v in used.items()) == max(sums) and all(v <= counts[k] for k, v in used.items())


def test_media(spark, tmp_path, odd, empty):
    rows = media.media_columns(odd, f"file://{tmp_path}/store").collect()
    assert len(rows) == odd.count()
    texts = collections.defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(r.text or "")
    for r in rows:
        data = next(iter(texts[r.doc_id])).encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.width, r.height, r.bits) == (576, len(payload) // 576, 8)
    stored = {}
    for shard in (tmp_path / "store").glob("*.tar"):
        with tarfile.open(shard) as t:
            stored |= {m.name: t.extractfile(m).read() for m in t.getmembers()}
    for r in rows:
        image = stored[f"{r.payload_sha256}.png"]
        assert (hashlib.sha256(image).hexdigest(), len(image)) == (r.media_sha256, r.media_bytes)
        assert hashlib.sha256(media.decode_png(image)).hexdigest() == r.payload_sha256
    for r in rows:  # each payload by its row's address
        with open(tmp_path / "store" / r.shard, "rb") as f:
            f.seek(r.offset)
            assert media.decode_png(f.read(r.length))[-32:] == next(iter(p for p in [media.decode_png(stored[f"{r.digest}.png"])]))[-32:]
            assert hashlib.sha256(media.decode_png(stored[f"{r.digest}.png"])).hexdigest() == r.digest
    index = media.addresses(media.store(odd, f"file://{tmp_path}/again"))
    assert media.metadata(index, f"file://{tmp_path}/again").count() == index.count() == len(stored)
    assert media.media_columns(empty).count() == 0


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in found if r.toxic == 1]
    clean = [r.predicted for r in found if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.01 and all(0 <= r.score <= 1 for r in found)
    some = spark.createDataFrame([(1, 1), (4, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, some).collect()
    assert len(rows) == odd.count() and all(r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.score_toxicity(empty, some).count() == 0
    assert toxicity.reject_toxic(odd, some.where("false")).columns == odd.columns


def test_calibration_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2)) * [0.01, 3.0]
    z = x @ [300.0, 0.5] - 1.0
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    w = toxicity._fit(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    assert np.allclose(w, [300.0, 0.5, -1.0], rtol=0.2) and abs((p - y).sum()) < 1e-2
    apart = np.column_stack([np.linspace(-1, 1, 400), np.zeros(400)])
    assert (apart @ toxicity._fit(apart, (apart[:, 0] > 0).astype(float))[:2])[-1] > 5


def brute_toxicity(rows):
    """Both Kneser-Ney models by dictionaries; gives a function of a text: (length, difference)."""
    log, classes = math.log, ("toxic", "ordinary")
    pairs = collections.defaultdict(collections.Counter)
    for toxic, text in rows:
        w = toxicity.words(text)
        for pair in set(zip(w, [None, *w])):
            pairs[pair][classes[not toxic]] += 1
    by_word, by_stem = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for (word, _), c in pairs.items():
        by_word[word].update({k: 1 for k in classes if c[k]} | {"n": 1})
    for word, c in by_word.items():
        by_stem[word[:4]].update(c)
    sums = {k: sum(c[k] for c in by_word.values()) for k in (*classes, "n")}
    share = {"toxic": sums["toxic"] / (sums["toxic"] + sums["ordinary"])}
    share["ordinary"] = 1 - share["toxic"]
    freed = lambda table, k: sum(min(c[k], 0.75) for c in table.values()) / sums[k]
    less = lambda n: max(n - 0.75, 0.0)

    def trusted(c, gap, backoff):
        n = c["toxic"] + c["ordinary"]
        evidence = sum(c[k] * log(c[k] / (n * share[k])) for k in classes if c[k])
        belief = 1 / (1 + math.exp(max(10 - evidence, -35))) * gap * gap / (gap * gap + 1)
        return belief * gap + (1 - belief) * backoff

    stem_p, stem_gap, word_p, word_gap, adds = {}, {}, {}, {}, {}
    for stem, c in by_stem.items():
        pooled = c["n"] / sums["n"]
        stem_p[stem] = {k: less(c[k]) / sums[k] + freed(by_stem, k) * pooled if c["n"] >= 4 else pooled for k in classes}
        stem_gap[stem] = trusted(c, log(stem_p[stem]["toxic"]) - log(stem_p[stem]["ordinary"]), 0.0)
        adds[stem, 0] = stem_gap[stem]
    for word, c in by_word.items():
        stem = word[:4]
        back = {k: stem_p[stem][k] * c["n"] / by_stem[stem]["n"] for k in classes}
        word_p[word] = {k: less(c[k]) / sums[k] + freed(by_word, k) * back[k] if c["n"] >= 4 else back[k] for k in classes}
        word_gap[word] = trusted(c, log(word_p[word]["toxic"]) - log(word_p[word]["ordinary"]), stem_gap[stem]) if c["n"] >= 4 else stem_gap[stem]
        adds[word, 1] = word_gap[word] - stem_gap[stem]
    history = collections.defaultdict(list)
    for (_, before), c in pairs.items():
        history[before].append(c)
    for (word, before), c in pairs.items():
        if c["toxic"] + c["ordinary"] >= 4:
            p = {}
            for k in classes:
                h, free = sum(x[k] for x in history[before]), sum(min(x[k], 0.75) for x in history[before])
                p[k] = (less(c[k]) + free * word_p[word][k]) / h if h else word_p[word][k]
            adds[(word, before), 2] = trusted(c, log(p["toxic"]) - log(p["ordinary"]), word_gap[word]) - word_gap[word]

    def measure(text):
        w = toxicity.words(text)
        return len(w), sum(adds.get((word[:4], 0), 0) + adds.get((word, 1), 0) + adds.get(((word, before), 2), 0) for word, before in zip(w, [None, *w]))

    return measure


def test_toxicity_against_dictionaries(spark):
    rng = random.Random(8)
    common_words, bad = [f"word{i}" for i in range(40)] + ["the", "of", "and"], ["awful", "awfully", "nasty", "idiot"]
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        rows.append((i, " ".join(rng.choice(bad) if toxic and rng.random() < 0.3 else rng.choice(common_words) for _ in range(rng.randrange(1, 30))), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    measure = brute_toxicity([(t, x) for _, x, t in rows])
    texts = [(i, x) for i, x, _ in rows] + [(1000, ""), (1001, "unseen words here"), (1002, "the awful awful idiot")]
    model = toxicity.learn(df)
    got = {r.doc_id: (r.n, r.total) for r in toxicity.measured(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, x in texts:
        n, total = measure(x)
        assert got[i][0] == n and abs(got[i][1] - total) < 1e-4 * max(1, abs(total)), (i, x)


def test_toxicity_scores_every_ngram(spark, monkeypatch):
    # each of many words has little evidence of its own; with no cut they still move the score
    rows = [(f"t{i}{k}", f"mild{i} filler{k % 7} mild{i}", 1) for i in range(40) for k in range(5)] + [(f"o{i}{k}", f"plain{i} filler{k % 7} plain{i}", 0) for i in range(40) for k in range(5)]
    rows = spark.createDataFrame(rows, "doc_id string, text string, toxic int")
    texts = spark.createDataFrame([(1, "mild3 filler2 mild3 mild4"), (1, "mild3 filler2 mild3 mild4"), (2, "plain3 filler2"), (3, ""), (None, "unseen")], "doc_id long, text string")
    model = toxicity.learn(rows)
    whole = sorted((tuple(r) for r in toxicity.measured(texts, model).collect()), key=repr)
    # where texts are joined with the table the sums are the same
    for local in (0, 5):
        monkeypatch.setattr(toxicity, "LOCAL", local)
        again = toxicity.learn(rows)
        joined = sorted((tuple(r) for r in toxicity.measured(texts, again).collect()), key=repr)
        assert len(again.names) + again.rest.count() == len(model.names) and len(again.names) <= local
        assert [r[:2] for r in joined] == [r[:2] for r in whole] and np.allclose([r[2] for r in joined], [r[2] for r in whole])
    # the count of the model's n-grams is that of all that differ from their backoff, however little
    evidence = 5 * np.log(2)
    assert evidence < toxicity.DOUBT
    assert next(r[2] for r in whole if r[0] == 1) > 0 > next(r[2] for r in whole if r[0] == 2)


def test_toxicity_counts_every_bigram_of_a_document(spark):
    rows = spark.createDataFrame([(1, "a b c b a b"), (0, "c b")], "toxic int, text string")
    found = {(r.key, r.toxic, r.ordinary) for r in toxicity.bigram_counts(rows).collect()}
    tokens = (b"a", b"b", b"c")
    keys = {(x, y): toxicity.keys_of([x, y])[1:].view(np.int64)[0] for x in tokens for y in tokens}
    start = {t: toxicity.keys_of([t]).view(np.int64)[0] for t in tokens}
    want = {(start[b"a"], 1, 0), (keys[b"a", b"b"], 1, 0), (keys[b"b", b"c"], 1, 0), (keys[b"c", b"b"], 1, 1), (keys[b"b", b"a"], 1, 0), (start[b"c"], 0, 1)}
    assert found == want


def chat_rows(spark, rows):
    return chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()


def test_chat(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt has numbers."), (1, 1, "assistant", "Use sorted()."), (1, 2, "user", "> How do I  SORT a list?\nIn place, please."),
        (1, 3, "assistant", ">> how do i sort a list?\n> In place, please.\nUse list.sort()."), (1, 5, "user", "> something nobody said\nHello?"),
        (2, 0, "user", None), (2, 1, "user", ""), (None, 1, "user", "x"), (3, None, "user", "y"), (1, 1, "assistant", "Use sorted()."), (1, 6, "user", ">>> use sorted().\nNo"),
    ]
    found = chat_rows(spark, rows)
    by_turn = {(r.conv_id, r.turn): r for r in found}
    assert len(found) == len(rows)
    what = lambda c, t: tuple(by_turn[c, t])[3:]
    assert what(1, 2) == ("In place, please.", 0, 0, 1, 3, 1, 1, "0")
    assert what(1, 3) == ("Use list.sort().", 2, 0, 2, 4, 2, 1, "0,2")
    assert what(1, 5)[1:] == (None, 5, 0, 5, 1, 0, "")
    assert what(1, 6) == ("No", 1, 0, 2, 2, 1, 1, "1")
    assert what(2, 1) == ("", 0, 0, 1, 1, 0, 0, "")
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("block", [1, 4096])
def test_chat_reply_order(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(block)
    rows, parents = [], {}
    for conv in range(4):
        for turn in range(25):
            parent = rng.randrange(turn) if turn and rng.random() < 0.5 else turn - 1 if turn else None
            if turn and rng.random() < 0.1:
                continue  # a gap: what comes after begins a thread, unless it quotes
            if parent is not None and (conv, parent) not in parents:
                parent = None
            quote = f"> c{conv} t{parent}\n" if parent is not None and parent != turn - 1 else ""
            if not quote:
                parent = turn - 1 if (conv, turn - 1) in parents else None
            parents[conv, turn] = parent
            rows.append((conv, turn, "user", f"{quote}c{conv} t{turn}"))

    def path(conv, turn):
        return (*(path(conv, parents[conv, turn]) if parents[conv, turn] is not None else ()), turn)

    want = {}
    for conv in range(4):
        order = sorted(path(c, t) for c, t in parents if c == conv)
        want |= {(conv, p[-1]): (parents[conv, p[-1]], p[0], len(p) - 1, k) for k, p in enumerate(order)}
    assert {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.reply_order) for r in chat_rows(spark, rows)} == want
