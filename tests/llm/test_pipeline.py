"""The stages: their columns, what each decides against plain versions, the whole run."""

import collections
import gc
import os
import re
import time

import public_tokenizers
from test_pairs_and_repeats import brute_components
from test_texts import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from arcspark.llm import common, lines, packing

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ANY_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_line_dedup(rows):
    """Texts by id with repeated and nearly repeated lines cut, in order of id and line."""
    known, out = [], {}
    for i, text in sorted(rows.items()):
        kept = []
        for line in (text or "").split("\n"):
            low = line.encode().lower()
            size, units = lines.size_of(low), lines.units_of(low)
            edits = len(units) >= 8 and size >= 28
            again = size >= 14 and any(units == u or edits and e and lines.within_one(units, u) for u, e in known)
            if size >= 14:
                known.append((units, edits))
            if not again:
                kept.append(line)
        cut = "\n".join(kept)
        if cut == (text or "") or cut.strip():
            out[i] = text if cut == (text or "") else cut
    return out


def plain_near_duplicates(rows):
    return {i: rows[i] for i, _, least in brute_components(list(rows.items()), 5, 80) if i == least}


def plain_decontamination(rows, benchmark):
    items = collections.defaultdict(set)
    for item, text in benchmark.items():
        words = WORD.findall((text or "").translate(AZ))
        for k in range(max(1, len(words) - 7) if words else 0):
            items[tuple(words[k : k + 8])].add(item)
    sizes, out = {len(w) for w in items}, {}
    for i, text in rows.items():
        words = WORD.findall((text or "").translate(AZ))
        found, hit = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in items:
                    found |= items[tuple(words[k : k + n])]
                    hit |= set(range(k, k + n))
        if len(found) < 2:
            pieces = ANY_WORD.findall(text or "")
            head = (text or "")[: len(text or "") - sum(map(len, pieces))]
            out[i] = text if not hit else head + "".join(p for k, p in enumerate(pieces) if k not in hit)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_against_plain_versions(spark, docs, tmp_path):
    now, columns, results = docs, docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, DATA).write.parquet(f"{tmp_path}/{name}")
        then = spark.read.parquet(f"{tmp_path}/{name}")
        assert then.columns == columns and then.join(now, "doc_id", "left_anti").isEmpty()
        assert then.where("n_chars <> char_length(text)").isEmpty()
        results[name], now = texts(then), then
    benchmark = {str(r.item_id): r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert results["line_dedup"] == plain_line_dedup(results["toxicity"])
    assert results["near_duplicates"] == plain_near_duplicates(results["line_dedup"])
    assert results["decontamination"] == plain_decontamination(results["near_duplicates"], benchmark)
    packed = corpus_pipeline.run(spark, DATA).collect()
    bins, least = check_packing(packed, results["decontamination"], 1024)
    assert bins <= 1.02 * least + 1


def test_run_leaves_no_stage_tables(spark):
    corpus_pipeline.run(spark, DATA)
    base = common.shared_dir(spark).removeprefix("file://")
    assert not [n for n in os.listdir(f"{base}/arcspark") if n.startswith("stage-")]


def test_driver_collects_what_ended_queries_left(spark, odd, monkeypatch):
    monkeypatch.setattr(common, "HEAP_SHARE", 0)
    for ends in (lambda: common.materialize(odd.select("doc_id"), "settled"), lambda: common.sweep(spark, "none")):
        left = spark.sparkContext._jvm.java.util.ArrayList()
        known = spark.sparkContext._jvm.java.lang.ref.WeakReference(left)
        del left
        gc.collect()
        time.sleep(1)  # a thread of its own tells the JVM what Python dropped
        ends()
        assert known.get() is None


def test_token_cache_gives_way_to_other_operators():
    tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    ids = packing.encoder(tokenizer_file)("words that a worker keeps")
    cache = packing._state[tokenizer_file][1]
    assert cache
    common.text_hashes("of another operator")
    assert not cache
    assert packing.encoder(tokenizer_file)("words that a worker keeps") == ids and cache


def test_odd_rows_and_names(spark, odd, empty):
    docs = odd.withColumnsRenamed({"n": "n_chars", "cid": "row"}).selectExpr("doc_id", "text", "n_chars", "row", "'a' AS rid", "'b' AS hit", "'c' AS cut", "'d' AS lines", "'e' AS tid")
    for rows in (docs, docs.selectExpr("CAST(doc_id AS string) AS doc_id", "* EXCEPT (doc_id)"), docs.where("false")):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = common.materialize(stage(spark, now, DATA), "odd-stage")
            assert now.columns == rows.columns
        kept = now.where("doc_id IS NULL OR doc_id IN (2, 3)").count()
        assert kept == rows.where("doc_id IS NULL OR doc_id IN (2, 3)").count()
        packed = corpus_pipeline.packing(spark, now, DATA)
        assert packed.where("piece = 0").count() == now.count()


def test_without_the_optional_parts(tmp_path):
    """The entry module without the llm folders and the pipeline, in a process of its own."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "arcspark", tmp_path / "arcspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline'], q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_with_all_parts():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and all(any(q.startswith(f"op{n}_") for q in entry.queries()) for n in range(1, 14))
    assert Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
