"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's fingerprints are the least k-gram hash in each sliding window of
k-grams. With k-grams of 4 words and windows of 5 k-grams, every span of 8
words has one, and equal spans have the same. Training fingerprints that a
benchmark fingerprint equals are hits; each hit is extended to the benchmark
window it came from and kept if all its words agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import joined, materialize, new_scope, packed, sized, sweep, text_of

#: Words of a benchmark window, and of a k-gram within it.
SPAN, GRAM = 8, 4
#: Rows of hits or of benchmark windows that may be broadcast; more are shuffled.
BROADCAST_HITS = 200_000

# The characters of a word before lower-casing A-Z, and all others. Named as ranges, the
# commonest first: Java's matcher tries one range after the other, and a negated class all of them for each letter.
_IN_WORD = r"a-z0-9A-Z\x{80}-\x{10FFFF}"
ANY_WORD, NOT_WORD = f"[{_IN_WORD}]+", f"[^{_IN_WORD}]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY_WORD), F.lit(0))


def exact_words(text: Column) -> Column:
    """Words with A-Z lower-cased and no other letter."""
    return _words(F.translate(text, UPPER, LOWER))


def folded_words(text: Column) -> Column:
    """Words in full lower case: equal wherever exact words are, and quicker.

    A capital sigma is replaced first, the one letter whose lower case
    depends on its neighbours.
    """
    return _words(F.lower(F.replace(text, F.lit("Σ"), F.lit("σ"))))


def grams(words: str, width: int) -> Column:
    """Hash of the ``width`` words from each position; empty if there are fewer."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(width))))
    return F.when(F.size(words) >= width, each).otherwise(F.array().cast("array<bigint>"))


def minima(hashes: str) -> Column:
    """The least hash in each window of k-grams that spans SPAN words."""
    wide = SPAN - GRAM + 1
    each = F.transform(F.sequence(F.lit(1), F.size(hashes) - wide + 1), lambda i: F.array_min(F.slice(hashes, i, wide)))
    return F.when(F.size(hashes) >= wide, each).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, skip, size, words, item): windows with their fingerprint and its place in them.

    Items of fewer than SPAN words are one window, whose fingerprint is the hash of it all.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), exact_words(text_of(text_col)).alias("words"), folded_words(text_of(text_col)).alias("folded"))
    full = items.where(F.size("words") >= SPAN).withColumn("g", grams("folded", GRAM))
    full = full.select("item", "words", "g", F.explode(F.sequence(F.lit(1), F.size("words") - SPAN + 1)).alias("at"))
    full = full.withColumn("near", F.slice("g", F.col("at"), SPAN - GRAM + 1)).withColumn("h", F.array_min("near"))
    full = full.select("h", (F.array_position("near", F.col("h")) - 1).cast("int").alias("skip"), F.lit(SPAN).alias("size"), F.slice("words", F.col("at"), SPAN).alias("words"), "item")
    short = [
        items.where(F.size("words") == n).select(F.xxhash64(*(F.get("folded", F.lit(j)) for j in range(n))).alias("h"), F.lit(0).alias("skip"), F.lit(n).alias("size"), "words", "item")
        for n in range(1, SPAN)
    ]
    return reduce(DataFrame.unionByName, short, full).distinct()


def hits(docs: DataFrame, known: DataFrame, scope: str | None = None) -> DataFrame:
    """``docs`` (rid, text) and windows -> (rid, spans, items) where any window occurs.

    ``spans`` are distinct (first word, number of words); a document without hits has no row.
    """
    known = materialize(known, "windows", scope)
    sizes = {r["size"]: r["count"] for r in known.groupBy("size").count().collect()}
    n_windows = sum(sizes.values())
    lengths = sorted(sizes)

    def gram(size: int) -> int:
        return GRAM if size == SPAN else size

    folded = docs.select("rid", folded_words(F.col("text")).alias("folded"))
    found = folded.select("rid", *(grams("folded", gram(n)).alias(f"g{n}") for n in lengths))
    prints = found.select("rid", F.array_distinct(F.concat(F.array().cast("array<bigint>"), *(minima("g8") if n == SPAN else F.col(f"g{n}") for n in lengths))).alias("prints"))
    # explode_outer: for explode, the optimiser would repeat the array inside a filter, once for each element
    training = prints.select("rid", F.explode_outer("prints").alias("h"))
    wanted = known.select("h").distinct()
    same = training.join(sized(wanted, n_windows, BROADCAST_HITS), "h").groupBy("rid").agg(F.collect_set("h").alias("hs"))
    same = materialize(same, "fingerprint-hits", scope)

    whole = joined(docs, same, "rid").select("rid", "hs", exact_words(F.col("text")).alias("words"), folded_words(F.col("text")).alias("folded"))
    spots = []
    # ``words`` stands twice in the function below, so that Spark keeps it as a column and does not split the text again for each place
    for n in lengths:
        g = whole.select("rid", "hs", "words", grams("folded", gram(n)).alias("g"))
        place = F.filter(F.transform("g", lambda h, i: F.struct(i.alias("at"), h.alias("h"))), lambda x: F.array_contains("hs", x["h"]))
        g = g.select("rid", F.explode_outer(F.transform(place, lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.slice("words", F.greatest(x["at"] - SPAN + 2, F.lit(1)), F.least(F.lit(2 * SPAN), F.size("words"))).alias("near"), F.greatest(x["at"] - SPAN + 1, F.lit(0)).alias("first")))).alias("x"))
        spots.append(g.select("rid", "x.*", F.lit(n).alias("size")).where(F.col("h").isNotNull()))
    none = whole.select("rid", F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("h"), "words", F.lit(0).alias("first"), F.lit(0).alias("size")).where(F.lit(False)).withColumnRenamed("words", "near")
    spot = reduce(DataFrame.unionByName, spots, none)
    window = sized(known.withColumnsRenamed({"words": "window"}), n_windows, BROADCAST_HITS)
    start = F.col("at") - F.col("skip")
    met = spot.join(window, ["h", "size"]).where(start >= 0)
    met = met.where(F.slice("near", F.greatest(start - F.col("first") + 1, F.lit(1)), F.col("size")) == F.col("window"))
    return met.groupBy("rid").agg(F.collect_set(F.struct(start.alias("start"), F.col("size").alias("size"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))


def hit_words(spans: str) -> Column:
    """Indices of the words that any span covers."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))


def with_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, scope: str | None = None) -> DataFrame:
    """(row, text, hit, items): the rows of ``docs``, packed, with word indices and items; null where nothing occurs.

    Rows are known by a hash of id and text.
    """
    inner = new_scope("decontamination")
    text = text_of(f"`{text_col}`")
    rows = packed(docs, rid=F.xxhash64(F.col(f"`{id_col}`"), text), text=text)
    found = hits(rows.select("rid", "text"), windows(benchmark), inner).select("rid", hit_words("spans").alias("hit"), "items")
    found = materialize(found, "decontamination-hits", scope)
    sweep(docs.sparkSession, inner)
    return joined(rows, found, "rid", "left").drop("rid")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2, scope: str | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Items without words, and null items,
    match nothing; items of equal text all count. Rows that repeat get equal
    results, rows without an id their text's. With an empty benchmark no word
    is hit; an empty table gives no rows. Texts are taken whole: a task holds
    the words and hashes of one at a time.
    """
    n_items = F.when(F.col("items").isNull(), 0).otherwise(F.size("items"))
    return with_hits(docs, benchmark, id_col, text_col, scope).select(
        F.col(f"row.`{id_col}`").alias("doc_id"),
        F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"),
        F.when(F.col("hit").isNull(), 0).otherwise(F.size("hit")).cast("long").alias("n_hit"),
        n_items.cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_items >= least_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2, scope: str | None = None) -> DataFrame:
    """``docs`` without those that hold ``least_items`` items or more; the others lose the words hit.

    A word goes with what stands between it and the next. Columns stay as they
    are, and no column name is taken. Cases are those of the report.
    """
    found = with_hits(docs, benchmark, id_col, text_col, scope).where(F.col("items").isNull() | (F.size("items") < least_items))
    # a column of its own: inside the function below the expression would run once for each word
    found = found.withColumn("words", F.when(F.col("hit").isNotNull(), F.regexp_extract_all("text", F.lit(ANY_WORD + NOT_WORD), F.lit(0))))
    left = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), F.col("hit"))
    cut = F.concat(F.regexp_extract("text", "^" + NOT_WORD, 0), F.array_join(F.transform(left, lambda i: F.get("words", i)), ""))
    text = F.when(F.col("hit").isNull(), F.col(f"row.`{text_col}`")).otherwise(cut)
    return found.select(*((text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


#: DuckDB: every window of every item against every document, word for word.
REPORT_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(ws), 8) AS size, array_to_string(ws[i:i + least(len(ws), 8) - 1], ' ') AS win
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size)),
m AS (SELECT doc_id, size, i, item FROM dw JOIN bw USING (size, win)),
n_hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
