"""How filters interact: every order of them, judged from the counts of which fail together.

A pass over the texts tells which filters each document fails, as bits. Counts
by part and bits are all that the orders need: 2^n cells a part. The orders are
visited by adjacent transpositions, so that each differs from the one before
in two neighbouring steps; only those are counted anew from the cells, and a
filter's Shapley sum grows along the walk by what it removes at the time.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcspark.llm.common import in_runs, joined, materialize, new_scope, pieces, sweep, text_of

NAMES = "ABCDE"
#: Filters that an audit may have: it visits all their orders.
MOST = 8
#: Parts whose orders are held at once.
PARTS_AT_ONCE = 50
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
CELL = ["part", "failed", "n", "good", "toxic"]

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = re.compile(rb"[#$%&*|]")


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails: few words, repeated words, many capitals, signs."""
    data = text.encode("utf-8", "surrogatepass")
    n, distinct = 0, set()
    for piece in pieces(data):
        words = piece.split()  # bytes: at blanks and the control characters 9 to 13 alone
        n += len(words)
        distinct.update(words)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (n < 100) | (100 * len(distinct) < 80 * n) << 1 | (100 * capitals > 10 * len(text)) << 2 | (_SIGNS.search(data) is not None) << 3


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per row: doc_id, part, failed (bits of A to D), digest (16 bytes of the text's BLAKE2b)."""

    def work(batches):
        for batch in batches:
            for a, b, texts in in_runs(batch.column(2)):
                failed = [failures(t) for t in texts]
                digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "failed", "digest"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(part_col).alias("part"), text_of(text_col).alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, failed int, digest binary")


def document_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, failed, n, good, toxic): rows by part and the filters A to E that they fail, and those labelled good and toxic.

    E is failed by a text that a smaller id has too. Texts are known by 128
    bits. Equal texts become one row a part and id before they meet, so that
    no number of copies meets in one task: the least id of a text, and its
    rows, come from sums by part.
    """
    spark = docs.sparkSession
    scope = new_scope("audit")
    rows = materialize(judged(docs, id_col, text_col, part_col), "audit-judged", scope)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = joined(rows, materialize(marks.where("good OR toxic"), "audit-labels", scope), "doc_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    by_id = marked.groupBy("digest", "failed", "part", "doc_id").agg(F.count("*").alias("n"), F.sum(yes("good")).alias("good"), F.sum(yes("toxic")).alias("toxic"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    by_text = by_id.where("doc_id IS NOT NULL").groupBy("digest", "failed", "part").agg(F.min(F.struct("doc_id", "n", "good", "toxic")).alias("first"), *sums)
    by_text = by_text.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    own = lambda c: F.when(F.col("first.doc_id") == F.col("least"), F.col(f"first.{c}")).otherwise(0)
    passing = by_text.select("part", "failed", *(own(c).alias(c) for c in ("n", "good", "toxic")))
    repeats = by_text.select("part", (F.col("failed") + 16).alias("failed"), *((F.col(c) - own(c)).alias(c) for c in ("n", "good", "toxic")))
    nameless = by_id.where("doc_id IS NULL").select("part", "failed", "n", "good", "toxic")
    cells = passing.unionByName(repeats).unionByName(nameless).groupBy("part", "failed").agg(*sums).where("n > 0")
    cells = materialize(cells.select(*CELL), "audit-cells")
    sweep(spark, scope)
    return cells


def swaps(n: int) -> Iterator[int]:
    """The place k of each swap of neighbours k and k + 1 that takes a list of n through all its orders.

    The last of them wanders through every order of the others, from one end
    to the other and back.
    """
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        yield k + 1 if down else k
        down = not down


def walk(cells: np.ndarray, names: str) -> Iterator[tuple[str, list[np.ndarray]]]:
    """Each order of the filters with its steps' counts (parts x COUNTS), and at the end the Shapley sums (parts x filters) under "".

    ``cells``: parts x masks x (rows, good, toxic).
    """
    n = len(names)
    masks = np.arange(1 << n)
    order = list(range(n))

    def step(k: int) -> np.ndarray:
        before = sum(1 << f for f in order[:k])
        own = 1 << order[k]
        fails, gone = masks & own != 0, masks & before != 0
        lost = cells[:, fails & ~gone].sum(1)
        kept = cells[:, masks & (before | own) == 0, 0].sum(1)
        return np.stack([kept, lost[:, 0], cells[:, fails & gone, 0].sum(1), cells[:, own, 0], lost[:, 1], lost[:, 2]], 1)

    steps = [step(k) for k in range(n)]
    removed = np.zeros((len(cells), n), np.int64)
    for k in range(n):
        removed[:, order[k]] = steps[k][:, 1]
    shapley = removed.copy()
    yield "".join(names[f] for f in order), list(steps)
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        for i in (k, k + 1):
            steps[i] = step(i)
            removed[:, order[i]] = steps[i][:, 1]
        shapley += removed
        yield "".join(names[f] for f in order), list(steps)
    yield "", [shapley]


def audit(cells: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``cells`` (part, failed, n, good, toxic): one row a part and set of failed
    filters, bit i for ``names[i]``; a cell that is not there is 0. Counts are
    of the part. ``shapley`` is what the step's filter removes, summed over
    all orders. An empty table gives no rows.
    """
    if not 0 < len(names) <= MOST:
        raise ValueError(f"1 to {MOST} filters: every order of them is visited")
    size, orders = 1 << len(names), math.factorial(len(names))
    columns = ["part", "filter_order", "step", *COUNTS, "shapley"]

    def work(batches):
        for batch in batches:
            parts, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(parts), PARTS_AT_ONCE):
                some = held[at : at + PARTS_AT_ONCE]
                values = np.zeros((len(some), size, 3), np.int64)
                for i, found in enumerate(some):
                    for c in found:
                        values[i, c["failed"]] += (c["n"], c["good"], c["toxic"])
                found = list(walk(values, names))
                shapley = found.pop()[1][0]
                counts = np.stack([np.stack(steps, 1) for _, steps in found], 1)  # parts x orders x steps x counts
                own = np.asarray([[names.index(c) for c in order] for order, _ in found])
                rows = orders * len(names)
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(np.asarray(parts[at : at + PARTS_AT_ONCE], object), rows), pa.string()),
                        pa.array([order for order, _ in found for _ in names] * len(some), pa.string()),
                        pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), orders * len(some))),
                        *(pa.array(counts[..., i].reshape(-1)) for i in range(len(COUNTS))),
                        pa.array(shapley[:, own.reshape(-1)].reshape(-1)),
                    ],
                    columns,
                )

    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    kind = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*COUNTS, "shapley"])
    return by_part.mapInArrow(work, kind)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``audit`` of the filters A to E over ``docs``: one row per part (value of ``part_col``, null as ''), order and step.

    Null texts count as empty; they fail A and, after the first, E. Rows
    without an id fail E never and make no other row fail it; rows that repeat
    an id and a text pass or fail it together; repeated label rows count once.
    An empty table gives no rows. Other columns are not looked at. A task
    holds about a million characters, or one longer text and its distinct words.
    """
    return audit(document_cells(docs, labels, id_col, text_col, part_col))


_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate("abcde"))
_DISTINCT = " AND ".join(f"f{i}.f <> f{j}.f" for i in range(1, 6) for j in range(1, i))

AUDIT_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e
  FROM docs LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, {_BITS} AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits FROM filters f1, filters f2, filters f3, filters f4, filters f5 WHERE {_DISTINCT}),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS gone FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN failed::BIGINT & (gone | own)::BIGINT = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN failed::BIGINT & gone = 0 AND failed & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failed::BIGINT & gone <> 0 AND failed & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN failed::BIGINT & gone = 0 AND failed & own <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN failed::BIGINT & gone = 0 AND failed & own <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""
