"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of units: its words, and of a long word in a script
without blanks each character. Lines of the same units are one, known by a
hash, and the earliest by (id, text's hash, line number) stays. Of lines
within one unit's edit (inserted, deleted or replaced) the earlier stays too:
every line that can have such a neighbour emits the hash of itself and of
each sequence with one unit left out; equal variants are joined, each with the
earliest of them, and the edit distance of the pair is verified on the units.
Which lines can have one is found first: one edit leaves the first or the
second half of a line as it was, so only lines that share a half with another
emit variants, and only for deletions in the other half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import in_runs, joined, materialize, mix, new_scope, packed, sized, sweep, text_of, word_hashes

#: Bytes, blanks not counted, from which a repeated line is removed; units and bytes from which one edit is allowed.
LEAST_BYTES, EDIT_UNITS, EDIT_BYTES = 14, 8, 28
#: Bytes from which a word beyond ASCII counts character by character.
LONG_WORD = 24
#: Units that a task hashes at once.
UNITS = 100_000
#: Columns of a line's place: its document's id and hash, its number from 0.
AT = ("d", "rid", "l")

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, 1024), base, np.uint64)
        out[0] = 1
        known = np.cumprod(out, dtype=np.uint64)
        if n <= 2 * UNITS:
            _powers[base] = known
    return known[:n]


def _name(x: np.ndarray, n) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + np.asarray(n, np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


class Line:
    """Hashes of one line's units: of all of them and of its deletions."""

    def __init__(self, units: list[bytes]):
        self.n = len(units)
        with np.errstate(over="ignore"):
            terms = word_hashes(units) * _power(_BASE, self.n)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def whole(self) -> int:
        return int(_name(self.sums[-1:], self.n)[0])

    def without(self, at: np.ndarray) -> np.ndarray:
        """Names of the line with the unit at each place left out."""
        with np.errstate(over="ignore"):
            rest = (self.sums[-1] - self.sums[at + 1]) * np.uint64(_INVERSE)
            return _name(self.sums[at] + rest, self.n - 1)


def hashed(units: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, keys) of lines of ``n`` units end to end, all at once; the names are those of ``Line.whole``.

    Keys are four for each line, for pairs whose shorter line has m = n or
    m = n - 1 units: its first m // 2 units and its last m - m // 2.
    """
    end = np.cumsum(n)
    start = end - n
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(units) * _power(_BASE, len(units)), dtype=np.uint64)])
        back = _power(_INVERSE, len(units) + 1)
        names = _name((sums[end] - sums[start]) * back[start], n)
        keys = []
        for m in (n, n - 1):
            first, last = m // 2, m - m // 2
            keys.append(_name((sums[start + first] - sums[start]) * back[start], 2 * m + 1_000_000))
            keys.append(_name((sums[end] - sums[end - last]) * back[end - last] + np.uint64(1), 2 * m + 1_000_000))
    return names, np.stack(keys, axis=1)


def units_of(line: bytes) -> list[bytes]:
    """Words; a word of LONG_WORD bytes or more that is not ASCII counts as its characters."""
    words = line.split()
    if line.isascii() or max(map(len, words), default=0) < LONG_WORD:
        return words
    out: list[bytes] = []
    for w in words:
        out += [w] if len(w) < LONG_WORD or w.isascii() else [c.encode("utf-8", "surrogatepass") for c in w.decode("utf-8", "surrogatepass")]
    return out


def size_of(line: bytes) -> int:
    """Bytes of a line that are no blanks."""
    return len(line.translate(None, b" \t\r\x0b\x0c"))


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split(b"\n")


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one unit inserted, deleted or replaced makes a into b, or none does."""
    if abs(len(a) - len(b)) > 1:
        return False
    least, i = min(len(a), len(b)), 0
    while i < least and a[i] == b[i]:
        i += 1
    j = 0
    while j < least - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def line_facts(docs: DataFrame) -> DataFrame:
    """(d, rid, text) -> (d, rid, l, h, keys): lines of LEAST_BYTES or more, with the hashes of their halves where edits count."""

    def work(batches):
        for batch in batches:
            row, at, n, edits, units = [], [], [], [], []

            def out(batch=batch, row=row, at=at, n=n, edits=edits, units=units):
                sizes, which = np.asarray(n, np.int64), np.asarray(edits, bool)
                names, keys = hashed(units, sizes)
                offsets = pa.array(np.concatenate([[0], np.cumsum(4 * which)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys[which].ravel()))
                rows = pa.array(row, pa.int64())
                found = pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array(names), lists], [*AT, "h", "keys"])
                for x in (row, at, n, edits, units):
                    x.clear()
                return found

            for first, _, texts in in_runs(batch.column(2)):
                for i, text in enumerate(texts, first):
                    take = bytes.split if text.isascii() else units_of
                    for k, line in enumerate(split(text)):
                        if len(line) < LEAST_BYTES or (size := size_of(line)) < LEAST_BYTES:
                            continue
                        found = take(line)
                        row.append(i)
                        at.append(k)
                        n.append(len(found))
                        edits.append(len(found) >= EDIT_UNITS and size >= EDIT_BYTES)
                        units += found
                        if len(units) >= UNITS:
                            yield out()
            if row:
                yield out()

    return docs.mapInArrow(work, f"d {docs.schema['d'].dataType.simpleString()}, rid long, l int, h long, keys array<long>")


def line_texts(rows: DataFrame) -> DataFrame:
    """(rid, text, lines: l, h and flags) -> (h, flags, line): the units of each line, between line feeds, which no unit holds."""

    def work(batches):
        for batch in batches:
            h, flags, lines = [], [], []
            for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                every = split(text)
                for x in wanted:
                    h.append(x["h"])
                    flags.append(x["flags"])
                    lines.append(b"\n".join(units_of(every[x["l"]])))
            yield pa.record_batch([pa.array(h, pa.int64()), pa.array(flags, pa.int32()), pa.array(lines, pa.binary())], ["h", "flags", "line"])

    return rows.mapInArrow(work, "h long, flags int, line binary")


def variants(lines: DataFrame) -> DataFrame:
    """(h, flags, line) -> (key, place, h); ``place`` is the deleted unit's, or -1 for the whole line."""

    def work(batches):
        for batch in batches:
            key, place, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for name, flags, packed_line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                line = Line(packed_line.split(b"\n"))
                n, places = line.n, []
                for bits, m in ((flags & 3, n), (flags >> 2, n - 1)):
                    if bits & 1:  # the first half is shared: the edit lies behind it
                        places.append(np.arange(m // 2, n))
                    if bits & 2:
                        places.append(np.arange(0, m // 2 + 1))
                at = np.unique(np.concatenate(places)).astype(np.int64)
                key.append(line.without(at))
                place.append(at)
                if flags & 3:
                    key.append(np.asarray([line.whole()]))
                    place.append(np.asarray([-1]))
                h.append(np.full(len(at) + bool(flags & 3), name))
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (key, place, h)], ["key", "place", "h"])

    return lines.mapInArrow(work, "key long, place long, h long")


def neighbours(sent: DataFrame) -> DataFrame:
    """(key, place, h, at) -> (h, g): a line and the earliest earlier one that shares a variant with it.

    A deletion meets the earliest at the same place (a replaced unit) and a
    whole line; a whole line meets the earliest deletion.
    """
    me = F.struct("at", "h")
    firsts = sent.groupBy("key", "place").agg(F.min(me).alias("first"), F.count("*").alias("n"))
    deleted = F.col("place") >= 0
    by_key = firsts.groupBy("key").agg(F.min(F.when(deleted, F.col("first"))).alias("deletion"), F.min(F.when(~deleted, F.col("first"))).alias("whole"))
    same = sent.join(firsts.where("n > 1 AND place >= 0").select("key", "place", "first"), ["key", "place"]).where("first.at < at").select("h", F.col("first.h").alias("g"))
    other = sent.join(by_key.where("deletion IS NOT NULL AND whole IS NOT NULL"), "key")
    other = other.select("h", "at", F.when(F.col("place") >= 0, F.col("whole")).otherwise(F.col("deletion")).alias("first")).where("first.at < at")
    return same.unionByName(other.select("h", F.col("first.h").alias("g"))).where("h <> g").distinct()


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(h) of the pairs (h, g) whose units are within one edit."""
    both = pairs.join(lines.select("h", "line"), "h").join(lines.select(F.col("h").alias("g"), F.col("line").alias("other")), "g")

    def work(batches):
        for batch in batches:
            h, a, b = (batch.column(i).to_pylist() for i in range(3))
            near = [within_one(x.split(b"\n"), y.split(b"\n")) for x, y in zip(a, b, strict=True)]
            yield pa.record_batch([batch.column(0).filter(pa.array(near, pa.bool_()))], ["h"])

    return both.select("h", "line", "other").mapInArrow(work, "h long").distinct()


def repeated_lines(docs: DataFrame, scope: str | None = None) -> DataFrame:
    """``docs`` (d, rid, text) -> (rid, lines): the numbers, from 0, of each document's lines to remove."""
    inner = new_scope("lines")
    facts = materialize(line_facts(docs), "line-facts", inner)
    classes = facts.groupBy("h").agg(F.min(F.struct(*AT)).alias("at"), F.first("keys").alias("keys"), F.count("*").alias("n"))
    classes = materialize(classes, "line-classes", inner)
    keyed = classes.where(F.size("keys") > 0).select("h", F.posexplode("keys").alias("side", "key"))
    shared = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    flagged = keyed.join(shared, "key").groupBy("h").agg(F.bit_or(F.expr("shiftleft(1, side)")).cast("int").alias("flags"))
    flagged = flagged.join(classes.select("h", "at"), "h")
    by_doc = materialize(flagged.groupBy("at.rid").agg(F.collect_list(F.struct("at.l", "h", "flags")).alias("lines")), "line-candidates", inner)
    lines = materialize(line_texts(joined(docs.select("rid", "text"), by_doc, "rid")).dropDuplicates(["h"]), "line-texts", inner)

    sent = materialize(variants(lines), "line-variants", inner)
    live = sent.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    sent = materialize(sent.join(live, "key").join(classes.select("h", "at"), "h"), "line-shared-variants", inner)
    near = materialize(verified(neighbours(sent), lines), "line-near", inner).withColumn("near", F.lit(True))

    judged = classes.select("h", "at", "n").join(sized(near, near.count()), "h", "left").where("n > 1 OR near").select("h", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = facts.select(*AT, "h").join(judged, "h").where(F.col("near") | (F.struct(*AT) > F.col("first")))
    gone = materialize(gone.groupBy("rid").agg(F.collect_set("l").alias("lines")), "line-removals", scope)
    sweep(docs.sparkSession, inner)
    return gone


def _kept(lines: str, gone: str) -> Column:
    """``lines`` is a column, not an expression, which would run once for each line."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    return F.transform(left, lambda i: F.get(lines, i))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str | None = None) -> DataFrame:
    """(row, cut, n_lines, n_removed): the rows of ``docs``, packed, their texts without repeated lines, and counts.

    Lines under LEAST_BYTES bytes stay; those under EDIT_UNITS units or
    EDIT_BYTES bytes go only if an earlier line has the same units. Blank lines
    stay. Units are compared in ASCII lower case. Null texts stay null, and
    rows without an id stay as they are. Rows that repeat an id and its text
    are one document and keep the same lines; rows that repeat an id with
    other texts are documents of their own, earlier by the text's hash. Ids
    keep their type. An empty table stays empty. No column name is taken. A
    task holds the units of UNITS or of one longer line.
    """
    id_, text = F.col(f"`{id_col}`"), text_of(f"`{text_col}`")
    rows = packed(docs, rid=F.when(id_.isNotNull(), F.xxhash64(id_, text)), d=id_, text=text)
    gone = repeated_lines(rows.where("d IS NOT NULL").select("d", "rid", "text"), scope)
    found = joined(rows.select("row", "rid", "text"), gone, "rid", "left")
    found = found.withColumn("every", F.when(F.col("lines").isNotNull(), F.split("text", "\n")))
    cut = F.when(F.col("lines").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(_kept("every", "lines"), "\n"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return found.select("row", cut.alias("cut"), n_lines.cast("long").alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_removed"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str | None = None) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_bytes, kept_sha256. Cases are those of ``dedup_lines``; a null text is empty."""
    out = dedup_lines(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), scope=scope)
    text = F.coalesce("cut", F.lit(""))
    return out.select("row.doc_id", "n_lines", "n_removed", F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text, 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str | None = None) -> DataFrame:
    """``docs`` with repeated lines cut; a document of which nothing but blanks is left goes. Cases are those of ``dedup_lines``."""
    out = dedup_lines(docs, id_col, text_col, scope).where((F.col("n_removed") == 0) | F.col("cut").rlike(r"\S"))
    return out.select(*(F.col("cut" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns))
