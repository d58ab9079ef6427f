"""Repeats of long byte strings, exact to the byte.

The plain method, ``repeated_positions``, is prefix doubling in Spark: each
position's rank for strings of L bytes and that of the position L further on
are sorted as a pair and give the rank for 2 L; positions whose pair is unique
drop out, until ``SPAN`` = 200 bytes. It starts with 8 bytes, where nearly
every position of a corpus is still shared, so its first rounds move some
twenty bytes for each byte of text (figures in the README).

``suffix_dedup`` therefore stands names, 64-bit hashes made from pairs of
names as ranks are from pairs of ranks, in the place of ranks, and lets few
positions take part. In every run of 101 strings of 100 bytes the one with
the least name is an anchor: two equal strings of 200 bytes have the same
anchor at the same place. Round one sorts the names of anchors (two in a
hundred positions); those that are unique drop out with all strings that lean
on them. Between anchors, segments that are equal with the 200 bytes behind
them are repeats as a whole; one of the equal segments, the owner, speaks for
all. Round two sorts the names at 200 bytes of every position whose anchor was
not unique and which an owner or nobody speaks for.

Names travel in blocks: one row holds all the names of a task's texts that
fall into one range of names, with their positions. Equal names within a
block are sent once. Long texts are taken in pieces that overlap.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import joined, materialize, mix, new_scope, sweep, text_of

SPAN, GRAM = 200, 100
#: Bytes of text that a worker names at once, and that pieces of a text see of each other; names a worker holds.
CHUNK, MARGIN, HELD = 1 << 19, 4 * SPAN, 1_500_000
#: Fewest ranges that names are dealt into, and bytes of text for each range.
RANGES, BYTES_A_RANGE = 256, 4 << 20

_B = 0x9E3779B97F4A7C15
_NONE = np.uint64((1 << 64) - 1)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: What a name is for: an anchor, a segment, a string of SPAN bytes.
ANCHOR, SEGMENT, STRING = 0, 1, 2
BLOCK = "place int, src long, names binary, at binary, kind int"


def _pair(a: np.ndarray, n: int, b: np.ndarray) -> np.ndarray:
    """Names of length n and m -> names of length n + m: a at a position, b n further on."""
    return a[: len(b) - n] + np.uint64(pow(_B, n, 1 << 64)) * b[n:]


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the strings of GRAM and of SPAN bytes at each position that has them."""
    with np.errstate(over="ignore"):
        now, kept = _TABLE[data], {}
        for n in (1, 2, 4, 8, 16, 32):
            now = _pair(now, n, now)
            if 2 * n in (4, 32, 64):
                kept[2 * n] = now
        gram = _pair(_pair(kept[64], 64, kept[32]), 96, kept[4])
        return mix(gram), mix(_pair(gram, GRAM, gram) + np.uint64(SPAN))


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = of(x[:-n], x[n:])
        n *= 2
    return of(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


@dataclass
class Piece:
    """A text or a part of one: ``data`` begins at ``base``; what starts in ``low`` to ``high`` is its own, the rest is there to be seen."""

    rid: int
    data: bytes
    base: int = 0
    low: int = 0
    high: int = 0
    last: bool = True
    more: tuple = ()


def pieces_of(rid: int, data: bytes, *more) -> list[Piece]:
    n = len(data)
    if n <= 2 * CHUNK:
        return [Piece(rid, data, 0, 0, n, True, more)]
    out = []
    for a in range(0, n, CHUNK):
        b, start = min(a + CHUNK, n), max(0, a - MARGIN)
        out.append(Piece(rid, data[start : b + MARGIN], start, a - start, b - start, b + MARGIN >= n, more))
    return out


class Texts:
    """Some pieces end to end, with the names and anchors in them."""

    def __init__(self, pieces: list[Piece]):
        self.pieces, texts = pieces, [p.data for p in pieces]
        self.starts = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.gram, self.string = names(data) if len(data) >= SPAN else (np.zeros(0, np.uint64),) * 2
        self.fits = np.zeros(len(self.string), bool)  # a string of SPAN bytes ends within its text
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            if b - a >= SPAN:
                self.fits[a : b - SPAN + 1] = True
        self.least = np.where(self.fits, _slide(self.gram, SPAN - GRAM + 1, np.minimum), np.uint64(0)) if len(self.string) else self.string
        # an anchor is least in some run that holds it
        wide = SPAN - GRAM
        around = np.concatenate([np.zeros(wide, np.uint64), self.least, np.zeros(wide, np.uint64)])
        most = _slide(around, wide + 1, np.maximum) if len(self.string) else self.gram
        self.anchors = np.flatnonzero((self.gram == most[: len(self.gram)]) & (most[: len(self.gram)] > 0))
        self.own = np.zeros(len(data), bool)
        for p, start in zip(pieces, self.starts.tolist(), strict=False):
            self.own[start + p.low : start + p.high] = True

    def cuts(self) -> np.ndarray:
        """Where segments begin and end: anchors, and the first and last string of each text."""
        inside = self.anchors[self.anchors < len(self.fits)]
        inside = inside[self.fits[inside]]
        long = np.diff(self.starts) >= SPAN
        starts = self.starts[:-1][long & np.asarray([p.base == 0 for p in self.pieces], bool)]
        ends = self.starts[1:][long & np.asarray([p.last for p in self.pieces], bool)] - SPAN
        return np.unique(np.concatenate([inside, starts, ends]))

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, first, last): strings from first to last, known by their ends and the way between; a piece's own."""
        cuts = self.cuts()
        text = np.searchsorted(self.starts, cuts, "right")
        same = text[1:] == text[:-1]
        first, last = cuts[:-1][same], cuts[1:][same]
        alone = cuts[np.concatenate([[True], ~same]) & np.concatenate([~same, [True]])] if len(cuts) else cuts
        first, last = np.concatenate([first, alone]), np.concatenate([last, alone])
        first, last = first[self.own[first]], last[self.own[first]]
        with np.errstate(over="ignore"):
            name = mix(self.string[first] * np.uint64(3) + mix(self.string[last] + (last - first).astype(np.uint64)))
        return name, first, last


def _packed(x: np.ndarray) -> bytes:
    """Ascending positions, small as differences."""
    return zstandard.compress(np.diff(x, prepend=0).astype(np.int64).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(x), np.int64))


_NAMES = ["place", "src", "names", "at", "kind"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 5
    kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


#: Kinds of row beside ANCHOR, SEGMENT and STRING: the texts of a source; positions that are repeats,
#: as an owner (+ kind) or spoken for by another (+ kind).
TEXTS, OWNER, SPOKEN = 10, 20, 30


def _judge(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its name, name comes again) for each entry; entries come in order."""
    order = np.argsort(name, kind="stable")
    s = name[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    more = np.concatenate([s[1:] == s[:-1], [False]]) if len(s) else new
    first, again = np.empty(len(s), bool), np.empty(len(s), bool)
    first[order], again[order] = new, ~new | more
    return first, again


class Sender:
    """Gathers names of one source and cuts them into blocks by range."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.reset()

    def reset(self):
        self.rids, self.bases, self.starts, self.base, self.parts, self.size, self.covered = [], [], [], 0, {}, 0, []

    def texts(self, pieces: list[Piece], starts: np.ndarray) -> int:
        """Takes the pieces' places; gives what to add to positions in them."""
        base = self.base
        self.rids += [p.rid for p in pieces]
        self.bases += [p.base for p in pieces]
        self.starts.append(starts[:-1] + base)
        self.base += int(starts[-1]) + 1
        return base

    def names(self, kind: int, name: np.ndarray, at: np.ndarray) -> None:
        self.parts.setdefault(kind, []).append((name, at))
        self.size += len(name)

    def blocks(self):
        if not self.rids:
            return
        known = np.asarray([self.rids, self.bases], np.int64).tobytes()
        src = (xxhash.xxh3_64_intdigest(known) >> 1) ^ len(self.rids)
        own = int(src % self.ranges)
        out = [(own, src, known, np.concatenate(self.starts).astype(np.int64).tobytes(), TEXTS)]
        if self.covered:
            out.append((own, src, b"", _packed(np.unique(np.concatenate(self.covered))), OWNER + SEGMENT))
        for kind, parts in sorted(self.parts.items()):
            name, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(at, kind="stable")
            name, at = name[order], at[order]
            first, again = _judge(name)
            for mark, which in ((OWNER, first & again), (SPOKEN, ~first)):
                if which.any():
                    out.append((own, src, b"", _packed(at[which]), mark + kind))
            name, at = name[first], at[first]
            place = ((name >> np.uint64(32)) % np.uint64(self.ranges)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            places, n = np.unique(place, return_counts=True)
            for p, mine in zip(places, np.split(order, np.cumsum(n)[:-1]), strict=True):
                out.append((int(p), src, name[mine].tobytes(), _packed(at[mine]), kind))
        self.reset()
        yield _rows(out)


def meet(blocks: DataFrame, ranges: int) -> DataFrame:
    """Blocks of names, brought together by range -> (src, kind, at): positions whose name another block has.

    The earliest block that holds a name owns it. Rows that are not names pass through.
    """

    def work(batches):
        held, at = [], None

        def settle():
            if held:
                sizes = [len(r[2]) // 8 for r in held]
                first, again = _judge(np.frombuffer(b"".join(r[2] for r in held), np.uint64))
                out, a = [], 0
                for (_, src, _, where, kind), n in zip(held, sizes, strict=True):
                    f, g = first[a : a + n], again[a : a + n]
                    a += n
                    if g.any():
                        where = _unpacked(where)
                        for mark, which in ((OWNER, f & g), (SPOKEN, ~f)):
                            if which.any():
                                out.append((0, src, b"", _packed(where[which]), mark + kind))
                held.clear()
                if out:
                    yield _rows(out)

        for batch in batches:
            passed = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[4] >= TEXTS:
                    passed.append(row)
                    continue
                if (row[0], row[4]) != at:
                    yield from settle()
                    at = row[0], row[4]
                held.append(row)
            if passed:
                yield _rows(passed)
        yield from settle()

    return blocks.repartition(ranges, "place").sortWithinPartitions("place", "kind", "src").mapInArrow(work, BLOCK)


def _by_source(met: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(pieces' ids and bases, starts, {kind: positions})`` for each source; gives an Arrow batch."""

    def work(batches):
        src, rids, starts, found = None, None, None, {}
        for batch in batches:
            for _, s, name, at, kind in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if s != src:
                    if rids is not None:
                        yield finish(rids, starts, {k: np.concatenate(v) for k, v in found.items()})
                    src, rids, found = s, None, {}
                if kind == TEXTS:
                    rids, starts = np.frombuffer(name, np.int64).reshape(2, -1), np.frombuffer(at, np.int64)
                else:
                    found.setdefault(kind, []).append(_unpacked(at))
        if rids is not None:
            yield finish(rids, starts, {k: np.concatenate(v) for k, v in found.items()})

    return met.repartition("src").sortWithinPartitions("src", "kind").mapInArrow(work, schema)


def _per_text(rids, starts, positions: dict[str, np.ndarray]):
    """For each piece that has any: its text's id, its base and the positions in the text, by name."""
    cut = {k: np.searchsorted(np.sort(v), np.append(starts, 1 << 62)) for k, v in positions.items()}
    ordered = {k: np.sort(v) for k, v in positions.items()}
    for i, (rid, base, start) in enumerate(zip(*rids.tolist(), starts.tolist(), strict=True)):
        own = {k: ordered[k][cut[k][i] : cut[k][i + 1]] - start + base for k in positions}
        if any(map(len, own.values())):
            yield rid, base, own


def _chunks(batches, columns: int):
    """Lists of pieces of about CHUNK bytes of text; the text is the second column."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            data = row[1].encode("utf-8", "surrogatepass")
            if len(data) < SPAN:
                continue
            for piece in pieces_of(row[0], data, *row[2:]):
                held.append(piece)
                size += len(piece.data)
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def round_one(docs: DataFrame, ranges: int) -> DataFrame:
    """(rid, text) -> (rid, base, n_owned, anchors, owned, spoken): positions in each piece that has shared anchors."""

    def send(batches):
        out = Sender(ranges)
        for pieces in _chunks(batches, 2):
            t = Texts(pieces)
            base = out.texts(pieces, t.starts)
            anchors = t.anchors[t.own[t.anchors]]
            out.names(ANCHOR, t.gram[anchors], anchors + base)
            name, first, _ = t.segments()
            out.names(SEGMENT, name, first + base)
            if out.size >= HELD:
                yield from out.blocks()
        yield from out.blocks()

    none = np.zeros(0, np.int64)

    def finish(rids, starts, found):
        spoken = np.unique(found.get(SPOKEN + SEGMENT, none))
        owned = np.setdiff1d(found.get(OWNER + SEGMENT, none), spoken)
        anchors = np.unique(np.concatenate([found.get(k + ANCHOR, none) for k in (OWNER, SPOKEN)]))
        rows = [(rid, at, len(x["owned"]), *(_packed(x[k]) for k in ("anchors", "owned", "spoken"))) for rid, at, x in _per_text(rids, starts, {"anchors": anchors, "owned": owned, "spoken": spoken})]
        columns = zip(*rows, strict=True) if rows else ((),) * 6
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["rid", "base", "n_owned", "anchors", "owned", "spoken"])

    return _by_source(meet(docs.mapInArrow(send, BLOCK), ranges), finish, "rid long, base long, n_owned long, anchors binary, owned binary, spoken binary")


def round_two(docs: DataFrame, ranges: int) -> DataFrame:
    """(rid, text, found: anchors, owned, spoken of each piece) -> (rid, spans): start and end of each removed run, packed, by piece."""
    known = (OWNER + STRING, SPOKEN + STRING, OWNER + SEGMENT)

    def send(batches):
        out = Sender(ranges)
        for pieces in _chunks(batches, 3):
            t = Texts(pieces)
            base = out.texts(pieces, t.starts)
            alive = np.full(len(t.gram), _NONE)
            quiet = np.zeros(len(t.string) + 1, np.int32)
            _, first, last = t.segments()
            ordered = np.argsort(first, kind="stable")
            for piece, start in zip(pieces, t.starts.tolist(), strict=False):
                # those of other pieces too, as far as this one sees them
                anchors, owned, spoken = (np.concatenate([_unpacked(x[k]) for x in piece.more[0]]) - piece.base for k in ("anchors", "owned", "spoken"))
                anchors = anchors[(anchors >= 0) & (anchors <= len(piece.data) - GRAM)] + start
                alive[anchors] = t.gram[anchors]
                for places, silent in ((owned, False), (spoken, True)):
                    places = places[(places >= piece.low) & (places < piece.high)] + start
                    at = ordered[np.searchsorted(first[ordered], places)]
                    # every string of such a run is a repeat; its ends cover what lies between
                    out.covered += [first[at] + base, last[at] + base]
                    if silent:
                        np.add.at(quiet, first[at], 1)
                        np.add.at(quiet, last[at] + 1, -1)
            shared = t.fits & t.own[: len(t.fits)] & (_slide(alive, SPAN - GRAM + 1, np.minimum) == t.least) & (np.cumsum(quiet[:-1]) == 0)
            at = np.flatnonzero(shared)
            out.names(STRING, t.string[at], at + base)
            if out.size >= HELD:
                yield from out.blocks()
        yield from out.blocks()

    none = np.zeros(0, np.int64)

    def finish(rids, starts, found):
        at = np.unique(np.concatenate([found.get(k, none) for k in known]))
        rows = []
        for rid, _, x in _per_text(rids, starts, {"at": at}):
            p = x["at"]
            new = np.concatenate([[True], p[1:] > p[:-1] + SPAN])
            begin, end = p[new], p[np.concatenate([new[1:], [True]])] + SPAN
            rows.append((rid, np.column_stack([begin, end]).astype(np.int64).tobytes()))
        columns = zip(*rows, strict=True) if rows else ((),) * 2
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.binary()), strict=True)], ["rid", "spans"])

    return _by_source(meet(docs.mapInArrow(send, BLOCK), ranges), finish, "rid long, spans binary")


def _runs(packed: list[bytes] | None) -> list[tuple[int, int]]:
    """The runs of all pieces, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for part in packed or () for x in struct.iter_unpack("<qq", part)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte goes that lies in a string of SPAN bytes which starts anywhere
    else too, in the same text or another. Null texts are empty; shorter texts
    lose nothing. Of rows that repeat, all lose what they share; rows that
    repeat an id, and rows without one, are texts of their own. An empty table
    gives no rows; other columns are not looked at. A text of any length is
    named in pieces: a task holds some 200 bytes for each byte of one piece,
    and ten for each of the text itself.
    """
    inner = new_scope("suffix")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(RANGES, size // BYTES_A_RANGE)
    found = round_one(rows.select("rid", "text"), ranges)
    # rows that repeat an id and its text share one finding: that of the row which owns most
    found = found.groupBy("rid", "base").agg(F.max(F.struct("n_owned", "anchors", "owned", "spoken")).alias("x"))
    found = materialize(found.groupBy("rid").agg(F.collect_list(F.struct("x.anchors", "x.owned", "x.spoken")).alias("found")), "suffix-anchors", inner)
    # texts move only if something in them is shared, and by the same plan at every size
    spans = round_two(joined(rows.select("rid", "text"), found, "rid", limit=0).select("rid", "text", "found"), ranges)
    spans = materialize(spans.groupBy("rid").agg(F.collect_set("spans").alias("spans")), "suffix-spans", scope)
    sweep(docs.sparkSession, inner)
    cut = joined(rows, spans, "rid", "left", limit=0).select("doc_id", "text", "spans")

    def work(batches):
        for batch in batches:
            out = []
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                digest, at, gone, n = hashlib.sha256(), 0, 0, 0
                for a, b in _runs(packed):
                    digest.update(data[at:a])
                    gone, n, at = gone + b - a, n + 1, b
                digest.update(data[at:])
                out.append((len(data), gone, n, digest.hexdigest()))
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_positions(texts: DataFrame, span: int = SPAN, scope: str | None = None) -> DataFrame:
    """(rid, text) of unique rid -> (rid, at): where a string of ``span`` bytes starts that starts elsewhere too.

    Prefix doubling proper: ranks of 8 bytes are the bytes themselves, later
    ones the numbers of the sorted distinct pairs, so equal ranks mean equal
    strings. The last step is as short as ``span`` asks.
    """

    def first(batches):
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) >= span:
                    window = np.lib.stride_tricks.sliding_window_view(data, 8)
                    rank = np.ascontiguousarray(window).view(">i8").ravel().astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(rank), rid)), pa.array(np.arange(len(rank))), pa.array(rank)], ["rid", "at", "rank"])

    now, length = texts.select("rid", "text").mapInArrow(first, "rid long, at long, rank long"), 8
    while True:
        shared = now.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
        now = materialize(now.join(shared, "rank").select("rid", "at", "rank"), "doubling", scope)
        if length >= span:
            return now.select("rid", "at")
        step = min(length, span - length)
        ahead = now.select("rid", (F.col("at") - step).alias("at"), F.col("rank").alias("then"))
        pairs = now.join(ahead, ["rid", "at"])
        # the sorted distinct pairs, numbered: ranges of the order, and places within them
        known = pairs.groupBy("rank", "then").agg(F.count("*").alias("n")).where("n > 1").select("rank", "then").orderBy("rank", "then")
        known = materialize(known.withColumn("new", F.monotonically_increasing_id()), "doubling-ranks", scope)
        now, length = pairs.join(known, ["rank", "then"]).select("rid", "at", F.col("new").alias("rank")), length + step
